"""Chat formatting of typed content, in DataFrame functions only.

A turn's content is an array of parts: text, image, audio or document. A visitor renders each part in order: text with the
template's control strings escaped, everything else as a placeholder, whose reference and token count are recorded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, SAYS, END = "<|start|>", "<|says|>", "<|end|>"
#: No control string of this template, or of others in use, is without one of these two characters; "&" makes it reversible.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Tokens that one unit (tile, second, page) of an attachment stands for.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<kind: string, text: string, ref: string, units: bigint>>"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_part(text: str) -> Column:
    """A column of plain text as content of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")))


def _attached(part: Column) -> Column:
    return part.kind.isin(*UNIT_TOKENS)


def _rendered(part: Column) -> Column:
    return F.when(_attached(part), F.concat(F.lit("<|"), part.kind, F.lit("|>"))).otherwise(escape(F.coalesce(part.text, F.lit(""))))


def _recorded(part: Column) -> Column:
    tokens = F.coalesce(*[F.when(part.kind == k, F.lit(n)) for k, n in UNIT_TOKENS.items()])
    return F.struct(part.kind.alias("kind"), part.ref.alias("ref"), (tokens * F.greatest(F.coalesce(part.units, F.lit(1)), F.lit(1))).alias("tokens"))


def formatted(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts): conv_id, formatted, loss_spans (start, end in code
    points of ``formatted``), attachments (kind, ref, tokens; in order of their placeholders), attachment_tokens.

    A turn is ``<|start|>role<|says|>body<|end|>``; attachments are ``<|image|>`` and the like. ``loss_spans`` hold the bodies of
    ``learned_role``. A part of unknown kind is taken as text; units below 1 or null count as one.

    Offsets are a running sum over a conversation's turns, which shares its exchange with the fold into one row. A row
    holds one conversation: that, not the table, bounds memory.

    Null role, text or parts are empty; equal turn numbers are ordered by role, then content; repeated rows are turns of
    their own; null conv_ids are one conversation; an empty table gives no rows. Other columns are ignored.
    """
    body = F.coalesce(F.array_join(F.transform("parts", _rendered), ""), F.lit(""))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body.alias("body"),
        F.coalesce(F.transform(F.filter("parts", _attached), _recorded), F.array().cast("array<struct<kind: string, ref: string, tokens: bigint>>")).alias("attached"),
    )
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SAYS))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attached")
    rows = rows.withColumns({"head": head, "line": F.concat(head, F.col("body"), F.lit(END))})
    start = F.sum(F.length("line").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("line") + F.length("head")
    rows = rows.withColumns({"n": F.row_number().over(order), "a": start}).withColumn("z", F.col("a") + F.length("body"))
    turn = F.struct("n", "line", (F.col("role") == learned_role).alias("learned"), "a", "z", "attached")
    folded = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    learned = F.transform(F.filter("t", lambda x: x.learned), lambda x: F.struct(x.a.alias("start"), x.z.alias("end")))
    attachments = F.flatten(F.transform("t", lambda x: x.attached))
    out = folded.select("conv_id", F.array_join(F.transform("t", lambda x: x.line), "").alias("formatted"), learned.alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a.tokens))


def read_turns(text: str = "formatted") -> Column:
    """The turns of a formatted conversation without attachments: array of (role, text), unescaped."""
    lines = F.split(F.col(text), r"<\|end\|>")
    lines = F.slice(lines, 1, F.size(lines) - 1)
    return F.transform(
        lines,
        lambda x: F.struct(
            unescape(F.substring_index(F.replace(x, F.lit(START), F.lit("")), SAYS, 1)).alias("role"),
            unescape(F.substring_index(x, SAYS, -1)).alias("text"),
        ),
    )


def read_learned(text: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.col(text), s.start.cast("int") + 1, (s.end - s.start).cast("int")))), "")
