"""Personal data: direct identifiers by pattern, and the terms around them that give an identifier away.

For a protected entity e (one e-mail address, number, ...) and a term t, the corpus tells P(e | t): the share of the
documents with t that have t close to e. The disclosure of t is the part of e's information content that knowing t
leaves no doubt about, 1 + log P(e | t) / IC(e), with IC(e) = -log P(e). At 1, t always comes with e; at 0 it says nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from marketlake.llm.common import mapped, pieces, stored, utf8_bytes

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive where the pattern leaves nothing to give back: the same matches, in time linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")

#: Words on each side of an identifier that count as close to it.
WINDOW = 10
#: A term must come with an entity in so many different texts before its share says that it gives the entity away. Of an
#: entity in fewer texts, the terms that occur in no document but close to it do.
SUPPORT = 3
THRESHOLD = 0.8
#: A filter tells tasks which terms matter over the corpus: so many bits for each of them, so that about one in as many others passes
#: at any size, and at most so many in one filter. More terms take several filters, and a pass over the texts for each.
BITS_PER_TERM, MOST_BITS = 32, 1 << 28
_FLUSH = 200_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(d)] if i % 2 else d) for i, d in enumerate(reversed(digits))) % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) of the direct identifiers, by kind, then start."""
    out = [(0, a, z, text[a:z].lower()) for a, z in _emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span(), m[0]))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span(), digits))
    for m in _PHONE.finditer(text):
        digits = "".join(c for c in m[0] if c in "0123456789")
        if 9 <= len(digits) <= 15:
            out.append((3, *m.span(), digits))
    return out


def _outside(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the terms outside all identifiers."""
    spans = sorted((a, z) for _, a, z, _ in base)
    words, at = [], 0
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or m.end() <= spans[at][0]:
            words.append(m.span())
    return words


def _close_terms(text: str, base: list[tuple[int, int, int, str]], window: int) -> list[tuple[int, str, int, int, int]]:
    """(entity, term, start, end, 1 for the first of this pair here) of terms close to an identifier and outside all of them."""
    words = _outside(text, base)
    starts = [a for a, _ in words]
    out, seen, done = [], set(), set()
    for kind, a, z, value in base:
        entity = xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}") - (1 << 63)
        for s, e in words[max(0, bisect_left(starts, a) - window) : bisect_left(starts, z) + window]:
            if (entity, s) not in done:
                done.add((entity, s))
                term = text[s:e].lower()
                out.append((entity, term, s, e, int((entity, term) not in seen)))
                seen.add((entity, term))
    return out


_TERMS = "array<struct<entity: bigint, term: string, start: bigint, end: bigint, first: bigint>>"
_TERMS_ARROW = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64())]))


def _finder(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_bytes"):
            base, terms, entities = [], [], []
            for raw in batch.column("_bytes").to_pylist():
                text = raw.decode()
                found = identifiers(text)
                close = _close_terms(text, found, window) if found else []
                base.append([{"kind": KINDS[k], "start": a, "end": z} for k, a, z, _ in found])
                terms.append([dict(zip(("entity", "term", "start", "end", "first"), x, strict=True)) for x in close])
                entities.append(sorted({xxhash.xxh64_intdigest(f"{KINDS[k]}:{v}") - (1 << 63) for k, _, _, v in found}))
            kept = [n for n in batch.schema.names if n not in ("_bytes", "base", "close", "entities")]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            new = [pa.array(base, kind), pa.array(terms, _TERMS_ARROW), pa.array(entities, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new], names=[*kept, "base", "close", "entities"])

    return run


def _passes(shared):
    """Does a term pass a filter? The hash is Spark's own ``xxhash64`` of a text."""
    mask, words = shared.value

    def ask(term: str) -> bool:
        bit = xxhash.xxh64_intdigest(term, 42) & mask
        return bool(words[bit >> 3] >> (bit & 7) & 1)

    return ask


def _term_counter(shared):
    """(term, documents with it) of a partition, for terms that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, count = _passes(shared), Counter()

        def flush() -> pa.RecordBatch:
            kept = {t: n for t, n in count.items() if wanted(t)}
            count.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["term", "n"])

        for batch in pieces(batches, "_bytes"):
            for raw in batch.column("_bytes").to_pylist():
                count.update({t.lower() for t in set(_TERM.findall(raw.decode()))})
                if len(count) > _FLUSH:
                    yield flush()
        yield flush()

    return run


def _places(shared):
    """(text's hashes, term, start, end) of the terms that pass the filter, outside identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, passes = _passes(shared), {}
        for batch in pieces(batches, "_bytes"):
            at, terms, starts, ends = [], [], [], []
            for i, raw in enumerate(batch.column("_bytes").to_pylist()):
                text = raw.decode()
                if len(passes) > _FLUSH:
                    passes.clear()
                for word in set(_TERM.findall(text)):
                    if word not in passes:
                        passes[word] = wanted(word.lower())
                if not any(passes[m[0]] for m in _TERM.finditer(text)):
                    continue
                for a, z in _outside(text, identifiers(text)):
                    if passes[text[a:z]]:
                        at.append(i)
                        terms.append(text[a:z].lower())
                        starts.append(a)
                        ends.append(z)
            rows = pa.array(at, pa.int64())
            new = [pa.array(terms, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("_th").take(rows), batch.column("_th2").take(rows), *new], names=["_th", "_th2", "term", "start", "end"])

    return run


def _filters(terms: DataFrame) -> list:
    """Filters that together pass the distinct terms, on all tasks. Their bits are set by Spark's bitmap aggregate; what the driver
    collects of one filter is its size."""
    terms = stored(terms.select("term").distinct())
    n = terms.count()
    parts = -(-n * BITS_PER_TERM // MOST_BITS) or 1
    bits = min(MOST_BITS, 1 << max(15, (n * BITS_PER_TERM // parts).bit_length()))
    out = []
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("term", F.lit("part")), F.lit(parts)) == part)
        bit = F.xxhash64("term").bitwiseAND(F.lit(bits - 1))
        rows = own.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("words"))
        words = bytearray(bits // 8)
        for r in rows.toLocalIterator():
            words[r.bucket << 12 : (r.bucket + 1) << 12] = r.words
        out.append(terms.sparkSession.sparkContext.broadcast((bits - 1, bytes(words))))
    return out


def _over(filters: list, rows: DataFrame, run, schema: str) -> DataFrame:
    """What a map finds with each of the filters; a row that passes by chance, in any of them, is for a join to drop."""
    return reduce(DataFrame.unionByName, [mapped(rows, run(f), schema) for f in filters])


def _text_hashes():
    return F.xxhash64("text").alias("_th"), F.xxhash64("text", F.lit("again")).alias("_th2")


def find(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` (default: all columns) of ``docs``, ``base`` (kind, start, end: direct identifiers) and ``terms`` (start, end).

    Positions are code points, ends exclusive. Direct identifiers are the leftmost non-overlapping matches of each kind's
    pattern that pass its check. ``terms`` are all places, in any document, of the words that give an identifier away: those
    within ``window`` words of it whose disclosure of it is at least ``threshold``, over ``support`` different texts or more.
    Of an identifier in fewer different texts: the words which no document has without having them close to it.

    Three maps read the texts: one finds identifiers and what stands close to them, one counts the documents of the terms that
    matter, one finds the places of those that disclose; the terms are named by filters that grow with their number. Pairs are
    folded per task before they move. An entity in every document has
    no information content and discloses nothing.

    Null texts are empty; a text without identifiers has empty arrays. Repeated rows each get their spans and count as
    documents, but as one text for the support. An empty table gives an empty result. Columns with the new names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "terms")]
    # The rows' own columns as one, so that none of their names clashes.
    texts = docs.select(F.struct(*keep).alias("_row") if keep else F.lit(None).cast("int").alias("_row"), utf8_bytes().alias("_bytes"), *_text_hashes())
    schema = texts.drop("_bytes").withColumns(
        {"base": F.lit(None).cast("array<struct<kind: string, start: bigint, end: bigint>>"), "close": F.lit(None).cast(_TERMS), "entities": F.lit(None).cast("array<bigint>")}
    )
    found = stored(mapped(texts, _finder(window), schema.schema))
    total = found.count()
    close = found.where(F.size("close") > 0).select("_th", F.inline("close"))
    pairs = close.groupBy("entity", "term", "_th").agg(F.sum("first").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    # Copies of a text are one text of an entity.
    in_texts = found.select("_th", F.explode("entities").alias("entity")).groupBy("entity", "_th").agg(F.count("*").alias("n"))
    with_entity = stored(in_texts.groupBy("entity").agg(F.sum("n").alias("with_entity"), F.count("*").alias("entity_texts")))
    rare = F.col("entity_texts") < support
    pairs = pairs.join(with_entity, "entity").where(rare | (F.col("texts") >= support))

    def discloses(documents) -> Column:
        """Does the term give the entity away if so many documents have it? The more have it, the less."""
        share = 1 + F.log(F.col("both") / documents) / F.nullif(F.log(total / F.col("with_entity")), F.lit(0.0))
        return F.when(rare, F.col("both") >= documents).otherwise(share >= threshold) & (F.col("with_entity") < total)

    # At least the texts in which a term is close to any identifier have it. Where these are too many already, as for all
    # frequent words, nothing needs to be counted.
    near = close.select("term", "_th").distinct().groupBy("term").agg(F.count("*").alias("near"))
    pairs = stored(pairs.join(near, "term").where(discloses(F.col("near"))).drop("near"))
    counted = _over(_filters(pairs), docs.select(utf8_bytes().alias("_bytes")), _term_counter, "term string, n bigint")
    joined = pairs.join(counted.groupBy("term").agg(F.sum("n").alias("with_term")), "term")
    told = stored(joined.where(discloses(F.col("with_term"))).select("term").distinct())
    # Where a term stands follows from the text alone, so that places go back to the rows by text.
    places = _over(_filters(told), docs.select(utf8_bytes().alias("_bytes"), *_text_hashes()), _places, "_th bigint, _th2 bigint, term string, start bigint, end bigint")
    spans = places.join(told, "term").groupBy("_th", "_th2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    out = found.join(spans, ["_th", "_th2"], "left")
    return out.select(*(["_row.*"] if keep else []), "base", F.coalesce("terms", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("terms"))


def _replacer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_bytes"):
        texts = []
        for raw, base, terms in zip(*(batch.column(c).to_pylist() for c in ("_bytes", "base", "terms")), strict=True):
            text, out, at = raw.decode(), [], 0
            # A direct identifier is generalised to its kind, a disclosing name to "[NAME]"; other terms are removed.
            cuts = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
            cuts += [(s["start"], s["end"], "[NAME]" if text[s["start"]].isupper() else "") for s in terms]
            for start, end, instead in sorted(cuts):
                if start >= at:
                    out += [text[at:start], instead]
                at = max(at, end)
            texts.append("".join([*out, text[at:]]))
        rest = [n for n in batch.schema.names if n != "_bytes"]
        new = {"text": pa.array(texts, pa.string())}
        yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in rest], names=rest)


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with identifiers and disclosing terms replaced in the text; the columns stay, and texts without any, null ones
    among them. Rows are treated as in ``find``; repeated rows alike, and an empty table gives an empty result."""
    found = find(docs.select(F.struct("*").alias("_doc"), "text"), keep=["_doc"], **how).withColumn("text", F.col("_doc.text"))
    clean = found.where((F.size("base") == 0) & (F.size("terms") == 0))
    touched = found.where((F.size("base") > 0) | (F.size("terms") > 0)).withColumn("_bytes", utf8_bytes())
    changed = mapped(touched, _replacer, touched.drop("_bytes").schema).withColumn("_doc", F.col("_doc").withField("text", F.col("text")))
    return clean.select("_doc.*").unionByName(changed.select("_doc.*"))
