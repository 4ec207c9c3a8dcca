"""Mixing sources to target weights by entropy balancing.

Every document gets a rate ``min(cap, exp(lambda * size / scale))``: of all rates up to ``cap`` whose expected words
meet the source's target, the ones nearest (in relative entropy) to keeping each document once. ``lambda`` solves the
convex dual of that problem, by Newton steps over all sources at once; a step is one aggregate.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from marketlake.llm.common import SPACE, stored

WEIGHTS = (5, 2, 1)


def word_count(text: str = "text"):
    """Runs of characters other than ASCII white space; null: 0."""
    words = F.filter(F.split(F.col(text), SPACE), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per row of ``sources`` (source, source_size): the target.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words. A target stops
    at ``cap`` times its source; the excess goes to the others by weight until none is above. In order of cap per
    weight, the first source that its share does not fill sets the level for all after it: no iteration. One row per
    source goes through the one window.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    listed = listed.withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    rest = share * F.sum("source_size").over(every) - (F.sum("most").over(upto) - F.col("most"))
    level = rest / (F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight")))
    levelled = listed.withColumn("level", F.when(level <= F.col("most") / F.col("weight"), level))
    first = F.min(F.when(F.col("level").isNotNull(), F.col("most") / F.col("weight"))).over(every)
    level = F.min(F.when(F.col("most") / F.col("weight") == first, F.col("level"))).over(every)
    return levelled.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), "most"))).select("source", "source_size", "target")


def tilts(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, steps: int = 60, near: float = 1e-6) -> DataFrame:
    """Per source: ``lambda`` and ``scale``, so that expected words meet the target.

    ``sizes``: (source, size, n), one row per distinct size. The dual's slope is the expected words less the target; it
    rises with lambda, so each Newton step is kept inside the bracket that earlier steps left, and halves it otherwise.
    The state is one row per source and stays distributed; the driver sees only the largest relative miss.
    """
    state = targets.where("target > 0").select(
        "source", "target", "source_size", F.lit(0.0).alias("lambda"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.lit(float("inf")).alias("miss"), (F.col("target") >= cap * F.col("source_size")).alias("full"),
    )
    scales = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = stored(state.join(scales, state.source.eqNullSafe(scales.source)).drop(scales.source))
    for _ in range(steps):
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), F.col("lambda") * x)))
        words = F.col("n") * F.col("size") * rate
        bend = F.when(rate < cap, words * x).otherwise(0.0)
        here = state.withColumnRenamed("source", "_s")
        sums = (
            sizes.join(here, sizes.source.eqNullSafe(here._s))
            .groupBy("_s")
            .agg(F.sum(words).alias("words"), F.sum(bend).alias("bend"))
            .withColumnRenamed("_s", "_k")
        )
        gap = F.col("words") - F.col("target")
        next_state = state.join(sums, state.source.eqNullSafe(sums._k)).drop("_k").withColumn("miss", F.when(F.col("full"), 0.0).otherwise(F.abs(gap) / F.col("target")))
        low, high = F.when(gap <= 0, F.col("lambda")).otherwise(F.col("low")), F.when(gap > 0, F.col("lambda")).otherwise(F.col("high"))
        next_state = next_state.withColumns({"_low": low, "_high": high, "_newton": F.col("lambda") - gap / F.nullif(F.col("bend"), F.lit(0.0))})
        # At most a factor e^3 per step; without a bracket around it, a step that Newton can't make goes outward.
        newton = F.greatest(F.col("lambda") - 3, F.least(F.col("lambda") + 3, F.col("_newton")))
        inside = F.coalesce(newton > F.col("_low"), F.lit(True)) & F.coalesce(newton < F.col("_high"), F.lit(True))
        step = F.when(F.col("_newton").isNotNull() & inside, newton)
        step = F.coalesce(step, (F.col("_low") + F.col("_high")) / 2, F.col("lambda") - 3 * F.signum(gap))
        step = F.when(F.col("miss") <= near, F.col("lambda")).otherwise(step)
        state = stored(next_state.withColumns({"lambda": step, "low": F.col("_low"), "high": F.col("_high")}).select(state.columns))
        if (state.agg(F.max("miss")).first()[0] or 0) <= near:
            break
    return state.select("source", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("lambda")).alias("lambda"), "scale", "target")


def _rounded(cap: float):
    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies per size, largest first; what a size misses is made up by the smaller ones after it."""
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        owed, out = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            owed += size * n * rate
            m = min(max(math.floor(owed / size + 0.5), 0), int(cap) * n) if size else n
            owed -= m * size
            out.append(m)
        return pdf.assign(copies=out)[["source", "size", "n", "source_size", "target", "copies"]]

    return copies


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, cell_rows: int = 100) -> DataFrame:
    """The columns of ``docs`` and: size, source_size, target, copies (0 to ``cap``, whole), taken (copies * size).

    Rates are rounded per (source, size), whole words carried from larger to smaller sizes, so a source ends within
    about half its smallest document of its target. Within a (source, size) the copies that are not one for each
    document go to the smallest hashes of doc_id and text: reruns agree, and of rows that repeat both as many get one.

    Skew: sizes are counted before anything else, so Newton steps and rounding see one row per distinct size (at most
    as many per source as its longest document has words). Ranks inside one (source, size), which may hold a third of
    all rows, are counted in cells of about ``cell_rows`` rows by hash range. Texts take part in one join only, with one
    row per (source, size).

    Null text has size 0 and counts as one copy of nothing; so do empty texts. Null is a source of its own, last in
    order. Repeated ids and rows, null ids among them, change no total; an empty table gives an empty result. Columns with the new names
    are replaced.
    """
    sized = docs.drop("size", "source_size", "target", "copies", "taken").withColumns({"size": word_count(), "_h": F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11)})
    slim = stored(sized.select("source", "size", "_h"))
    sizes = stored(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(sources, weights, share, cap))
    plan = _thresholds(slim, _copies(sizes, targets, cap), cell_rows)
    out = sized.join(plan, sized.source.eqNullSafe(plan._source) & (F.col("size") == F.col("_size")))
    # At the last hash some of its rows get a copy more: all of them, unless rows repeat.
    repeats = F.col("_at_last") < F.col("_tied")
    tied = F.coalesce((F.col("_h") == F.col("_last")) & repeats, F.lit(False))
    extra = F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False)).cast("bigint")
    done = out.where(~tied).withColumn("copies", F.col("_base") + extra)
    names = [c for c in sized.columns if c != "_h"]
    shown = [*names, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    if plan.where(repeats).isEmpty():
        return done.select(*shown)
    return done.select(*shown).unionByName(_numbered(out.where(tied)).withColumn("copies", F.col("_base") + (F.col("_rank") <= F.col("_at_last")).cast("bigint")).select(*shown))


def _numbered(rows: DataFrame, salts: int = 64) -> DataFrame:
    """Repeated rows of each (source, size) with a number from 1 (``_rank``). They are alike, so any numbers do; a group of them
    is counted in parts, of which no task holds more than one."""
    parts = stored(rows.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))))
    group = ["_source", "_size"]
    sums = parts.groupBy(*group, "_salt").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy("_salt")) - F.col("_c")
    sums = sums.select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_salt").alias("_t"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy("_h"))
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_salt") == F.col("_t"))
    return parts.withColumn("_own", own).join(sums, same).withColumn("_rank", F.col("_before") + F.col("_own"))


def _copies(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Per (source, size): id, n documents, whole copies of all of them, and the source's size and target."""
    solved = tilts(sizes, targets, cap).drop("target")
    both = targets.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    both = both.withColumnRenamed("source", "_source")
    rated = sizes.join(both, sizes.source.eqNullSafe(both._source))
    tilt = F.exp(F.least(F.lit(50.0), F.col("lambda") * F.col("size") / F.col("scale")))
    rated = rated.withColumn("rate", F.coalesce(F.least(F.lit(cap), tilt), F.lit(0.0)))
    schema = "source string, size bigint, n bigint, source_size bigint, target double, copies bigint"
    whole = rated.select("source", "size", "n", "source_size", "target", "rate").groupBy("source").applyInPandas(_rounded(cap), schema)
    return stored(whole.withColumn("id", F.monotonically_increasing_id()))


def _thresholds(slim: DataFrame, copies: DataFrame, cell_rows: int) -> DataFrame:
    """Per (source, size): copies for every document, the last hash that gets one more, how many rows have that hash (``_tied``), and
    how many of them get it (``_at_last``). Rows of one hash are folded before they are ranked."""
    uneven = copies.where(F.col("copies") % F.col("n") > 0).select("id", F.col("source").alias("_s"), F.col("size").alias("_z"), "n", (F.col("copies") % F.col("n")).alias("more"))
    cell = F.floor(F.col("_h") / F.lit(float(1 << 53)) * F.ceil(F.col("n") / cell_rows))
    rows = slim.join(uneven, slim.source.eqNullSafe(uneven._s) & (slim["size"] == uneven._z)).select("id", "more", "_h", cell.alias("cell"))
    hashes = rows.groupBy("id", "more", "cell", "_h").agg(F.count("*").alias("c"))
    counts = hashes.groupBy("id", "cell").agg(F.sum("c").alias("c"))
    before = F.sum("c").over(Window.partitionBy("id").orderBy("cell")) - F.col("c")
    counts = counts.select("id", "cell", before.alias("before"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("id", "cell").orderBy("_h"))
    ranked = hashes.join(counts, ["id", "cell"]).withColumn("upto", upto)
    last = ranked.where((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("c") < F.col("more")))
    last = last.select(F.col("id").alias("_id"), F.col("_h").alias("_last"), F.col("c").alias("_tied"), (F.col("more") - F.col("upto") + F.col("c")).alias("_at_last"))
    out = copies.join(last, copies.id == last._id, "left")
    whole = F.floor(F.col("copies") / F.col("n")).alias("_base")
    return stored(out.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", whole, "_last", "_tied", "_at_last"))


def take(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every document as often as its copies say; the columns stay. Rows are treated as in ``mixed``: texts without words
    stay once, and an empty table gives an empty result."""
    return mixed(docs, **how).withColumn("_k", F.explode(F.array_repeat("copies", F.col("copies").cast("int")))).select(*docs.columns)
