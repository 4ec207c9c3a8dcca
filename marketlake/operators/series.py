"""Operators on ordered series: first-wins de-duplication and the prior close.

A window over a whole series puts one hot symbol into one task. The operators here cut every series
into time slices, work inside (series, slice), and carry the edge value from slice to slice over a
table with one row per (series, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlake import schemas

SLICE_DAYS = 30
BAR_KEYS = schemas.SERIES_KEYS["ohlcv"]


def time_slice(ts: Column, days: float | Column = SLICE_DAYS) -> Column:
    """Number of the fixed-width time slice that holds ``ts``; a given slice column stands as it is."""
    if isinstance(days, Column):
        return days
    return F.floor(F.unix_seconds(ts) / F.lit(int(days * 86_400))).cast("long")


def even_slices(df: DataFrame, ts: str, rows_per_slice: int = 1_000_000) -> Column:
    """A slice column whose width follows the density of ``df``: so many rows, of all series, on average.

    One narrow pass for count, first and last time. These are exact, so the slices are the same
    wherever and however often they are evaluated.
    """
    at = F.unix_micros(ts)
    span, n = F.max(at) - F.min(at), F.count("*")
    width = F.ceil(span / F.greatest(n, F.lit(1)) * rows_per_slice)
    micros = df.agg(F.greatest(width, F.lit(1).cast("long")).alias("width")).scalar()
    return F.floor(at / micros).cast("long")


SEQ_OR_LAST = "coalesce(seq, 9223372036854775807L)"


def first_by_seq(column: str, has_seq: bool) -> Column:
    """Value of the first row of a group in feed order."""
    return F.min_by(column, F.expr(SEQ_OR_LAST)) if has_seq else F.first(column)


def dedup_bars(df: DataFrame, keys: Sequence[str] = BAR_KEYS) -> DataFrame:
    """Keep the first row, by ``seq``, of every (series, timestamp).

    An aggregate, not a ranking window: copies fold inside each map task, so a timestamp that holds
    a third of all rows shuffles as one row per task. All buffers are fixed-width, so it hashes.
    """
    values = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    return df.groupBy(*keys, "timestamp").agg(*(first_by_seq(c, True).alias(c) for c in values))


def with_prior_close(
    bars: DataFrame, keys: Sequence[str] = BAR_KEYS, days: float | Column | None = SLICE_DAYS
) -> DataFrame:
    """Add ``prior_close``: the close of the bar before, in time order, within its series.

    ``bars`` holds one row per (series, timestamp). The big side is shuffled once, on
    (series, slice), for both the join and the window. ``days=None`` takes a series as one slice, in
    one pass: right for bars on their timeframe's grid (as ``resample_bars`` makes them), where the
    covered time bounds a series (20 years of 5m bars are 2 million rows) however hot its symbol is.
    Off the grid, ``days=even_slices(bars, "timestamp")`` fits the slices to the data.
    """
    if days is None:
        return bars.withColumn(
            "prior_close", F.lag("close").over(Window.partitionBy(*keys).orderBy("timestamp"))
        )
    sliced = bars.withColumn("slice", time_slice(F.col("timestamp"), days))
    by_series = Window.partitionBy(*keys).orderBy("slice")
    # One row per (series, slice): bounded by the covered time, not by the number of rows.
    carry = (
        sliced.groupBy(*keys, "slice")
        .agg(F.max_by("close", "timestamp").alias("last_close"))
        .select(*keys, "slice", F.lag("last_close").over(by_series).alias("carried"))
    )
    in_slice = Window.partitionBy(*keys, "slice").orderBy("timestamp")
    return (
        sliced.join(carry, [*keys, "slice"], "left")
        .withColumn("inside", F.lag("close").over(in_slice))
        .withColumn("head", F.row_number().over(in_slice) == 1)
        .withColumn("prior_close", F.when(F.col("head"), F.col("carried")).otherwise(F.col("inside")))
        .drop("slice", "carried", "inside", "head")
        .select(*bars.columns, "prior_close")
    )
