"""Sets of days as bitmaps, which merge: what a series covers over many runs, without reading its bars again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlake.operators.calendar import present_days
from marketlake.operators.series import BAR_KEYS

#: Bits of one bitmap, as Spark's bitmap functions have it.
BITS = 8 * 4096


def _number(day: Column) -> Column:
    """Days from 1970 on, from 1 for Spark's buckets, which begin there."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") + 1


def day_sets(bars: DataFrame, keys: Sequence[str] = BAR_KEYS, ts: str = "timestamp") -> DataFrame:
    """(keys…, bucket, first_day, last_day, days): the days on which a series has rows, a bit each in ``days``.

    Distinct days are folded in each map task. A bitmap is 4,096 bytes for 89 years, so a series is nearly always one row.
    """
    day = F.col("day")
    return present_days(bars, keys, ts).groupBy(*keys, F.bitmap_bucket_number(_number(day)).alias("bucket")).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.bitmap_construct_agg(F.bitmap_bit_position(_number(day))).alias("days")
    )


def merged(sets: DataFrame, keys: Sequence[str] = BAR_KEYS) -> DataFrame:
    """The union of day sets, of any number of runs: an aggregate that combines in each map task."""
    return sets.groupBy(*keys, "bucket").agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.bitmap_or_agg("days").alias("days")
    )


def covered(sets: DataFrame, keys: Sequence[str] = BAR_KEYS) -> DataFrame:
    """First and last day and the number of days per series, as ``calendar.coverage`` counts them from the bars."""
    return merged(sets, keys).groupBy(*keys).agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum(F.bitmap_count("days")).alias("n_days")
    )


def has_day(days: Column, day: Column) -> Column:
    """Is the day's bit set? ``days`` must be the bitmap of the day's bucket."""
    at = F.bitmap_bit_position(_number(day))
    byte = F.conv(F.hex(F.substring(days, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def missing_days(sets: DataFrame, calendar: DataFrame, keys: Sequence[str] = BAR_KEYS) -> DataFrame:
    """(keys…, day): trading days between a series' first and last day on which no run has a row.

    Each series is met by the calendar's days as one array of at most an entry per date; bars are not read.
    """
    whole = merged(sets, keys)
    ends = whole.groupBy(*keys).agg(F.min("first_day").alias("lo"), F.max("last_day").alias("hi"), F.map_from_entries(F.collect_list(F.struct("bucket", "days"))).alias("sets"))
    ends = ends.withColumn("trading", calendar.agg(F.sort_array(F.collect_set("day")).alias("days")).scalar())
    inside = F.filter(F.coalesce("trading", F.array().cast("array<date>")), lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))
    own = lambda d: F.try_element_at("sets", F.bitmap_bucket_number(_number(d)))
    lacking = F.filter(inside, lambda d: ~F.coalesce(has_day(own(d), d), F.lit(False)))
    return ends.select(*keys, F.explode(lacking).alias("day"))
