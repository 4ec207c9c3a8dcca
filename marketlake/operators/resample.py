"""Bars from ticks, for all symbols at once."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from marketlake import schemas

# The supported timeframes ("1m" is one calendar month).
TIMEFRAMES = ("5m", "15m", "30m", "1h", "1d", "1w", "1m")

_WINDOWS = {"5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour"}
_TRUNCATIONS = {"1d": "day", "1w": "week", "1m": "month"}


def check_timeframe(timeframe: str) -> str:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unsupported timeframe {timeframe!r}; one of {', '.join(TIMEFRAMES)}")
    return timeframe


def bar_start(ts: Column, timeframe: str) -> Column:
    """Start of the bar that holds ``ts``; weeks start on Monday."""
    check_timeframe(timeframe)
    if timeframe in _WINDOWS:
        return F.window(ts, _WINDOWS[timeframe])["start"]
    return F.date_trunc(_TRUNCATIONS[timeframe], ts)


def arrival_order(ts: Column, seq: str | None = None) -> Column:
    """(ts, seq) as one sortable decimal; ``seq`` names a BIGINT column of any range, and its nulls come first.

    A struct would do as an ordering, but it cannot live in a hash-aggregation buffer: the
    aggregate would sort all its input. A decimal keeps it a hash aggregate.
    """
    # A moment has 2^64 + 1 places: one for null, then all of BIGINT. Microseconds of the years 1 to 9999 fit 38 digits so.
    moment = (F.unix_micros(ts).cast("decimal(18,0)") * F.lit(Decimal(2**64 + 1))).cast("decimal(38,0)")
    if seq is None:
        return moment
    place = F.col(seq).cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1))
    return (moment + F.coalesce(place, F.lit(0))).cast("decimal(38,0)")


def tick_columns(ts: str, price: str, seq: str) -> list[Column]:
    """What the fold of ticks into bars reads: the price and its place in the arrival order."""
    return [F.col(price).cast("double").alias("price"), arrival_order(F.col(ts), seq).alias("arrival")]


def bar_folds() -> list[Column]:
    """Ticks of one bar, as ``tick_columns`` gives them, to its prices and its volume."""
    return [
        F.min_by("price", "arrival").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "arrival").alias("close"),
        F.count("*").cast("double").alias("volume"),
    ]


def resample_bars(
    ticks: DataFrame,
    timeframe: str,
    provider: str | None = None,
    ts: str = "ts",
    price: str = "price",
    seq: str = "seq",
) -> DataFrame:
    """Canonical bars from ticks (``symbol, ts, price, seq``).

    Open and close are the first and last price by (ts, seq); volume is the number of ticks. One
    shuffle, of at most one row per bar and map task: a hot symbol is folded before it moves.
    ``provider`` is a constant, or None to carry the ticks' own ``provider`` column.
    """
    check_timeframe(timeframe)
    keys = ["symbol"] if provider else ["symbol", "provider"]
    bars = (
        ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
        .select(*keys, bar_start(F.col(ts), timeframe).alias("timestamp"), *tick_columns(ts, price, seq))
        .groupBy(*keys, "timestamp")
        .agg(*bar_folds())
        .withColumn("timeframe", F.lit(timeframe))
    )
    if provider:
        bars = bars.withColumn("provider", F.lit(provider))
    return bars.select(*schemas.BARS.fieldNames())
