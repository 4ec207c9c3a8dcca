"""Streams of bars: first-wins de-duplication and tumbling bars, with late data up to a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marketlake import schemas
from marketlake.operators.resample import bar_folds, check_timeframe, tick_columns
from marketlake.operators.series import BAR_KEYS, dedup_bars

# Window and offset per timeframe; the epoch was a Thursday, and weeks start on Monday.
_WINDOWS = {
    "5m": ("5 minutes", "0 seconds"),
    "15m": ("15 minutes", "0 seconds"),
    "30m": ("30 minutes", "0 seconds"),
    "1h": ("1 hour", "0 seconds"),
    "1d": ("1 day", "0 seconds"),
    "1w": ("7 days", "4 days"),
}


def first_arrivals(bars: DataFrame, delay: str = "1 day", keys: Sequence[str] = BAR_KEYS) -> DataFrame:
    """The first arrival per (series, timestamp), passed on at once; repeats within ``delay`` are dropped."""
    return bars.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([*keys, "timestamp"])


def first_by_seq(bars: DataFrame, delay: str = "1 day", keys: Sequence[str] = BAR_KEYS) -> DataFrame:
    """The first row in feed order per (series, timestamp), passed on once ``delay`` has gone by.

    Equals the batch ``dedup_bars`` however the rows are spread over micro-batches.
    """
    return schemas.conform(dedup_bars(bars.withWatermark("timestamp", delay), keys), schemas.BARS)


def tumbling_bars(
    ticks: DataFrame, timeframe: str, provider: str, delay: str = "10 minutes",
    ts: str = "ts", price: str = "price", seq: str = "seq",
) -> DataFrame:
    """Bars from a stream of ticks. In append mode a bar comes out once the watermark passes its end.

    Months have no fixed width and stay a batch timeframe.
    """
    if check_timeframe(timeframe) not in _WINDOWS:
        raise ValueError(f"{timeframe} bars cannot be streamed; one of {', '.join(_WINDOWS)}")
    width, offset = _WINDOWS[timeframe]
    return (
        ticks.withWatermark(ts, delay)
        .where(F.col(price).isNotNull())
        .select("symbol", ts, *tick_columns(ts, price, seq))
        .groupBy("symbol", F.window(ts, width, width, offset).alias("w"))
        .agg(*bar_folds())
        .select(
            F.col("w.start").alias("timestamp"), *schemas.PRICES, "volume", "symbol",
            F.lit(timeframe).alias("timeframe"), F.lit(provider).alias("provider"),
        )
    )
