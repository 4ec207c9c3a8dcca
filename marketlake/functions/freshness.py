"""How long a stored dataset counts as fresh."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values, in seconds.
TTL_OHLCV_DAILY = 86_400
TTL_OHLCV_INTRADAY = 3_600
TTL_NEWS = 21_600
TTL_FUNDAMENTALS = 86_400
TTL_MACRO = 259_200

# Timeframes that are not intraday ("1m" is one month).
LONG_TIMEFRAMES = ("1d", "1w", "1m")


def is_intraday(timeframe: Column) -> Column:
    return timeframe.isNotNull() & (timeframe != "") & ~timeframe.isin(*LONG_TIMEFRAMES)


def ttl_seconds(data_type: Column, timeframe: Column) -> Column:
    return (
        F.when((data_type == "ohlcv") & is_intraday(timeframe), TTL_OHLCV_INTRADAY)
        .when(data_type == "ohlcv", TTL_OHLCV_DAILY)
        .when(data_type == "news", TTL_NEWS)
        .when(data_type == "fundamentals", TTL_FUNDAMENTALS)
        .when(data_type == "macro", TTL_MACRO)
        .otherwise(TTL_OHLCV_DAILY)
    )
