"""Range and latest reads of the canonical tables.

Filters are on bare columns, so they prune partitions and reach the Parquet scan. ``typed=True`` keeps
times as TIMESTAMP; the default gives the delivered string forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marketlake import schemas
from marketlake.functions import iso_day, iso_seconds, iso_seconds_z, nan_to_null
from marketlake.operators.resample import arrival_order

# The range a read covers when none is given.
DEFAULT_START = "2020-01-01"
DEFAULT_END = "2025-01-01"

# Macro series that can be asked for.
SUPPORTED_SERIES = ("CPI", "FED_FUNDS_RATE", "GDP_GROWTH", "UNEMPLOYMENT")


def _between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) <= F.lit(end).cast("timestamp")))


def _of(df: DataFrame, column: str, wanted: list[str] | None) -> DataFrame:
    return df if wanted is None else df.where(F.col(column).isin(*wanted))


def _upper(values: str | Sequence[str]) -> list[str]:
    return [v.upper() for v in ([values] if isinstance(values, str) else values)]


def get_bars(
    bars: DataFrame,
    symbols: str | Sequence[str] | None,
    timeframe: str = "1d",
    start: str = DEFAULT_START,
    end: str = DEFAULT_END,
    typed: bool = False,
    require_rows: bool = False,
) -> DataFrame:
    """Bars with ``start <= timestamp <= end``; a plain end date is its midnight.

    One symbol gives the five prices by time; several, or None for all, keep ``symbol`` as the first
    column.
    """
    wanted = None if symbols is None else _upper(symbols)
    rows = _of(bars, "symbol", wanted).where(F.col("timeframe") == timeframe)
    rows = _between(rows, "timestamp", start, end)
    if require_rows and rows.isEmpty():
        raise ValueError(f"no {timeframe} bars for {symbols} between {start} and {end}")
    time = F.col("timestamp") if typed else iso_seconds(F.col("timestamp"))
    lead = [] if wanted is not None and len(wanted) == 1 else ["symbol"]
    shown = nan_to_null(rows).select(*lead, time.alias("timestamp"), *schemas.PRICES, "volume")
    return shown.orderBy(*lead, "timestamp")


def get_news(
    news: DataFrame,
    symbols: str | Sequence[str] | None,
    start: str = DEFAULT_START,
    end: str = DEFAULT_END,
    typed: bool = False,
) -> DataFrame:
    """Articles from ``start`` to 23:59:59 of the ``end`` day."""
    wanted = None if symbols is None else _upper(symbols)
    rows = _between(_of(news, "symbol", wanted), "published_at", start, f"{end} 23:59:59")
    time = F.col("published_at") if typed else iso_seconds_z(F.col("published_at"))
    return rows.select("headline", time.alias("published_at"), "source", "url", "symbol").orderBy(
        "published_at", "symbol", "url", "headline"
    )


def latest_fundamentals(fundamentals: DataFrame, seq: str | None = None, typed: bool = False) -> DataFrame:
    """The newest snapshot of every symbol; of one moment, the one with the highest ``seq``.

    Folded by ``max_by`` over fixed-width values instead of a ranking window: a hash aggregate that
    combines in each map task before the shuffle.
    """
    ordered = fundamentals.withColumn("arrival", arrival_order(F.col("as_of"), seq))
    newest = ordered.groupBy("symbol").agg(
        *(F.max_by(m, "arrival").alias(m) for m in schemas.METRICS), F.max("as_of").alias("as_of")
    )
    time = F.col("as_of") if typed else iso_day(F.col("as_of"))
    return nan_to_null(newest).select("symbol", *schemas.METRICS, time.alias("as_of"))


def get_macro(
    macro: DataFrame,
    series: str | None,
    start: str = DEFAULT_START,
    end: str = DEFAULT_END,
    typed: bool = False,
    supported: Sequence[str] | None = SUPPORTED_SERIES,
) -> DataFrame:
    """Points of one series, or of all, with ``start <= date <= end``; an unsupported series is an error."""
    wanted = None if series is None else [series.upper()]
    if wanted and supported is not None and wanted[0] not in supported:
        raise ValueError(f"unsupported series {series!r}; one of {', '.join(sorted(supported))}")
    rows = nan_to_null(_between(_of(macro, "series", wanted), "date", start, end))
    time = F.col("date") if typed else iso_day(F.col("date"))
    return rows.select(time.alias("date"), "series", "value").orderBy("date", "series")
