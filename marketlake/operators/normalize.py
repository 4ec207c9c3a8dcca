"""Raw feeds to canonical tables. Every function is ``DataFrame -> DataFrame`` for ``df.transform``.

A feed of one series passes its symbol (series, timeframe, provider) as constants; a feed of many
carries them as columns. A feed without the needed columns gives an empty table with the schema.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from marketlake import schemas
from marketlake.functions import as_of_timestamp, is_blank, safe_double, to_utc
from marketlake.functions.numbers import numeric_column
from marketlake.operators.series import dedup_bars

# Names under which feeds deliver a column, in order of preference.
TIME_CANDIDATES = ("Datetime", "Date", "datetime", "date", "timestamp")
MACRO_DATE_NAMES = ("date", "Date", "index")
BAR_ALIASES = {
    "open": ("Open", "open"),
    "high": ("High", "high"),
    "low": ("Low", "low"),
    "close": ("Close", "close"),
    "volume": ("Volume", "volume"),
}


def _first_present(candidates: Iterable[str], columns: list[str]) -> int | None:
    """Position of the first candidate, compared by exact case."""
    return next((columns.index(c) for c in candidates if c in columns), None)


def _pick(df: DataFrame, positions: dict[str, int]) -> DataFrame:
    """Select columns by position under new names (``Date`` and ``date`` may both be present)."""
    by_position = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return by_position.select(*(F.col(f"c{i}").alias(name) for name, i in positions.items()))


def split_readable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a bar feed whose time can be read, the others), before anything is folded. The columns stay."""
    at = _first_present(TIME_CANDIDATES, raw.columns)
    if at is None:
        return raw, raw.limit(0)
    # By position: "Date" and "date" may both be there.
    named = raw.toDF(*(f"c{i}" for i in range(len(raw.columns))))
    readable = to_utc(named, f"c{at}").isNotNull()
    return named.where(readable).toDF(*raw.columns), named.where(~readable).toDF(*raw.columns)


def _constant_or_carried(df: DataFrame, name: str, constant: str | None) -> Column:
    if constant is not None:
        return F.lit(constant)
    if name not in df.columns:
        raise ValueError(f"the feed has no column {name!r}; pass it as a constant")
    return F.col(name)


def normalize_bars(
    raw: DataFrame,
    symbol: str | None = None,
    timeframe: str | None = None,
    provider: str | None = None,
    strict_time: bool = True,
) -> DataFrame:
    """Canonical bars: names and types fixed, null prices dropped, first row per timestamp kept.

    ``seq`` gives the feed order; without it the rows must already be unique per timestamp. A time that does not parse
    fails the job: keep such rows apart first (``split_readable``). Without ``strict_time`` they become null, and rows of
    one series without a time are one row, as rows of one time are.
    """
    columns = raw.columns
    positions = {"timestamp": _first_present(TIME_CANDIDATES, columns)}
    positions |= {name: _first_present(names, columns) for name, names in BAR_ALIASES.items()}
    if None in positions.values():
        return schemas.empty(raw.sparkSession, schemas.BARS)
    constants = {"symbol": symbol, "timeframe": timeframe, "provider": provider}
    for name in (*constants, "seq"):
        if name in columns:
            positions[name] = columns.index(name)

    picked = _pick(raw, positions)
    time = to_utc(picked, "timestamp")
    if strict_time:
        bad = F.col("timestamp").isNotNull() & time.isNull()
        time = F.when(bad, F.raise_error(F.concat(F.lit("bad time: "), F.col("timestamp").cast("string")))).otherwise(time)
    typed = picked.select(
        time.alias("timestamp"),
        *(numeric_column(picked, c).alias(c) for c in BAR_ALIASES),
        F.upper(_constant_or_carried(picked, "symbol", symbol)).alias("symbol"),
        *(_constant_or_carried(picked, n, v).alias(n) for n, v in constants.items() if n != "symbol"),
        (F.col("seq").cast("long") if "seq" in positions else F.lit(0).cast("long")).alias("seq"),
    ).dropna(subset=list(schemas.PRICES))
    return schemas.conform(dedup_bars(typed), schemas.BARS)


def normalize_news(raw: DataFrame, symbol: str | None = None, provider: str | None = None) -> DataFrame:
    """Canonical news: UTC time, rows without a headline or a time dropped. Row by row, no shuffle."""
    if "headline" not in raw.columns or "published_at" not in raw.columns:
        return schemas.empty(raw.sparkSession, schemas.NEWS)
    missing = [c for c in ("source", "url") if c not in raw.columns]
    filled = raw.withColumns({c: F.lit(None).cast("string") for c in missing})
    news = filled.select(
        "headline",
        to_utc(filled, "published_at").alias("published_at"),
        "source",
        "url",
        F.upper(_constant_or_carried(filled, "symbol", symbol)).alias("symbol"),
        _constant_or_carried(filled, "provider", provider).alias("provider"),
    )
    return schemas.conform(
        news.dropna(subset=["headline", "published_at"]).where(~is_blank(F.col("headline"))), schemas.NEWS
    )


def normalize_fundamentals(
    raw: DataFrame, now: Column, symbol: str | None = None, provider: str | None = None
) -> DataFrame:
    """Canonical fundamentals: absent or unusable metrics are null, a missing time is ``now``. The symbol stays as it is given."""
    has_time = "as_of" in raw.columns
    as_of = as_of_timestamp(F.col("as_of").cast("string"), now) if has_time else now.cast("timestamp")
    return schemas.conform(
        raw.select(
            _constant_or_carried(raw, "symbol", symbol).alias("symbol"),
            as_of.alias("as_of"),
            *((safe_double(F.col(m)) if m in raw.columns else F.lit(None)).alias(m) for m in schemas.METRICS),
            _constant_or_carried(raw, "provider", provider).alias("provider"),
        ),
        schemas.FUNDAMENTALS,
    )


def normalize_macro(raw: DataFrame, series: str | None = None, provider: str | None = None) -> DataFrame:
    """Canonical macro points: date and value by name, else by position; incomplete rows dropped."""
    columns = raw.columns
    date = next((i for i, c in enumerate(columns) if c in MACRO_DATE_NAMES), 0)
    value = columns.index("value") if "value" in columns else 1
    if value >= len(columns) or value == date:
        return schemas.empty(raw.sparkSession, schemas.MACRO)
    positions = {"date": date, "value": value}
    constants = {"series": series, "provider": provider}
    for name in constants:
        if name in columns:
            positions[name] = columns.index(name)
    picked = _pick(raw, positions)
    return schemas.conform(
        picked.select(
            to_utc(picked, "date").alias("date"),
            F.upper(_constant_or_carried(picked, "series", series)).alias("series"),
            numeric_column(picked, "value").alias("value"),
            _constant_or_carried(picked, "provider", provider).alias("provider"),
        ).dropna(subset=["date", "value"]),
        schemas.MACRO,
    )
