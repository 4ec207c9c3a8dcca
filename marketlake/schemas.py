"""Fixed schemas of the canonical tables, the catalog tables and the event log.

Times are UTC; the session time zone must be UTC (see :func:`marketlake.session.configure`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def struct(**columns: str | T.DataType) -> T.StructType:
    """A schema of nullable columns, by Spark's short type names."""
    schema = T.StructType()
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


BARS = struct(
    timestamp="timestamp", open="double", high="double", low="double", close="double", volume="double",
    symbol="string", timeframe="string", provider="string",
)
NEWS = struct(
    headline="string", published_at="timestamp", source="string", url="string", symbol="string", provider="string"
)
FUNDAMENTALS = struct(
    symbol="string", as_of="timestamp", pe_ratio="double", pb_ratio="double", revenue_growth="double",
    earnings_surprise="double", market_cap="double", eps="double", provider="string",
)
MACRO = struct(date="timestamp", series="string", value="double", provider="string")

_TEXTS = T.ArrayType(T.StringType())
REGISTRY = struct(
    provider="string", data_type="string", symbol="string", timeframe="string", series="string",
    start_date="string", end_date="string", rows="long", columns="integer", storage_uri="string", hash="string",
    quality_passed="boolean", quality_issues=_TEXTS, created_at="timestamp",
)
TOMBSTONES = struct(hash="string", invalidated_at="timestamp")
INGESTION_LOG = struct(
    hash="string", created_at="timestamp", provider="string", data_type="string", symbol="string",
    started_at="timestamp", completed_at="timestamp", status="string", rows_fetched="long",
    rows_after_quality="long", issues=_TEXTS, error="string",
)
EVENTS = struct(event="string", payload="string", published_at="timestamp")

#: Records of a feed that could not be taken in, and why.
REJECTS = struct(
    data_type="string", provider="string", symbol="string", series="string", record="string", reason="string", rejected_at="timestamp"
)

#: The days that a version covers: one bit per day, of 32,768 days from ``bucket`` on.
COVERAGE = struct(
    hash="string", created_at="timestamp", provider="string", data_type="string", symbol="string", timeframe="string", series="string",
    bucket="long", first_day="date", last_day="date", days="binary",
)

#: One row per run that a commit added to a table, or replaced by another.
RUN_CHANGES = struct(run="string", state="string", by="string", made_at="timestamp")

CANONICAL = {"ohlcv": BARS, "news": NEWS, "fundamentals": FUNDAMENTALS, "macro": MACRO}

PRICES = ("open", "high", "low", "close")
METRICS = ("pe_ratio", "pb_ratio", "revenue_growth", "earnings_surprise", "market_cap", "eps")

#: What identifies one series inside a table that holds many of them.
SERIES_KEYS = {
    "ohlcv": ("symbol", "timeframe", "provider"),
    "news": ("symbol", "provider"),
    "fundamentals": ("symbol", "provider"),
    "macro": ("series", "provider"),
}
TIME_COLUMN = {"ohlcv": "timestamp", "news": "published_at", "fundamentals": "as_of", "macro": "date"}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the schema's columns and types, in its order."""
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields))
