"""The event log: what happened to datasets, as appendable rows with a JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The event kinds.
INGESTED = "DatasetIngested"
SERVED = "DatasetServedFromCache"
FAILED = "IngestionFailed"

PAYLOAD = "data_type STRING, symbol STRING, timeframe STRING, storage_uri STRING, hash STRING, rows BIGINT, error STRING"


def _event(kind: str, payload: Column, at: Column, rows: DataFrame) -> DataFrame:
    text = F.to_json(payload, {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("event"), text.alias("payload"), at.cast("timestamp").alias("published_at"))


def ingested_events(registry: DataFrame, at: Column | None = None) -> DataFrame:
    payload = F.struct("data_type", "symbol", "timeframe", "storage_uri", "hash", "rows")
    return _event(INGESTED, payload, F.col("created_at") if at is None else at, registry)


def served_events(resolved: DataFrame, at: Column) -> DataFrame:
    """For requests that :func:`catalog.resolve` found fresh."""
    return _event(SERVED, F.struct("hash", "symbol"), at, resolved.where("status = 'fresh'"))


def failed_events(log: DataFrame) -> DataFrame:
    payload = F.struct("data_type", "symbol", "error")
    return _event(FAILED, payload, F.col("completed_at"), log.where("status = 'failed'"))


def parse_events(events: DataFrame) -> DataFrame:
    """Event rows with the payload's fields as columns; works on a table and on a stream."""
    return events.withColumn("p", F.from_json("payload", PAYLOAD)).select("event", "published_at", "p.*")


def event_counts(parsed: DataFrame, window: str = "1 day") -> DataFrame:
    """Events per time window, kind and data type."""
    return (
        parsed.groupBy(F.window("published_at", window).alias("w"), "event", "data_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event", "data_type", "n")
    )
