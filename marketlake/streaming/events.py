"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake import schemas
from marketlake.operators import events
from marketlake.sinks.store import table_path


def read_events(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """New rows of the stored event log, with the payload's fields as columns."""
    stored = (
        spark.readStream.schema(schemas.EVENTS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(table_path(root, "events"))
    )
    return events.parse_events(stored)


def of_kind(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where(F.col("event") == kind)


def running_counts(parsed: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts per window, kind and data type; for update mode, or append once a window is over."""
    return (
        parsed.withWatermark("published_at", delay)
        .groupBy(F.window("published_at", window).alias("w"), "event", "data_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event", "data_type", "n")
    )
