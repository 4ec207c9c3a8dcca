"""Outages: runs of failed attempts without a success or a long pause in between."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from marketlake.operators.series import even_slices

# Failures that open an outage, and the pause (seconds) that forgets them.
FAILURE_THRESHOLD = 5
RESET_SECONDS = 60


def _starts_run(failed: str, at: str, before_failed: str, before_at: str, gap_seconds: int):
    """A run starts where the status changes, or a failure follows the one before after a long pause.

    Null ``before``: nothing precedes, so a run starts.
    """
    pause = F.unix_micros(at) - F.unix_micros(before_at)
    same = (F.col(failed) == F.col(before_failed)) & (~F.col(failed) | (pause <= gap_seconds * 1_000_000))
    return F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)


def outages(
    log: DataFrame,
    keys: Sequence[str] = ("provider", "data_type", "symbol"),
    order: Sequence[str] = (),
    threshold: int = FAILURE_THRESHOLD,
    gap_seconds: int = RESET_SECONDS,
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """Runs of at least ``threshold`` failures: ``(keys…, started_at, ended_at, n_failures)``.

    Gaps and islands in two levels, so that a provider with a third of all attempts is not one task:
    runs are found inside (keys, time slice), then only the runs that touch a slice's edge (at most
    two per slice) are ordered per key and joined up. The slice width comes from the density of the
    log: ``rows_per_slice`` attempts, of all keys, in a slice on average.
    """
    keys = list(keys)
    finished = log.where(F.col("completed_at").isNotNull())
    attempts = finished.select(
        *keys,
        *order,
        F.col("completed_at").alias("at"),
        (F.col("status") == "failed").alias("failed"),
        even_slices(finished, "completed_at", rows_per_slice).alias("slice"),
    )
    so_far = (Window.unboundedPreceding, Window.currentRow)
    in_slice = Window.partitionBy(*keys, "slice").orderBy("at", *order)
    runs = (
        attempts.withColumns(
            {
                "before_failed": F.lag("failed").over(in_slice),
                "before_at": F.lag("at").over(in_slice),
                "last": F.lead("at").over(in_slice).isNull(),
            }
        )
        .withColumn("new", _starts_run("failed", "at", "before_failed", "before_at", gap_seconds))
        .withColumn("run", F.sum("new").over(in_slice.rowsBetween(*so_far)))
        .groupBy(*keys, "slice", "run")
        .agg(
            F.first("failed").alias("failed"),
            F.min("at").alias("started_at"),
            F.max("at").alias("ended_at"),
            F.count("*").alias("n"),
            F.bool_or("last").alias("tail"),
        )
        .withColumn("edge", F.col("tail") | (F.col("run") == 1))
    )
    inner = runs.where("not edge and failed").select(*keys, "started_at", "ended_at", "n")

    over_slices = Window.partitionBy(*keys).orderBy("slice", "run")
    joined = (
        runs.where("edge")
        .withColumns(
            {
                "before_failed": F.lag("failed").over(over_slices),
                "before_at": F.lag("ended_at").over(over_slices),
                "before_slice": F.lag("slice").over(over_slices),
            }
        )
        # The two edge runs of one slice are apart already.
        .withColumn(
            "new",
            F.when(F.col("before_slice") == F.col("slice"), 1).otherwise(
                _starts_run("failed", "started_at", "before_failed", "before_at", gap_seconds)
            ),
        )
        .withColumn("run", F.sum("new").over(over_slices.rowsBetween(*so_far)))
        .groupBy(*keys, "run")
        .agg(
            F.first("failed").alias("failed"),
            F.min("started_at").alias("started_at"),
            F.max("ended_at").alias("ended_at"),
            F.sum("n").alias("n"),
        )
        .where("failed")
        .select(*keys, "started_at", "ended_at", "n")
    )
    return (
        inner.unionByName(joined)
        .where(F.col("n") >= threshold)
        .withColumnRenamed("n", "n_failures")
    )
