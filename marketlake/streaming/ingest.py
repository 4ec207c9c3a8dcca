"""Continuous ingestion: every micro-batch goes through the same run as a batch feed."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marketlake.plans.ingest import Request, ingest


def ingest_stream(
    raw: DataFrame,
    data_type: str,
    root: str,
    checkpoint: str,
    calendar: DataFrame | None = None,
    layout: str = "symbol",
    **trigger,
) -> StreamingQuery:
    """Store, check, register, log and announce every micro-batch of a raw feed.

    A micro-batch is a dataset of its own: its run name stands where a request has its range. The run
    is named after the batch id, so a batch that Spark replays replaces its own files and no others.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id:012d}"
        ingest(batch, Request(data_type, root, name, datetime.now(timezone.utc), start=name, layout=layout), calendar)

    return (
        raw.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
