"""The feed of the ingesting stream: several files for each micro-batch, which has whole symbols."""

from __future__ import annotations

import pathlib

from pyspark.sql import functions as F

from marketlake.functions import iso_seconds
from marketlake.plans import lake_queries, views


def test_a_micro_batch_is_several_files(spark, sf, folder, monkeypatch):
    events = views.table(spark, sf, "events")
    more = spark.range(6).crossJoin(events).withColumn("event_id", F.col("event_id") + 100_000 * F.col("id"))
    more.select(*events.columns).write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(lake_queries, "FILE_ROWS", 1_000, raising=False)
    monkeypatch.setattr(lake_queries, "shared_folder", lambda _: f"{folder}/run")
    got = lake_queries.ingest_stream_bars(spark, folder)
    files = len(list(pathlib.Path(f"{folder}/run/feed").glob("*.parquet")))
    assert files > 4 and files % 4 == 0
    want = views.canonical_bars(spark, folder)
    want = want.withColumn("timestamp", iso_seconds(want.timestamp)).select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
