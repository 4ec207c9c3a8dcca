"""The event sink takes every micro-batch once."""

from __future__ import annotations

import os
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from marketlake.sinks.event_sink import _EventWriter, append_events, committed_batches
from marketlake.sources.lake import read_catalog

KIND = "event STRING, payload STRING, published_at TIMESTAMP"


def batch(n, first=0):
    at = [datetime(2024, 1, 1)] * n
    return pa.RecordBatch.from_pydict({"event": [f"e{first + i}" for i in range(n)], "payload": ["{}"] * n, "published_at": pa.array(at, pa.timestamp("us", "UTC"))})


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_a_batch_that_comes_again_adds_nothing(folder):
    sink = _EventWriter({"path": folder, "app": "a"})
    sink.commit([sink.write(iter([batch(3)])), sink.write(iter([])), None], 0)
    before = files(folder)
    assert before == ["_committed/run=a-000000000000.json", "run=a-000000000000/part-00000.parquet"]
    sink.commit([sink.write(iter([batch(3)]))], 0)
    assert files(folder) == before
    sink.commit([sink.write(iter([batch(2), batch(2, 2)]))], 1)
    assert pq.read_table(f"{folder}/run=a-000000000001/part-00000.parquet").num_rows == 4


def test_an_aborted_batch_and_a_commit_that_broke_off_leave_nothing(folder):
    sink = _EventWriter({"path": folder, "app": "a"})
    sink.abort([sink.write(iter([batch(3)])), None], 0)
    assert files(folder) == []
    sink.commit([sink.write(iter([batch(3)]))], 0)
    os.remove(f"{folder}/_committed/run=a-000000000000.json")  # as if it had broken off before its mark
    sink.commit([sink.write(iter([batch(2)]))], 0)
    assert pq.read_table(f"{folder}/run=a-000000000000").num_rows == 2


def test_a_query_that_starts_over(spark, folder):
    rows = [(f"e{i}", "{}", datetime(2024, 1, 1, i)) for i in range(6)]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for turn in ("c1", "c2", "c2"):
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        append_events(stream, f"{folder}/lake", "feed", f"{folder}/{turn}").awaitTermination()
    assert sorted(tuple(r) for r in read_catalog(spark, f"{folder}/lake", "events").collect()) == rows
    assert {(r.batch, r.files, r.rows) for r in committed_batches(spark, f"{folder}/lake").collect()} == {(f"feed-{k:012d}", 1, 2) for k in range(3)}
    # Another application counts for itself.
    append_events(spark.readStream.schema(KIND).parquet(f"{folder}/in"), f"{folder}/lake", "other", f"{folder}/c3").awaitTermination()
    assert read_catalog(spark, f"{folder}/lake", "events").count() == 12
