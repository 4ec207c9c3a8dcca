"""Calendar windows, late rows and unordered attempts in streams, against the batch operators on the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlake.operators.outages import outages
from marketlake.operators.resample import resample_bars
from marketlake.plans.feed_queries import in_batches, in_files
from marketlake.streaming import alerts, windows
from marketlake.streaming.lineage import lineage_stream
from tests.test_streaming import same

TICK = "symbol STRING, ts TIMESTAMP, seq LONG, price DOUBLE"
FAR = datetime(2100, 1, 1)


def far(spark):
    return spark.createDataFrame([("~", FAR, 0, 0.0)], TICK)


def bars(spark, ticks, timeframe, delay="30 days", batch=None):
    build = lambda s: windows.bars_and_late_ticks(s, timeframe, delay)
    batch = F.col("seq") % 3 if batch is None else batch
    return in_batches(spark, ticks, batch.cast("int"), far(spark), build)


def test_every_timeframe_equals_the_batch(spark):
    at = datetime(2023, 12, 27, 23, 50)
    rows = [("A" if i % 3 else "B", at + timedelta(minutes=7 * i), None if i % 11 == 0 else i, None if i % 13 == 0 else float(i * 37 % 101)) for i in range(800)]
    rows += [("A", None, 1, 1.0), ("A", datetime(2024, 2, 29, 23, 59, 59, 999_999), 5, float("nan")), ("A", datetime(2024, 3, 1), 6, 2.0)]
    ticks = spark.createDataFrame(rows, TICK)
    for timeframe in ("15m", "1w", "1m"):
        found = bars(spark, ticks, timeframe, "400 days", F.coalesce(F.col("seq"), F.lit(0)) % 2)
        assert windows.late_ticks(found).count() == 0
        same(windows.closed_bars(found, timeframe, "yahoo"), resample_bars(ticks, timeframe, "yahoo"))


def test_bars_and_late_ticks_are_the_input(spark):
    day = datetime(2024, 1, 1)
    # Batch 1 sends a tick of each of the days before: those that the watermark of batch 0 has passed are late.
    rows = [("A", day + timedelta(days=d, hours=1), d, float(d)) for d in range(10)] + [("A", day + timedelta(days=d, hours=2), 100 + d, 0.5) for d in range(10)]
    rows += [("A", day + timedelta(days=3, hours=3), None, 7.0)] * 2
    ticks = spark.createDataFrame(rows, TICK)
    batch = (F.coalesce(F.col("seq"), F.lit(100)) >= 100).cast("int")
    found = bars(spark, ticks, "1d", "2 days", batch).cache()
    # The watermark stands at the 8th, 01:00.
    late = sorted((r.ts, r.seq is None, r.seq, r.price) for r in windows.late_ticks(found).collect())
    want = [(t, s is None, s, p) for _, t, s, p in rows if (s is None or s >= 100) and t.replace(hour=0) + timedelta(days=1) <= datetime(2024, 1, 8, 1)]
    assert late == sorted(want)
    closed = windows.closed_bars(found, "1d", "p")
    assert closed.agg(F.sum("volume")).first()[0] + len(late) == len(rows) and closed.count() == 10
    assert {r.timestamp.day: (r.open, r.close, r.high, r.low, r.volume) for r in closed.collect()}[9] == (8.0, 0.5, 8.0, 0.5, 2.0)


def test_an_empty_input_and_rows_without_a_time(spark, folder):
    ticks = spark.createDataFrame([], TICK)
    assert windows.closed_bars(bars(spark, ticks, "1m"), "1m", "p").count() == 0
    rows = spark.createDataFrame([("A", None if i % 4 == 0 else datetime(2024, 1, 1) + timedelta(hours=i), i, 1.0) for i in range(40)], TICK)
    stream = in_files(rows, f"{folder}/in", "ts")
    query = stream.writeStream.format("memory").queryName("timeless").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    same(spark.table("timeless"), rows)


def test_ticks_come_to_the_state_a_row_per_bar():
    rng, none = np.random.default_rng(6), windows._NO_SEQ
    n = 5_000
    rows = [(None if k == 2 else "AB"[k], int(s) * 100, int(s) * 100 + 100, int(at), float(p), int(q)) for k, s, at, p, q in zip(
        rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 50, n), rng.choice([np.nan, 1.0, 2.0, 3.0], n, p=[0.001, 0.333, 0.333, 0.333]), rng.permutation(n))]
    rows += [("C", 0, 100, 7, np.nan, none), ("C", 0, 100, 7, np.nan, 3)]
    names = ("symbol", "start", "end", "at", "price", "seq")
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list(names))
    (got,) = windows._packed(iter([batch, batch.slice(0, 0)]))
    assert got.num_rows == 13
    for r in got.to_pylist():
        own = sorted((row[3:] for row in rows if row[:3] == (r["symbol"], r["start"], r["end"])), key=lambda t: (t[0], t[2]))
        prices = [p for _, p, _ in own if p == p]
        fold = [r[c] for c in ("n", "first_at", "first_seq", "open", "last_at", "last_seq", "close", "high", "low")]
        high = max(prices) if len(prices) == len(own) else np.nan
        want = [len(own), own[0][0], own[0][2], own[0][1], own[-1][0], own[-1][2], own[-1][1], high, min(prices, default=np.nan)]
        assert repr(list(map(float, fold))) == repr(list(map(float, want)))
        assert [(int(t["at"]), repr(float(t["price"])), int(t["seq"])) for t in np.frombuffer(r["ticks"], windows._TICK)] == [(a, repr(p), q) for a, p, q in own]


LOG = "provider STRING, completed_at TIMESTAMP, log_id LONG, status STRING"


def stream_outages(spark, log, batch, delay="30 days", **how):
    closing = spark.createDataFrame([("~", FAR, 0, "success")], LOG)
    build = lambda s: alerts.unordered_outages(s, ["provider"], "log_id", delay, **how)
    return in_batches(spark, log, batch.cast("int"), closing, build)


def test_attempts_in_any_order_give_the_batch_outages(spark):
    rng, at = np.random.default_rng(4), datetime(2024, 1, 1)
    rows = []
    for provider in "PQR":
        moments = np.cumsum(rng.choice([0, 1, 20, 59, 60, 61, 500], 300))
        rows += [(provider, at + timedelta(seconds=int(m)), i, "failed" if rng.random() < 0.85 else "success") for i, m in enumerate(moments)]
    log = spark.createDataFrame([*rows, ("P", None, 1, "failed")], LOG)
    found = stream_outages(spark, log, F.crc32(F.concat("provider", F.col("log_id").cast("string")).cast("binary")) % 3, threshold=3)
    assert found.where("kind = 'late'").count() == 0
    want = outages(log, ["provider"], ["log_id"], threshold=3)
    same(found.drop("kind"), want)


def test_late_attempts_come_out_and_runs_end_at_the_gap(spark):
    at = datetime(2024, 1, 1)
    rows = [("P", at + timedelta(seconds=10 * i), i, "failed") for i in range(6)] + [("Q", at + timedelta(hours=5), 50, "success")]
    # Batch 1: two attempts of P an hour before the watermark, and one that starts a run of its own.
    rows += [("P", at + timedelta(seconds=5 + i), 100 + i, "failed") for i in range(2)] + [("P", at + timedelta(hours=6), 110, "failed")]
    found = stream_outages(spark, spark.createDataFrame(rows, LOG), (F.col("log_id") >= 100), "1 hour").collect()
    told = sorted((r.kind, r.started_at, r.ended_at, r.n_failures) for r in found)
    late = [("late", at + timedelta(seconds=5 + i), at + timedelta(seconds=5 + i), None) for i in range(2)]
    assert told == [*late, ("outage", at, at + timedelta(seconds=50), 6)]


def test_lineage_of_streams(spark, folder):
    day = datetime(2024, 1, 1)
    log = "hash STRING, created_at TIMESTAMP, status STRING"
    reg = "hash STRING, created_at TIMESTAMP, storage_uri STRING, rows LONG, quality_passed BOOLEAN"
    steps = [
        ([("a", day, "success"), ("b", day, "success"), (None, None, "failed")], [("c", day, "u0", 1, True)]),
        ([("c", day, "success")], [("a", day, "u1", 2, True), ("b", day + timedelta(hours=1), "u2", 3, False)]),
        ([("~", FAR, "success")], [("~", FAR, "far", 0, True)]),
    ]
    seen = []
    for logs, regs in steps:
        spark.createDataFrame(logs, log).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        spark.createDataFrame(regs, reg).coalesce(1).write.mode("append").parquet(f"{folder}/reg")
        streams = (spark.readStream.schema(s).parquet(f"{folder}/{n}") for n, s in (("log", log), ("reg", reg)))
        query = lineage_stream(*streams).writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect()))
        query.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(repr, (r for r in seen if r[0] != "~"))) == sorted(map(repr, [
        (None, None, "failed", None, None, None), ("a", day, "success", "u1", 2, True), ("c", day, "success", "u0", 1, True), ("b", day, "success", None, None, None),
    ]))
