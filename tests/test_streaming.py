"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marketlake.operators import events, quality
from marketlake.operators.outages import outages
from marketlake.operators.resample import resample_bars
from marketlake.operators.series import dedup_bars, with_prior_close
from marketlake.plans import views
from marketlake.sinks.store import write_catalog
from marketlake.sources.lake import current_rows, read_canonical, read_catalog
from marketlake.streaming import alerts, bars as bar_streams, events as event_streams
from marketlake.streaming.ingest import ingest_stream
from tests import samples


def in_files(df, path: str, order: str, files: int = 4):
    """Write ``df`` as files that arrive one after the other in the given order."""
    bounds = df.approxQuantile(order, [i / files for i in range(1, files)], 0)
    lows, highs = [float("-inf"), *bounds], [*bounds, float("inf")]
    for i, (lo, hi) in enumerate(zip(lows, highs)):
        part = df.where((F.col(order) > lo) & (F.col(order) <= hi)).drop(order).coalesce(1)
        part.write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and os.path.getmtime(f"{path}/{name}") > 1_000_000_000:
                os.utime(f"{path}/{name}", (1_000_000 + i, 1_000_000 + i))
    return df.drop(order)


def stream(spark, path: str, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name: str, mode: str, checkpoint: str):
    query = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    return df.sparkSession.table(name)


def same(a, b) -> None:
    b = b.select(a.columns)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_tumbling_bars_equal_resampled_bars(spark, sf, folder):
    ticks = in_files(views.ticks(spark, sf).withColumn("o", F.unix_micros("ts")), f"{folder}/in", "o")
    out = bar_streams.tumbling_bars(stream(spark, f"{folder}/in", ticks.schema), "1w", "yahoo", delay="0 seconds")
    got = drain(out, "tumbling", "append", f"{folder}/c")
    # The last week stays open: no later tick moves the watermark past its end.
    expected = resample_bars(ticks, "1w", "yahoo").where(F.col("timestamp") < "2024-01-29")
    same(got, expected)


def test_month_bars_cannot_be_streamed(spark, sf):
    with pytest.raises(ValueError, match="cannot be streamed"):
        bar_streams.tumbling_bars(views.ticks(spark, sf), "1m", "yahoo")


def test_first_by_seq_equals_batch_dedup(spark, sf, folder):
    bars = in_files(views.typed_bars(spark, sf).withColumn("o", F.col("seq")), f"{folder}/in", "o")
    out = bar_streams.first_by_seq(stream(spark, f"{folder}/in", bars.schema), delay="1 hour")
    got = drain(out, "firsts", "append", f"{folder}/c")
    last = got.agg(F.max("timestamp")).first()[0]
    same(got, dedup_bars(bars).where(F.col("timestamp") <= last))


def test_first_arrivals_pass_once(spark, sf, folder):
    bars = in_files(views.typed_bars(spark, sf).withColumn("o", F.col("seq")), f"{folder}/in", "o")
    got = drain(
        bar_streams.first_arrivals(stream(spark, f"{folder}/in", bars.schema)), "arrivals", "append", f"{folder}/c"
    )
    keys = ["symbol", "timeframe", "provider", "timestamp"]
    assert got.count() == bars.select(keys).distinct().count() == got.select(keys).distinct().count()
    assert got.exceptAll(bars).count() == 0


def test_outage_alerts_end_as_batch_outages(spark, sf, folder):
    log = in_files(views.attempts(spark, sf).withColumn("o", F.unix_micros("completed_at")), f"{folder}/in", "o")
    out = alerts.outage_alerts(stream(spark, f"{folder}/in", log.schema), keys=["provider"], gap_seconds=43_200)
    seen = drain(out, "outages", "update", f"{folder}/c")
    final = seen.groupBy("provider", "started_at").agg(
        F.max("ended_at").alias("ended_at"), F.max("n_failures").alias("n_failures")
    )
    same(final, outages(log, keys=["provider"], order=["log_id"], gap_seconds=43_200))


def test_spike_alerts_equal_batch_spikes(spark, sf, folder):
    bars = views.bars(spark, sf, "1d")
    in_files(bars.withColumn("o", F.unix_micros("timestamp")), f"{folder}/in", "o")
    got = drain(alerts.spike_alerts(stream(spark, f"{folder}/in", bars.schema)), "spikes", "append", f"{folder}/c")
    moved = quality.abs_pct_change(F.col("close"), F.col("prior_close")) > quality.SPIKE_THRESHOLD
    same(got, with_prior_close(bars).where(moved))


def test_event_stream_counts(spark, sf, folder):
    rows = events.ingested_events(views.registry(spark, sf)).unionByName(
        events.failed_events(views.attempts(spark, sf))
    )
    write_catalog(rows, "events", folder, "r1")
    parsed = event_streams.read_events(spark, folder)
    got = drain(event_streams.running_counts(parsed), "counts", "update", f"{folder}/c")
    newest = got.groupBy("window_start", "event", "data_type").agg(F.max("n").alias("n"))
    same(newest, events.event_counts(events.parse_events(rows)))
    failed = drain(event_streams.of_kind(parsed, events.FAILED), "failed", "append", f"{folder}/c2")
    assert failed.count() == rows.where(F.col("event") == events.FAILED).count()


def test_ingest_stream_stores_every_batch(spark, folder):
    raw = samples.raw_bars(spark, 8).select(
        "*", F.lit("AAPL").alias("symbol"), F.lit("1d").alias("timeframe"), F.lit("yahoo").alias("provider")
    )
    in_files(raw.withColumn("o", F.col("seq")), f"{folder}/in", "o", files=2)
    query = ingest_stream(stream(spark, f"{folder}/in", raw.schema), "ohlcv", f"{folder}/lake", f"{folder}/c")
    assert query.awaitTermination(240)
    assert query.exception() is None
    registry = read_catalog(spark, f"{folder}/lake", "registry")
    assert sorted(r.rows for r in registry.collect()) == [4, 4]
    stored = read_canonical(spark, f"{folder}/lake", "ohlcv")
    assert current_rows(stored, registry).count() == 8
    log = read_catalog(spark, f"{folder}/lake", "ingestion_log")
    assert [(r.status, r.rows_fetched, r.rows_after_quality) for r in log.collect()] == [("success", 4, 4)] * 2
