"""Spike alerts of all four prices across micro-batches."""

from __future__ import annotations

from marketlake import schemas
from marketlake.plans import feed_queries
from marketlake.streaming import alerts
from tests.compare import compare, connect


def test_a_jump_of_any_price_alerts(spark, folder):
    # Per bar: open, high, low, close; one price each leaves the prior close of 100 by over a fifth.
    prices = [(100, 100, 100, 100), (125, 100, 100, 100), (100, 125, 100, 100), (100, 100, 75, 100), (100, 100, 100, 125), (125, 125, 125, 125)]
    rows = [("A", "1d", "p", k, *map(float, p)) for k, p in enumerate(prices)]
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, provider string, day int, open double, high double, low double, close double")
    bars = bars.selectExpr("symbol", "timeframe", "provider", "timestamp_seconds(86400L * day) AS timestamp", *schemas.PRICES)
    stream = feed_queries.in_files(bars, f"{folder}/in", "timestamp")
    got = feed_queries._stateful(spark, alerts.spike_alerts(stream, prices=schemas.PRICES), "append")
    assert sorted(r.timestamp.day for r in got.collect()) == [2, 3, 4, 5]


def test_query_equals_its_sql(spark, sf):
    name = "stream_price_spikes"
    assert compare(spark, connect(sf), feed_queries.QUERIES[name], feed_queries.ORACLES[name], sf) is None
