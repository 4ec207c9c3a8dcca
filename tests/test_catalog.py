"""Registry, requests, freshness, log and events."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marketlake import schemas
from marketlake.operators import catalog, events, quality
from marketlake.operators.universe import all_symbols, symbol_lists, symbol_universe, symbols_of
from tests import samples
from tests.test_functions import expected_hash


def at(text: str):
    return F.lit(text).cast("timestamp")


def registry(spark, rows):
    """Rows of (hash, created_at[, data_type, timeframe, symbol])."""
    full = []
    for hash_, created, *rest in rows:
        data_type, timeframe, symbol = (*rest, *("ohlcv", "1d", "AAPL")[len(rest):])
        uri = f"s3://b/datasets/{data_type}/{symbol}/x_{hash_}_{created}.parquet"
        full.append(("yahoo", data_type, symbol, timeframe, None, None, None, 1, 9, uri, hash_, True, None, datetime.fromisoformat(created)))
    return spark.createDataFrame(full, schemas.REGISTRY)


def test_manifest_and_hashes(spark):
    symbols = spark.createDataFrame([("aapl",), ("MSFT",)], "symbol STRING")
    rows = catalog.request_manifest(symbols, "2023-01-01", "2024-01-01", timeframes=("1d", "1h")).collect()
    assert sorted((r.data_type, r.symbol or r.series, r.timeframe or "") for r in rows) == sorted(
        [("ohlcv", s, t) for s in ("AAPL", "MSFT") for t in ("1d", "1h")]
        + [("news", s, "") for s in ("AAPL", "MSFT")]
        + [("macro", s, "") for s in catalog.DEFAULT_MACRO_SERIES]
    )
    one = next(r for r in rows if r.timeframe == "1h" and r.symbol == "AAPL")
    params = {"provider": "yahoo", "symbol": "AAPL", "timeframe": "1h", "start": "2023-01-01", "end": "2024-01-01"}
    assert one.hash == expected_hash("ohlcv", params)
    assert catalog.request_manifest(symbols, "a", "b", news=False, macro=False).count() == 2


def test_supported_requests(spark):
    rows = [("ohlcv", "1d", None), ("ohlcv", "2d", None), ("ohlcv", None, None), ("news", None, None), ("macro", None, "cpi"), ("macro", None, "M2"), ("x", None, None)]
    ok, rejected = catalog.split_supported(spark.createDataFrame(rows, "data_type STRING, timeframe STRING, series STRING"))
    assert {tuple(r) for r in ok.collect()} == {rows[0], rows[3], rows[4]} and rejected.count() == 4


def test_plan_and_resolve(spark):
    reg = registry(spark, [("h1", "2024-01-01 00:00:00"), ("h2", "2024-01-02 12:00:00", "ohlcv", "1h")])
    requests = spark.createDataFrame(
        [("h1", "ohlcv", "1d"), ("h2", "ohlcv", "1h"), ("h3", "news", None)], "hash STRING, data_type STRING, timeframe STRING"
    )
    todo, done = catalog.plan_ingestion(requests, reg, at("2024-01-01 12:00:00"))
    assert [r.hash for r in todo.collect()] == ["h3"] and {r.hash for r in done.collect()} == {"h1", "h2"}

    def status(now, tombstones=None):
        return {r.hash: r.status for r in catalog.resolve(requests, reg, at(now), tombstones).collect()}

    assert status("2024-01-02 12:59:59") == {"h1": "stale", "h2": "fresh", "h3": "missing"}
    assert status("2024-01-01 23:59:59")["h1"] == "fresh"
    gone = catalog.invalidate(reg, at("2024-01-03"), hashes=reg.where("hash = 'h2'"))
    assert status("2024-01-02 12:30:00", gone)["h2"] == "missing"


def test_versions_and_invalidation(spark):
    reg = registry(
        spark,
        [("h1", "2024-01-01"), ("h1", "2024-01-05"), ("h2", "2024-01-02", "news", None, "MSFT"), ("h3", "2024-01-03", "ohlcv", "1d", "AAP")],
    )
    assert {(r.hash, r.created_at.day) for r in catalog.latest_version(reg).collect()} == {("h1", 5), ("h2", 2), ("h3", 3)}
    assert [r.created_at.day for r in catalog.versions(reg, "h1").collect()] == [5, 1]
    of_symbol = catalog.invalidate(reg, at("2024-01-04"), symbol="aapl")
    assert [r.hash for r in of_symbol.collect()] == ["h1"]
    # The version made after the invalidation is in force.
    assert {r.hash for r in catalog.latest_version(reg, of_symbol).collect()} == {"h1", "h2", "h3"}
    later = catalog.invalidate(reg, at("2024-01-05"), symbol="AAPL")
    assert {r.hash for r in catalog.latest_version(reg, later).collect()} == {"h2", "h3"}
    with pytest.raises(ValueError):
        catalog.invalidate(reg, at("2024-01-05"))


def test_refresh_names_the_dataset_by_its_request(spark):
    requests = spark.createDataFrame([("fundamentals", "aapl")], "data_type STRING, symbol STRING")
    key = expected_hash("fundamentals", {"provider": "yahoo", "symbol": "AAPL"})
    gone = catalog.refresh(registry(spark, [(key, "2024-01-01"), ("x", "2024-01-01")]), requests, at("2024-01-02"))
    assert [r.hash for r in gone.collect()] == [key]


def test_listing(spark):
    reg = registry(spark, [(f"h{i}", f"2024-01-{i + 1:02d}", "news" if i % 2 else "ohlcv") for i in range(9)])
    assert catalog.list_datasets(reg, data_type="news").count() == 4
    assert catalog.list_datasets(reg, symbol="aapl", provider="yahoo").count() == 9
    assert catalog.list_datasets(reg, hash_="h3").count() == 1
    assert [r.hash for r in catalog.page(reg, 3, 2).collect()] == ["h6", "h5", "h4"]
    assert [r.hash for r in catalog.page(reg, 2).collect()] == ["h8", "h7"]
    for bad in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            catalog.page(reg, *bad)
    assert catalog.to_records(reg).where("hash = 'h0'").first().created_at == "2024-01-01T00:00:00+00:00"


def test_freshness(spark):
    reg = registry(spark, [("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-02", "news", None)])
    got = {r.data_type: (r.n_fresh, r.n_stale) for r in catalog.freshness_stats(reg, at("2024-01-02 06:00:00")).collect()}
    assert got == {"ohlcv": (1, 1), "news": (0, 1)}


def test_register_and_log(spark):
    bars = samples.bars(spark)
    summary = quality.summarize(quality.check_bars(samples.bars(spark, open={0: -5.0}), checks=["check_negative_prices"]))
    reg = catalog.register_datasets(bars, "ohlcv", at("2024-02-01"), "s3://b", "2024-01-01", "2024-01-31", summary)
    assert reg.schema.simpleString() == schemas.REGISTRY.simpleString()
    row = reg.first()
    params = {"provider": "yahoo", "symbol": "AAPL", "timeframe": "1d", "start": "2024-01-01", "end": "2024-01-31"}
    assert row.hash == expected_hash("ohlcv", params)
    assert (row.rows, row.columns, row.quality_passed) == (5, 9, False)
    assert row.quality_issues == ["check_negative_prices: 1 rows with open < 0"]
    assert row.storage_uri == f"s3://b/datasets/ohlcv/AAPL/1d/2024/AAPL_1d_20240101_{row.hash[:8]}.parquet"

    fetched = spark.createDataFrame(
        [("AAPL", "1d", "yahoo", 7), ("NONE", "1d", "yahoo", 2)], "symbol STRING, timeframe STRING, provider STRING, rows_fetched BIGINT"
    )
    down = spark.createDataFrame([("DOWN", "1d", "yahoo", "timed out")], "symbol STRING, timeframe STRING, provider STRING, error STRING")
    log = catalog.ingestion_log("ohlcv", fetched, reg, at("2024-02-01"), at("2024-02-01 00:01:00"), down)
    got = {r.symbol: (r.status, r.rows_fetched, r.rows_after_quality, r.error) for r in log.collect()}
    assert got == {
        "AAPL": ("success", 7, 5, None), "NONE": ("failed", 2, None, "no usable rows"), "DOWN": ("failed", None, None, "timed out"),
    }
    kept = {r.symbol: r.storage_uri for r in catalog.lineage(log, reg).collect()}
    assert kept["AAPL"] == row.storage_uri and kept["DOWN"] is None
    assert all(r.storage_uri is None for r in catalog.lineage(log, reg.limit(0)).collect())
    tally = {(r.data_type, r.status): r.n for r in catalog.ingestion_summary(log).collect()}
    assert tally == {("ohlcv", "success"): 1, ("ohlcv", "failed"): 2, ("ohlcv", "all"): 3, ("all", "all"): 3}
    health = catalog.provider_health(log, at("2024-02-01 12:00:00"), seq="rows_fetched").first()
    assert (health.n_attempts, health.n_failed, health.healthy) == (3, 2, True)


def test_events(spark):
    reg = registry(spark, [("h1", "2024-01-01")])
    row = events.ingested_events(reg).first()
    assert row.event == "DatasetIngested"
    payload = json.loads(row.payload)
    assert list(payload) == ["data_type", "symbol", "timeframe", "storage_uri", "hash", "rows"]
    news = registry(spark, [("h2", "2024-01-01", "news", None)])
    assert json.loads(events.ingested_events(news).first().payload)["timeframe"] is None
    resolved = spark.createDataFrame([("h1", None, "fresh"), ("h2", "A", "stale")], "hash STRING, symbol STRING, status STRING")
    served = events.served_events(resolved, at("2024-01-02")).collect()
    assert [json.loads(r.payload) for r in served] == [{"hash": "h1", "symbol": None}]
    parsed = events.parse_events(events.ingested_events(reg)).first()
    assert (parsed.hash, parsed.rows, parsed.error) == ("h1", 1, None)


def test_universe(spark):
    kind = "provider STRING, symbol STRING"
    a = spark.createDataFrame([("yahoo", "B"), ("yahoo", "A"), ("yahoo", "A")], kind)
    b = spark.createDataFrame([("news", "A"), ("news", None)], kind)
    universe = symbol_universe(a, b)
    assert [r.symbol for r in all_symbols(universe).collect()] == ["A", "B"]
    assert [r.symbol for r in symbols_of(universe, "yahoo", ("yahoo", "news")).collect()] == ["A", "B"]
    with pytest.raises(KeyError):
        symbols_of(universe, "x", ("yahoo", "news"))
    lists = {r.provider: r.symbols for r in symbol_lists(universe, buckets=1).collect()}
    assert lists == {"yahoo": ["A", "B"], "news": ["A"]}
