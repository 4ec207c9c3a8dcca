"""Sources, sinks, reads and the ingestion run."""

from __future__ import annotations

import json
import os
from datetime import date, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlake import schemas
from marketlake.operators import catalog
from marketlake.operators.calendar import weekday_calendar
from marketlake.operators.normalize import normalize_bars
from marketlake.operators.reads import get_bars, get_macro, get_news, latest_fundamentals
from marketlake.plans.ingest import Request, ingest
from marketlake.sinks import store
from marketlake.sinks.store import compact, expire, run_path, write_canonical
from marketlake.sources import feeds, lake, providers
from tests import samples

NOW = datetime(2024, 2, 1, 12)


def feed(spark, n=5, symbols=("AAPL", "MSFT")):
    names = spark.createDataFrame([(s,) for s in symbols], "symbol STRING")
    keyed = samples.raw_bars(spark, n).crossJoin(names)
    return keyed.select("*", F.lit("1d").alias("timeframe"), F.lit("yahoo").alias("provider"))


class TestFeeds:
    @pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
    def test_raw_bars_from_files(self, spark, folder, fmt):
        text = feed(spark).select([F.col(f.name).cast(f.dataType) for f in feeds.RAW_BARS])
        text.write.format(fmt).options(header="true").save(f"{folder}/raw")
        got = feeds.read_raw_bars(spark, f"{folder}/raw", fmt)
        assert got.schema.simpleString() == feeds.RAW_BARS.simpleString()
        assert got.exceptAll(text).count() == 0 and got.count() == 10

    def responses(self, spark, articles, **more):
        body = json.dumps({"status": "ok", "articles": articles})
        return spark.createDataFrame([("AAPL", body, *more.values())], ", ".join(f"{c} STRING" for c in ("symbol", "body", *more)))

    def test_news_json(self, spark):
        articles = [
            {"title": "a", "publishedAt": "2024-01-02T14:30:00Z", "source": {"id": None, "name": "R"}, "url": "u1"},
            {"title": None, "publishedAt": "2024-01-03T14:30:00+05:00", "source": None, "url": "u2"},
            {"title": "c", "publishedAt": None, "url": "u3"},
            {"title": "d", "publishedAt": "soon", "url": "u4"},
        ]
        rows = {r.url: r for r in feeds.parse_news_json(self.responses(spark, articles)).collect()}
        assert set(rows) == {"u1", "u2"}
        assert (rows["u1"].headline, rows["u1"].source, rows["u1"].published_at) == ("a", "R", datetime(2024, 1, 2, 14, 30))
        assert (rows["u2"].headline, rows["u2"].source, rows["u2"].published_at) == ("", None, datetime(2024, 1, 3, 9, 30))

    def test_news_json_keeps_all_of_all_responses_of_the_language(self, spark):
        articles = [{"title": str(i), "publishedAt": f"2024-01-01T{i:02d}:00:00Z", "url": str(i)} for i in range(24)]
        one = self.responses(spark, articles * 6, language="en")
        assert feeds.parse_news_json(one.unionAll(one)).count() == 288
        assert feeds.parse_news_json(self.responses(spark, articles, language="de")).count() == 0
        assert feeds.parse_news_json(self.responses(spark, articles, language="de"), language=None).count() == 24

    def test_rss_files(self, spark, folder):
        items = "".join(
            f"<item><title>t{i} &amp; more</title><link>l{i}</link><pubDate>{d}</pubDate></item>"
            for i, d in enumerate(
                ["Tue, 02 Jan 2024 00:00:00 +0000", "Wed, 03 Jan 2024 23:59:59 GMT", "Thu, 04 Jan 2024 00:00:00 +0000", "someday"]
            )
        )
        with open(f"{folder}/feed.xml", "w") as f:
            f.write(f"<rss><channel>{items}</channel></rss>")
        raw = feeds.read_news_rss(spark, f"{folder}/feed.xml").withColumn("symbol", F.lit("AAPL"))
        rows = feeds.parse_rss_items(raw, "2024-01-02", "2024-01-03").orderBy("url").collect()
        assert [(r.url, r.headline, r.source) for r in rows] == [
            ("l0", "t0 & more", "Yahoo Finance"), ("l1", "t1 & more", "Yahoo Finance"),
        ]

    def test_prefer_source(self, spark):
        kind = "symbol STRING, headline STRING"
        primary = spark.createDataFrame([("A", "p1"), ("A", "p2")], kind)
        fallback = spark.createDataFrame([("A", "f1"), ("B", "f2")], kind)
        assert sorted(r.headline for r in feeds.prefer_source(primary, fallback).collect()) == ["f2", "p1", "p2"]

    def test_fundamentals_json(self, spark):
        body = json.dumps({"trailingPE": 17.25, "marketCap": 64000000000, "other": {"x": 1}})
        df = spark.createDataFrame([("AAPL", body)], "symbol STRING, body STRING")
        row = feeds.parse_fundamentals_json(df, F.lit("2024-01-02 10:00:00")).first()
        assert (row.pe_ratio, row.market_cap, row.eps, row.as_of) == ("17.25", "64000000000", None, "2024-01-02")

    def test_macro_names(self, spark):
        raw = spark.createDataFrame(
            [("CPIAUCSL", "2023-01-01", "1"), ("UNRATE", "2023-01-01", None), ("X", "2023-01-01", "2"), ("X", "2023-02-01", "3")],
            "series_id STRING, date STRING, value STRING",
        )
        assert [tuple(r) for r in feeds.name_macro_series(raw).collect()] == [("2023-01-01", "CPI", "1")]
        assert [tuple(r) for r in feeds.unknown_macro_series(raw).collect()] == [("X", 2)]


class TestReads:
    def test_bars_inclusive_and_end_is_midnight(self, spark):
        bars = samples.bars(spark, 5, timestamp={2: datetime(2024, 1, 4, 9)})
        rows = get_bars(bars, "aapl", "1d", "2024-01-02", "2024-01-04").collect()
        assert [r.timestamp for r in rows] == ["2024-01-02T00:00:00", "2024-01-03T00:00:00"]
        assert list(rows[0].asDict()) == ["timestamp", "open", "high", "low", "close", "volume"]
        typed = get_bars(bars, "AAPL", start="2024-01-02", end="2024-01-03", typed=True)
        assert [r.timestamp for r in typed.collect()] == [datetime(2024, 1, 2), datetime(2024, 1, 3)]

    def test_bars_of_many_symbols_nan_and_empty(self, spark):
        both = samples.bars(spark, 2, volume={0: float("nan")}).unionAll(samples.bars(spark, 2).withColumn("symbol", F.lit("MSFT")))
        rows = get_bars(both, ["AAPL", "MSFT"]).collect()
        assert [r.symbol for r in rows] == ["AAPL", "AAPL", "MSFT", "MSFT"] and rows[0].volume is None
        assert get_bars(both, "NONE").count() == 0
        with pytest.raises(ValueError, match="no 1d bars"):
            get_bars(both, "NONE", require_rows=True)

    def test_news_end_day(self, spark):
        moments = [datetime(2024, 1, 2), datetime(2024, 1, 3, 23, 59, 59), datetime(2024, 1, 3, 23, 59, 59, 500_000), datetime(2024, 1, 4)]
        news = spark.createDataFrame([(str(i), m, None, None, "AAPL", "news") for i, m in enumerate(moments)], schemas.NEWS)
        rows = get_news(news, "AAPL", "2024-01-02", "2024-01-03").collect()
        assert [(r.headline, r.published_at) for r in rows] == [("0", "2024-01-02T00:00:00Z"), ("1", "2024-01-03T23:59:59Z")]
        assert list(rows[0].asDict()) == ["headline", "published_at", "source", "url", "symbol"]

    def test_latest_fundamentals(self, spark):
        rows = [("A", datetime(2024, 1, d, h), *[float(d)] * 6, "yahoo", d * 10 + h) for d, h in ((1, 0), (3, 0), (3, 5), (2, 0))]
        df = spark.createDataFrame(rows, schemas.struct(**{f.name: f.dataType for f in schemas.FUNDAMENTALS}, seq="long"))
        row = latest_fundamentals(df, "seq").first()
        assert (row.as_of, row.pe_ratio) == ("2024-01-03", 3.0)
        assert latest_fundamentals(df, typed=True).first().as_of == datetime(2024, 1, 3, 5)
        assert list(row.asDict()) == ["symbol", *schemas.METRICS, "as_of"]

    def test_macro(self, spark):
        rows = [(datetime(2023, m, 1), "CPI", float(m), "fred") for m in (3, 1, 2)]
        macro = spark.createDataFrame(rows, schemas.MACRO)
        got = get_macro(macro, "cpi", "2023-01-01", "2023-02-01").collect()
        assert [tuple(r) for r in got] == [("2023-01-01", "CPI", 1.0), ("2023-02-01", "CPI", 2.0)]
        with pytest.raises(ValueError, match="unsupported series"):
            get_macro(macro, "M2")


class TestStore:
    @pytest.mark.parametrize("layout", ["symbol", "bucket"])
    def test_round_trip_and_pruning(self, spark, folder, layout):
        bars = samples.bars(spark, 5).unionAll(samples.bars(spark, 5).withColumn("symbol", F.lit("007")))
        old = bars.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 1 YEAR"))
        both = bars.unionAll(old)
        write_canonical(both, "ohlcv", folder, "r1", F.lit(NOW), layout=layout)
        stored = lake.read_canonical(spark, folder, "ohlcv")
        back = stored.select(schemas.BARS.fieldNames())
        assert back.exceptAll(both).count() == 0 and both.exceptAll(back).count() == 0
        one = lake.read_canonical(spark, folder, "ohlcv", ["aapl"], "2024-01-01", "2024-12-31")
        read = get_bars(one, "AAPL", "1d", "2024-01-02", "2024-01-04")
        assert read.count() == 3
        plan = read._jdf.queryExecution().executedPlan().toString()
        folders = plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
        pushed = plan.split("PushedFilters:")[1].split("ReadSchema:")[0]
        assert "year" in folders and ("symbol" if layout == "symbol" else "symbol_bucket") in folders and "timeframe" in folders
        assert "GreaterThanOrEqual(timestamp" in pushed and "LessThanOrEqual(timestamp" in pushed
        assert "provider" not in plan.split("ReadSchema:")[1]

    def test_layout_on_disk(self, spark, folder):
        write_canonical(samples.bars(spark), "ohlcv", folder, "r1", F.lit(NOW))
        path = f"{folder}/datasets/ohlcv/run=r1/symbol=AAPL/timeframe=1d/year=2024"
        files = [f for f in os.listdir(path) if f.endswith(".parquet")]
        assert len(files) == 1 and ".zstd." in files[0]
        assert lake.stored_files(spark, folder, "ohlcv").count() == 1

    def test_runs_do_not_touch_each_other_and_a_retry_replaces_itself(self, spark, folder):
        write_canonical(samples.bars(spark, 5), "ohlcv", folder, "r1", F.lit(NOW))
        write_canonical(samples.bars(spark, 3), "ohlcv", folder, "r2", F.lit(NOW + timedelta(days=1)))
        write_canonical(samples.bars(spark, 5), "ohlcv", folder, "r1", F.lit(NOW))
        stored = lake.read_canonical(spark, folder, "ohlcv")
        assert {(r.run, r["count"]) for r in stored.groupBy("run").count().collect()} == {("r1", 5), ("r2", 3)}


    def test_a_hot_symbol_is_written_by_several_tasks(self, spark, folder):
        """`rebalance` splits what one folder holds over tasks, and merges small folders."""
        hours = spark.range(0, 200_000, 1, 8).select(
            F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("timestamp"),
            *(F.rand(i).alias(c) for i, c in enumerate((*schemas.PRICES, "volume"))),
            F.when(F.col("id") % 10 < 9, "HOT").otherwise(F.concat(F.lit("S"), (F.col("id") % 50).cast("string"))).alias("symbol"),
            F.lit("5m").alias("timeframe"), F.lit("p").alias("provider"),
        )
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        try:
            write_canonical(hours, "ohlcv", folder, "r1", F.lit(NOW))
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        files = [f.path for f in lake.stored_files(spark, folder, "ohlcv").collect()]
        hot = sum("symbol=HOT" in f for f in files)
        assert hot > 3
        assert lake.read_canonical(spark, folder, "ohlcv").count() == 200_000


class TestIngest:
    def run(self, spark, folder, run="r1", now=NOW, raw=None, **options):
        raw = feed(spark) if raw is None else raw
        return ingest(raw, Request("ohlcv", folder, run, now, "2024-01-01", "2024-01-31", **options),
                      weekday_calendar(spark, "2024-01-01", "2024-01-31"))

    def test_bars(self, spark, folder):
        reg = self.run(spark, folder)
        assert {(r.symbol, r.rows, r.quality_passed) for r in reg.collect()} == {("AAPL", 5, True), ("MSFT", 5, True)}
        log = lake.read_catalog(spark, folder, "ingestion_log")
        assert {(r.symbol, r.status, r.rows_fetched, r.rows_after_quality) for r in log.collect()} == {
            ("AAPL", "success", 5, 5), ("MSFT", "success", 5, 5),
        }
        assert {r.event for r in lake.read_catalog(spark, folder, "events").collect()} == {"DatasetIngested"}
        files = lake.stored_files(spark, folder, "ohlcv")
        lost, unknown = lake.reconcile(reg, files)
        assert lost.count() == 0 and unknown.count() == 0
        lost, unknown = lake.reconcile(reg.where("symbol = 'AAPL'"), files.where("path LIKE '%MSFT%'"))
        assert lost.count() == 1 and unknown.count() == 1

    @pytest.mark.parametrize("layout", ["symbol", "bucket"])
    def test_registered_locations_can_be_read(self, spark, folder, layout):
        reg = self.run(spark, folder, "r=1", raw=feed(spark, symbols=("^GSPC", "EUR=X", "BRK-B")), layout=layout)
        for row in reg.collect():
            assert spark.read.schema(lake.stored_schema("ohlcv", layout)).parquet(row.storage_uri).count() >= row.rows == 5

    def test_a_failed_run_is_logged_announced_and_raised(self, spark, folder):
        raw = feed(spark).withColumn("Open", F.raise_error(F.lit("feed broke")).cast("double"))
        with pytest.raises(Exception, match="feed broke"):
            self.run(spark, folder, raw=raw)
        row = lake.read_catalog(spark, folder, "ingestion_log").first()
        assert (row.status, row.data_type, row.completed_at) == ("failed", "ohlcv", NOW) and "feed broke" in row.error
        assert [r.event for r in lake.read_catalog(spark, folder, "events").collect()] == ["IngestionFailed"]
        assert self.run(spark, folder).count() == 2

    def test_a_second_run_is_a_new_version(self, spark, folder):
        self.run(spark, folder)
        self.run(spark, folder, "r2", NOW + timedelta(days=1), feed(spark, 3))
        reg = lake.read_catalog(spark, folder, "registry")
        assert reg.count() == 4
        stored = lake.read_canonical(spark, folder, "ohlcv")
        assert stored.count() == 16 and lake.current_rows(stored, reg).count() == 6
        plan = lake.live_rows(stored, reg)._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]

    def test_overlapping_requests_give_one_row_per_bar(self, spark, folder):
        calendar = weekday_calendar(spark, "2024-01-01", "2024-01-31")
        for run, n, days, end in (("r1", 3, 0, "2024-01-15"), ("r2", 5, 1, "2024-01-31")):
            raw = feed(spark, n).withColumn("Volume", F.lit(str(n)))
            ingest(raw, Request("ohlcv", folder, run, NOW + timedelta(days=days), "2024-01-01", end), calendar)
        rows = lake.current_rows(lake.read_canonical(spark, folder, "ohlcv"), lake.read_catalog(spark, folder, "registry"))
        assert [r.volume for r in rows.collect()] == [5.0] * 10
        compact(spark, "ohlcv", folder, "c1", lake.live_rows(lake.read_canonical(spark, folder, "ohlcv"), lake.read_catalog(spark, folder, "registry")))
        assert lake.read_canonical(spark, folder, "ohlcv", run="c1").count() == 16

    def test_a_lower_case_feed_is_found(self, spark, folder):
        reg = self.run(spark, folder, raw=feed(spark, symbols=("aapl",)))
        assert [r.symbol for r in reg.collect()] == ["AAPL"]
        assert lake.read_canonical(spark, folder, "ohlcv", ["aapl"]).count() == 5
        assert [r.status for r in lake.read_catalog(spark, folder, "ingestion_log").collect()] == ["success"]

    def test_the_layout_is_the_table_s_own(self, spark, folder):
        write_canonical(samples.bars(spark), "ohlcv", folder, "r1", F.lit(NOW), layout="bucket", buckets=7)
        assert lake.read_canonical(spark, folder, "ohlcv", ["AAPL"]).count() == samples.bars(spark).count()
        with pytest.raises(ValueError, match="7 buckets"):
            write_canonical(samples.bars(spark), "ohlcv", folder, "r2", F.lit(NOW))

    def test_unusable_series_is_logged_and_announced(self, spark, folder):
        raw = feed(spark).withColumn("Open", F.when(F.col("symbol") == "AAPL", F.col("Open")))
        self.run(spark, folder, raw=raw)
        log = {r.symbol: r for r in lake.read_catalog(spark, folder, "ingestion_log").collect()}
        assert (log["MSFT"].status, log["MSFT"].rows_fetched, log["MSFT"].error) == ("failed", 5, "no usable rows")
        failed = lake.read_catalog(spark, folder, "events").where("event = 'IngestionFailed'").collect()
        assert [json.loads(r.payload)["symbol"] for r in failed] == ["MSFT"]

    def test_nothing_usable_at_all(self, spark, folder):
        reg = self.run(spark, folder, raw=feed(spark).withColumn("Open", F.lit(None).cast("double")))
        assert reg.count() == 0
        assert {r.status for r in lake.read_catalog(spark, folder, "ingestion_log").collect()} == {"failed"}

    def test_other_data_types_share_the_catalog(self, spark, folder):
        news = samples.raw_news(spark, ["a", " ", "b"]).withColumns({"symbol": F.lit("AAPL"), "provider": F.lit("news")})
        macro = samples.raw_macro(spark).withColumns({"series": F.lit("cpi"), "provider": F.lit("fred")})
        facts = spark.createDataFrame([("AAPL", "yahoo", "17.25")], "symbol STRING, provider STRING, pe_ratio STRING")
        for data_type, raw in (("news", news), ("macro", macro), ("fundamentals", facts)):
            ingest(raw, Request(data_type, folder, "r1", NOW))
        reg = lake.read_catalog(spark, folder, "registry")
        assert {(r.data_type, r.symbol, r.series, r.rows) for r in reg.collect()} == {
            ("news", "AAPL", None, 2), ("macro", None, "CPI", 12), ("fundamentals", "AAPL", None, 1),
        }
        assert {r.status for r in lake.read_catalog(spark, folder, "ingestion_log").collect()} == {"success"}
        stored = lake.read_canonical(spark, folder, "macro", ["cpi"])
        assert get_macro(stored, "CPI", "2023-01-01", "2023-12-31").count() == 12
        assert lake.read_canonical(spark, folder, "fundamentals").first().as_of == NOW
        assert lake.read_catalog(spark, folder, "tombstones").count() == 0

    def test_round_trip_of_the_plan(self, spark, folder):
        """What was ingested is fresh and needs no new ingestion; a refresh makes it due again."""
        reg = self.run(spark, folder)
        symbols = spark.createDataFrame([("AAPL",), ("TSLA",)], "symbol STRING")
        wanted = catalog.request_manifest(symbols, "2024-01-01", "2024-01-31", news=False, macro=False)
        todo, done = catalog.plan_ingestion(wanted, reg, F.lit(NOW))
        assert [r.symbol for r in todo.collect()] == ["TSLA"] and [r.symbol for r in done.collect()] == ["AAPL"]
        gone = catalog.refresh(reg, wanted.drop("hash"), F.lit(NOW + timedelta(hours=1)))
        status = {r.symbol: r.status for r in catalog.resolve(wanted, reg, F.lit(NOW + timedelta(hours=2)), gone).collect()}
        assert status == {"AAPL": "missing", "TSLA": "missing"}
        for at, gone_ in ((NOW + timedelta(hours=2), gone), (NOW + timedelta(days=2), None)):  # invalidated; stale
            todo, done = catalog.plan_ingestion(wanted, reg, F.lit(at), gone_)
            assert todo.count() == 2 and done.count() == 0


class Steady(providers.Provider):
    """Daily bars whose price is the day of the year."""

    name = "steady"
    supported_timeframes = ("1d",)

    def download_bars(self, symbol, timeframe, start, end):
        for n in range((end - start).days + 1):
            day = start + timedelta(days=n)
            price = float(day.timetuple().tm_yday)
            yield (datetime(day.year, day.month, day.day), price, price, price, price, 1.0)

    def download_macro(self, series, start, end):
        yield (datetime(start.year, 1, 1), float(start.year))


class Listing(providers.Provider):
    """Lists its symbols, and gives macro points as Arrow batches."""

    name = "listing"

    def symbols(self):
        return (f"L{i}" for i in range(int(self.options["n"])))

    def download_macro(self, series, start, end):
        for month in (1, 2):
            yield pa.RecordBatch.from_pydict({"date": [datetime(start.year, month, 1)], "value": [month]})


class TestProviders:
    def test_bars_are_read_by_symbol_and_year(self, spark):
        providers.register_provider(spark, Steady)
        df = providers.read_provider(spark, "ohlcv", ["A", "B"], "2022-12-30", "2024-01-02", provider="steady")
        assert df.rdd.getNumPartitions() == 6
        assert df.count() == 2 * ((date(2024, 1, 2) - date(2022, 12, 30)).days + 1)
        rows = df.where("symbol = 'A'").orderBy("seq").collect()
        assert [r.timestamp for r in rows] == sorted(r.timestamp for r in rows)
        fewer = providers.read_provider(spark, "ohlcv", ["A", "B"], "2022-12-30", "2024-01-02", provider="steady", names_per_task=2)
        assert fewer.rdd.getNumPartitions() == 3 and fewer.exceptAll(df).count() == 0
        assert normalize_bars(df).count() == df.count()

    def test_macro_and_unsupported(self, spark):
        providers.register_provider(spark, Steady)
        macro = providers.read_provider(spark, "macro", ["CPI"], "2022-01-01", "2023-12-31", provider="steady")
        assert [(r.series, r.value) for r in macro.orderBy("date").collect()] == [("CPI", 2022.0), ("CPI", 2023.0)]
        with pytest.raises(Exception, match="has no news"):
            providers.read_provider(spark, "news", ["A"], "2022-01-01", "2022-01-02", provider="steady").collect()
        with pytest.raises(Exception, match="no 1h bars"):
            providers.read_provider(spark, "ohlcv", ["A"], "2022-01-01", "2022-01-02", "1h", provider="steady").collect()

    def test_names_as_a_table(self, spark):
        providers.register_provider(spark, Steady)
        names = spark.range(40).selectExpr("'N' || id AS symbol", "id")
        df = providers.read_provider(spark, "ohlcv", names, "2022-12-30", "2023-01-02", provider="steady", tasks=5)
        assert df.rdd.getNumPartitions() == 5
        listed = providers.read_provider(spark, "ohlcv", [f"N{i}" for i in range(40)], "2022-12-30", "2023-01-02", provider="steady")
        assert df.count() == 160 and df.exceptAll(listed).count() == 0 and df.schema == listed.schema
        assert providers.read_provider(spark, "ohlcv", names.limit(0), "2022-12-30", "2023-01-02", provider="steady").count() == 0
        with pytest.raises(ValueError, match="no 1h bars"):
            providers.read_provider(spark, "ohlcv", names, "2022-01-01", "2022-01-02", "1h", "steady")

    def test_symbols_and_arrow_batches(self, spark):
        own = spark.newSession()  # the others' listings stay as they are
        providers.register_provider(own, Listing)
        assert [tuple(r) for r in providers.provider_symbols(own, "listing", n="3").orderBy("symbol").collect()] == [(f"L{i}", "listing") for i in range(3)]
        macro = providers.read_provider(own, "macro", ["CPI"], "2022-01-01", "2022-12-31", provider="listing")
        assert [(r.date, r.value, r.series, r.provider) for r in macro.orderBy("date").collect()] == [(datetime(2022, m, 1), float(m), "CPI", "listing") for m in (1, 2)]
        with pytest.raises(Exception, match="does not list"):
            providers.register_provider(spark, Steady)
            providers.provider_symbols(spark, "steady").collect()

    def test_sessions_have_their_own_providers(self, spark):
        providers.register_provider(spark, Steady)
        other = spark.newSession()
        assert "steady" in providers.registered_providers(spark) and providers.registered_providers(other) == ()
        with pytest.raises(KeyError):
            providers.read_provider(other, "ohlcv", ["A"], "2022-01-01", "2022-01-02", provider="steady")

    def test_a_stream_goes_on_from_its_checkpoint(self, spark, folder):
        providers.register_provider(spark, Steady)
        seen = []
        for end in ("2022-12-30", "2022-12-30", "2023-01-02"):
            stream = providers.stream_provider(spark, "ohlcv", ["A", "B"], "2022-12-29", provider="steady", end=end)
            query = stream.writeStream.foreachBatch(lambda df, n: seen.append((n, sorted((r.symbol, r.timestamp.date()) for r in df.collect()))))
            query.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
        days = [date(2022, 12, 29) + timedelta(days=n) for n in range(5)]
        assert [rows for _, rows in seen if rows] == [[(s, d) for s in "AB" for d in days[:2]], [(s, d) for s in "AB" for d in days[2:]]]

    def test_lookup(self, spark):
        providers.register_provider(spark, Steady)
        health = spark.createDataFrame([("steady", True), ("gone", False)], "provider STRING, healthy BOOLEAN")
        assert [tuple(r) for r in providers.list_providers(spark, health).collect()] == [("steady", ["1d"], True)]
        assert "steady" in providers.registered_providers()
        with pytest.raises(KeyError):
            providers.provider_for("ohlcv", "nobody")
        with pytest.raises(ValueError):
            providers.provider_for("weather")


class TestRuns:
    """Which runs make up a table: commits, compaction, reading as of a moment, expiry."""

    DAYS = (("r1", 3, 0, "2024-01-15"), ("r2", 5, 1, "2024-01-31"), ("r3", 1, 3, "2024-01-20"))

    def ingest(self, spark, folder, runs):
        calendar = weekday_calendar(spark, "2024-01-01", "2024-01-31")
        for run, n, days, end in runs:
            raw = feed(spark, n).withColumn("Volume", F.lit(str(n)))
            ingest(raw, Request("ohlcv", folder, run, NOW + timedelta(days=days), "2024-01-01", end), calendar)

    def rows(self, spark, folder, as_of=None):
        registry = lake.read_catalog(spark, folder, "registry", as_of=as_of)
        rows = lake.current_rows(lake.read_canonical(spark, folder, "ohlcv", as_of=as_of), registry)
        return sorted((r.symbol, r.timestamp, r.volume) for r in rows.collect())

    def test_compaction_swaps_runs_and_keeps_earlier_moments(self, spark, folder):
        self.ingest(spark, folder, self.DAYS[:2])
        before = self.rows(spark, folder)
        folded = compact(spark, "ohlcv", folder, "c1", at=NOW + timedelta(days=2))
        assert sorted(r.run for r in folded.collect()) == ["r1", "r2"]
        assert [r.run for r in lake.runs_in_force(spark, folder, "ohlcv").collect()] == ["c1"]
        assert self.rows(spark, folder) == before
        self.ingest(spark, folder, self.DAYS[2:])
        after = self.rows(spark, folder)
        assert [v for *_, v in after] == [1.0, 5.0, 5.0, 5.0, 5.0] * 2
        assert sorted(r.run for r in lake.runs_in_force(spark, folder, "ohlcv").collect()) == ["c1", "r3"]
        assert self.rows(spark, folder, NOW + timedelta(days=1)) == before
        assert {v for *_, v in self.rows(spark, folder, NOW)} == {3.0}
        assert expire(spark, "ohlcv", folder, NOW + timedelta(days=1)) == []
        assert expire(spark, "ohlcv", folder, NOW + timedelta(days=2)) == ["r1", "r2"]
        assert self.rows(spark, folder) == after and not os.path.exists(run_path(folder, "ohlcv", "r1"))
        lost, unknown = lake.reconcile(lake.read_catalog(spark, folder, "registry"), lake.stored_files(spark, folder, "ohlcv"))
        assert lost.count() == unknown.count() == 0
        told = {r.commit: (r.n_added, r.n_replaced) for r in lake.snapshots(spark, folder, "ohlcv").collect()}
        assert told == {"r1": (1, 0), "r2": (1, 0), "c1": (1, 2), "r3": (1, 0)}

    def test_a_chain_of_compactions(self, spark, folder):
        self.ingest(spark, folder, self.DAYS[:1])
        compact(spark, "ohlcv", folder, "c=1")
        self.ingest(spark, folder, self.DAYS[1:2])
        compact(spark, "ohlcv", folder, "c 2", at=NOW + timedelta(days=2))
        rows = self.rows(spark, folder)
        assert len(rows) == 10 and {v for *_, v in rows} == {5.0}
        assert {r.storage_uri.split("/run=")[1].split("/")[0] for r in lake.read_catalog(spark, folder, "registry").collect()} == {"c 2"}
        assert expire(spark, "ohlcv", folder, NOW + timedelta(days=2)) == ["c=1", "r1", "r2"]
        assert self.rows(spark, folder) == rows

    def test_a_run_that_never_committed_is_not_read(self, spark, folder):
        self.ingest(spark, folder, self.DAYS[:1])
        write_canonical(samples.bars(spark, 5), "ohlcv", folder, "broken", F.lit(NOW))
        assert {r.run for r in lake.read_canonical(spark, folder, "ohlcv").select("run").distinct().collect()} == {"r1"}
        # A retry of a run replaces its own commit.
        self.ingest(spark, folder, self.DAYS[:1])
        assert lake.snapshots(spark, folder, "ohlcv").count() == 1

    def test_a_run_committed_meanwhile_stays(self, spark, folder, monkeypatch):
        self.ingest(spark, folder, self.DAYS[:1])
        write = store.write_compacted

        def slow(*args):
            self.ingest(spark, folder, self.DAYS[1:2])
            write(*args)

        monkeypatch.setattr(store, "write_compacted", slow)
        compact(spark, "ohlcv", folder, "c1", at=NOW + timedelta(days=2))
        assert sorted(r.run for r in lake.runs_in_force(spark, folder, "ohlcv").collect()) == ["c1", "r2"]
        assert {v for *_, v in self.rows(spark, folder)} == {5.0} and len(self.rows(spark, folder)) == 10

    def test_compacted_files_are_in_order_and_few(self, spark, folder):
        self.ingest(spark, folder, self.DAYS[:2])
        compact(spark, "ohlcv", folder, "c1")
        files = lake.stored_files(spark, folder, "ohlcv").where("path LIKE '%run=c1%'")
        assert files.count() == 2  # one per symbol
        for f in files.collect():
            at = [r.timestamp for r in spark.read.parquet(f.path).collect()]
            assert at == sorted(at)
        with pytest.raises(ValueError, match="nothing was committed"):
            compact(spark, "news", f"{folder}/none", "c1")

    def test_tombstoned_versions_are_not_kept(self, spark, folder):
        self.ingest(spark, folder, self.DAYS[:1])
        registry = lake.read_catalog(spark, folder, "registry")
        gone = catalog.invalidate(registry, F.lit(NOW + timedelta(hours=1)), symbol="AAPL")
        store.write_catalog(gone, "tombstones", folder, "t1")
        compact(spark, "ohlcv", folder, "c1")
        assert {r.symbol for r in lake.read_canonical(spark, folder, "ohlcv").collect()} == {"MSFT"}


class TestMalformed:
    """Records that could not be read leave a trace."""

    BODIES = {
        "A": '{"articles": [{"title": "t", "publishedAt": "2024-01-02T10:00:00Z"}, {"title": "u", "publishedAt": "soon"}]}',
        "B": '{"articles": [{"title": "t", "publi', "C": '{"status": "error"}', "D": None, "E": " ", "F": "[1]", "G": '{"articles": []}',
        "H": '{"articles": [{"title": "t", "source": "text", "publishedAt": "2024-01-02T10:00:00Z"}]}',
    }

    def test_every_response_is_accounted_for(self, spark):
        df = spark.createDataFrame(list(self.BODIES.items()), "symbol STRING, body STRING")
        assert sorted(r.symbol for r in feeds.parse_news_json(df).collect()) == ["A", "H"]
        got = {(r.symbol, r.reason): r.record for r in feeds.rejected_news(df).collect()}
        assert set(got) == {
            ("A", "no usable time"), ("B", "malformed JSON"), ("C", "no articles"), ("D", "no body"), ("E", "no body"),
            ("F", "malformed JSON"), ("H", "malformed in part"),
        }
        assert got["B", "malformed JSON"] == self.BODIES["B"] and json.loads(got["A", "no usable time"])["title"] == "u"
        assert feeds.rejected_news(df.limit(0)).count() == 0

    def test_rss_files(self, spark, folder):
        items = ["<item><title>a</title><pubDate>Tue, 02 Jan 2024 00:00:00 GMT</pubDate></item>", "<item><title>b</tit></item>", "<item><title>c</title>",
                 "<item a='1'><title>d &amp; e</title><pubDate>Wed, 03 Jan 2024 00:00:00 GMT</pubDate></item>", "<item/>", "<item><title>f & g</title></item>"]
        for name, body in (("aapl", "<rss><channel>" + "\n".join(items) + "</channel></rss>"), ("none", "<html>sorry</html>"), ("cut", "<rss><item><title>x")):
            with open(f"{folder}/{name}.xml", "w") as f:
                f.write(body)
        records = feeds.read_rss_records(spark, f"{folder}/*.xml")
        articles = feeds.parse_rss_items(feeds.read_rss_items(records))
        assert sorted((r.symbol, r.headline) for r in articles.collect()) == [("AAPL", "a"), ("AAPL", "d & e")]
        got = sorted((r.symbol, r.reason, (r.record or "").strip()) for r in feeds.rejected_rss(records).collect())
        assert got == sorted([
            ("AAPL", "malformed XML", items[1]), ("AAPL", "malformed XML", items[2]), ("AAPL", "no usable time", items[4]),
            ("AAPL", "malformed XML", items[5]), ("NONE", "no items", ""), ("CUT", "malformed XML", "<item><title>x"),
        ])

    def test_fundamentals(self, spark):
        df = spark.createDataFrame([("A", '{"marketCap": 1}'), ("B", '{"mark'), ("C", None), ("D", "[]")], "symbol STRING, body STRING")
        got = {(r.symbol, r.reason) for r in feeds.rejected_fundamentals(df).collect()}
        assert got == {("B", "malformed JSON"), ("C", "no body"), ("D", "malformed JSON")}

    @pytest.mark.parametrize("fmt", ["csv", "json"])
    def test_lines_of_bars(self, spark, folder, fmt):
        rows = feed(spark).select([F.col(f.name).cast(f.dataType) for f in feeds.RAW_BARS])
        rows.coalesce(1).write.format(fmt).options(header="true").save(f"{folder}/raw")
        with open(f"{folder}/raw/part-more.{fmt}", "w") as f:
            f.write((",".join(feeds.RAW_BARS.fieldNames()) + "\n2024-01-02,1\n") if fmt == "csv" else '{"Date": "2024-01-02", \n')
        good, bad = feeds.split_malformed(feeds.read_raw_bars(spark, f"{folder}/raw", fmt, keep_malformed=True))
        assert good.columns == rows.columns and good.exceptAll(rows).count() == 0 and good.count() == 10
        assert [(r.symbol, r.reason) for r in bad.collect()] == [(None, "malformed line")] and "2024-01-02" in bad.first().record
        assert good.select("symbol").count() == 10 and bad.select("reason").count() == 1  # whatever columns are read
        none, nothing = feeds.split_malformed(rows)
        assert none.count() == 10 and nothing.count() == 0

    def test_an_ingestion_run_keeps_and_logs_them(self, spark, folder):
        named = spark.createDataFrame([(k, b, "news") for k, b in self.BODIES.items()], "symbol STRING, body STRING, provider STRING")
        raw = feeds.parse_news_json(named).withColumn("provider", F.lit("news"))
        ingest(raw, Request("news", folder, "r1", NOW), rejects=feeds.rejected_news(named))
        kept = lake.read_catalog(spark, folder, "rejects")
        assert kept.count() == 7 and {(r.data_type, r.rejected_at) for r in kept.collect()} == {("news", NOW)}
        log = {r.symbol: r for r in lake.read_catalog(spark, folder, "ingestion_log").collect()}
        assert log["A"].status == "success" and log["A"].issues == ["rejected: 1 x no usable time"]
        assert (log["B"].status, log["B"].error, log["B"].rows_fetched) == ("failed", "rejected: 1 x malformed JSON", 0)
        assert set(log) == set("ABCDEFH")
        told = {json.loads(r.payload)["symbol"] for r in lake.read_catalog(spark, folder, "events").where("event = 'IngestionFailed'").collect()}
        assert told == set("BCDEF")
