"""Raw feeds to canonical tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marketlake import schemas
from marketlake.operators.normalize import normalize_bars, normalize_fundamentals, normalize_macro, normalize_news, split_readable
from tests import samples

def now():
    return F.lit("2024-06-01 00:00:00")


def bars(raw):
    return normalize_bars(raw, "AAPL", "1d", "yahoo")


class TestBars:
    def test_rows_schema_and_constants(self, spark):
        df = bars(samples.raw_bars(spark))
        assert df.schema.simpleString() == schemas.BARS.simpleString()
        rows = df.orderBy("timestamp").collect()
        assert len(rows) == 5
        assert [r.timestamp for r in rows] == samples.business_days(5)
        assert {(r.symbol, r.timeframe, r.provider) for r in rows} == {("AAPL", "1d", "yahoo")}
        assert rows[0].volume == 1_200.0

    def test_copies_collapse(self, spark):
        assert bars(samples.raw_bars(spark, 3, copies=2)).count() == 3

    def test_first_of_a_timestamp_wins_after_null_prices_are_dropped(self, spark):
        raw = spark.createDataFrame(
            [("2024-01-02", v, 9.0, 1.0, 5.0, 1.0, seq) for v, seq in ((7.0, 2), (None, 0), (6.0, 1))],
            "Date STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE, seq BIGINT",
        )
        assert [r.open for r in bars(raw).collect()] == [6.0]

    def test_null_volume_and_null_time_are_kept(self, spark):
        raw = samples.raw_bars(spark, 2).withColumns(
            {"Volume": F.lit(None).cast("string"), "Date": F.when(F.col("seq") == 0, "never").otherwise(F.col("Date"))}
        )
        rows = normalize_bars(raw, "AAPL", "1d", "yahoo", strict_time=False).collect()
        assert len(rows) == 2
        assert [r.volume for r in rows] == [None, None] and sum(r.timestamp is None for r in rows) == 1

    def test_strict_time_fails_the_job(self, spark):
        raw = samples.raw_bars(spark, 1).withColumn("Date", F.lit("never"))
        with pytest.raises(Exception, match="bad time"):
            bars(raw).collect()

    def test_unreadable_times_are_kept_apart_row_by_row(self, spark):
        raw = samples.raw_bars(spark, 5).withColumn("Date", F.when(F.col("seq") < 2, "never").when(F.col("seq") == 2, None).otherwise(F.col("Date")))
        readable, rest = split_readable(raw)
        assert readable.columns == rest.columns == raw.columns and bars(readable).count() == 2 and rest.count() == 3

    def test_offset_is_converted(self, spark):
        raw = samples.raw_bars(spark, 1).withColumn("Date", F.lit("2024-01-02T05:00:00+05:00"))
        assert bars(raw).first().timestamp == datetime(2024, 1, 2)

    def test_time_candidates_by_exact_case(self, spark):
        raw = samples.raw_bars(spark, 1).withColumnRenamed("Date", "Datetime").withColumn("dAtE", F.lit("2020-01-01"))
        assert bars(raw).first().timestamp == datetime(2024, 1, 2)

    @pytest.mark.parametrize("column", ["Date", "Close", "Volume"])
    def test_missing_column_gives_empty_table(self, spark, column):
        df = bars(samples.raw_bars(spark).drop(column))
        assert df.schema.simpleString() == schemas.BARS.simpleString() and df.count() == 0

    def test_empty_feed(self, spark):
        df = bars(samples.raw_bars(spark).limit(0))
        assert df.schema.simpleString() == schemas.BARS.simpleString() and df.count() == 0

    def test_many_series_carry_their_keys(self, spark):
        raw = samples.raw_bars(spark, 3).crossJoin(spark.createDataFrame([("A",), ("B",)], "symbol STRING"))
        df = normalize_bars(raw, timeframe="1d", provider="yahoo")
        assert {(r.symbol, r["count"]) for r in df.groupBy("symbol").count().collect()} == {("A", 3), ("B", 3)}
        with pytest.raises(ValueError, match="symbol"):
            normalize_bars(samples.raw_bars(spark), timeframe="1d", provider="yahoo")


class TestNews:
    def test_rows_and_schema(self, spark):
        df = normalize_news(samples.raw_news(spark, ["a", "b", "c"]), "AAPL", "news")
        assert df.schema.simpleString() == schemas.NEWS.simpleString() and df.count() == 3
        assert df.orderBy("published_at").first().published_at == datetime(2024, 1, 3, 9, 5)

    def test_blank_and_null_headlines_are_dropped_and_others_kept_untrimmed(self, spark):
        df = normalize_news(samples.raw_news(spark, [" x ", "", " \t", " ", None]), "AAPL", "news")
        assert [r.headline for r in df.collect()] == [" x "]

    def test_bad_time_is_dropped(self, spark):
        raw = samples.raw_news(spark, ["a", "b"]).withColumn("published_at", F.when(F.col("headline") == "a", "soon").otherwise(F.col("published_at")))
        assert [r.headline for r in normalize_news(raw, "AAPL", "news").collect()] == ["b"]

    def test_optional_columns_are_filled(self, spark):
        df = normalize_news(samples.raw_news(spark, ["a"]).drop("source", "url"), "AAPL", "news")
        assert (df.first().source, df.first().url) == (None, None)

    def test_missing_and_empty(self, spark):
        raw = samples.raw_news(spark, ["a"])
        for bad in (raw.drop("headline"), raw.drop("published_at"), raw.limit(0)):
            df = normalize_news(bad, "AAPL", "news")
            assert df.schema.simpleString() == schemas.NEWS.simpleString() and df.count() == 0


class TestFundamentals:
    def test_values(self, spark):
        raw = spark.createDataFrame(
            [("17.25", "3.5", "n/a", 6.4e10, "2024-01-02T10:00:00+05:00")],
            "pe_ratio STRING, pb_ratio STRING, revenue_growth STRING, market_cap DOUBLE, as_of STRING",
        )
        df = normalize_fundamentals(raw, now(), "AAPL", "yahoo")
        row = df.first()
        assert df.schema.simpleString() == schemas.FUNDAMENTALS.simpleString()
        assert (row.pe_ratio, row.pb_ratio, row.revenue_growth, row.market_cap, row.eps) == (17.25, 3.5, None, 6.4e10, None)
        assert row.as_of == datetime(2024, 1, 2, 10)

    def test_absent_metrics_and_time(self, spark):
        row = normalize_fundamentals(spark.createDataFrame([("AAPL",)], "symbol STRING"), now(), provider="yahoo").first()
        assert all(row[m] is None for m in schemas.METRICS) and row.as_of == datetime(2024, 6, 1)


class TestMacro:
    def test_rows(self, spark):
        df = normalize_macro(samples.raw_macro(spark), "cpi", "fred")
        assert df.schema.simpleString() == schemas.MACRO.simpleString() and df.count() == 12
        assert {r.series for r in df.collect()} == {"CPI"}

    def test_columns_by_position(self, spark):
        raw = samples.raw_macro(spark, 2).toDF("when", "x")
        assert normalize_macro(raw, "CPI", "fred").count() == 2

    def test_incomplete_rows_are_dropped(self, spark):
        raw = spark.createDataFrame([("2023-01-01", "."), ("bad", "1"), ("2023-03-01", "2")], "Date STRING, value STRING")
        assert [r.value for r in normalize_macro(raw, "CPI", "fred").collect()] == [2.0]

    def test_empty(self, spark):
        for raw in (samples.raw_macro(spark).limit(0), samples.raw_macro(spark).select("date")):
            df = normalize_macro(raw, "CPI", "fred")
            assert df.schema.simpleString() == schemas.MACRO.simpleString() and df.count() == 0
