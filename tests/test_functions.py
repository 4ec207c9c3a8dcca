"""Keys, times and numbers against Python's own."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marketlake import functions as fn

def expected_hash(data_type: str, params: dict) -> str:
    text = json.dumps({"data_type": data_type, **params}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def spark_hash(spark, data_type: str, params: dict) -> str:
    columns = {k: F.lit(v) for k, v in params.items()}
    return spark.range(1).select(fn.dataset_hash(F.lit(data_type), **columns)).first()[0]


def column(spark, values: list, expr, kind: str = "STRING") -> list:
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


_TEXT = st.text(st.characters(min_codepoint=0x20, exclude_categories=("Cs", "Cc")), min_size=1, max_size=8)
_PARAMS = st.fixed_dictionaries({}, optional={k: _TEXT for k in ("provider", "symbol", "timeframe", "start", "end", "series")})


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(_TEXT, _PARAMS), min_size=30, max_size=60))
def test_dataset_hash_is_the_digest_of_sorted_json(spark, cases):
    """Whatever the texts and whichever parameters are there; a missing one has no key. Different requests differ."""
    names = ("provider", "symbol", "timeframe", "start", "end", "series")
    rows = [(i, d, *(p.get(n) for n in names)) for i, (d, p) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i INT, data_type STRING, " + ", ".join(f"`{n}` STRING" for n in names))
    got = df.select("i", fn.dataset_hash(F.col("data_type"), **{n: F.col(f"`{n}`") for n in names})).orderBy("i").collect()
    assert [r[1] for r in got] == [expected_hash(d, p) for d, p in cases]


def test_dataset_hash_of_constants(spark):
    """Any order of the parameters gives one hash, and every one of them counts."""
    asked = {"symbol": "ZQ7", "provider": "desk", "end": "2019-06-30", "start": "2019-04-01", "timeframe": "15m"}
    one = spark_hash(spark, "ohlcv", asked)
    assert one == spark_hash(spark, "ohlcv", dict(sorted(asked.items()))) == expected_hash("ohlcv", asked)
    others = [spark_hash(spark, "ohlcv", asked | {name: "0"}) for name in asked] + [spark_hash(spark, "news", asked)]
    assert len({one, *others}) == len(asked) + 2


def test_storage_uri(spark):
    def uri(data_type, symbol, timeframe, series):
        parts = (F.lit(x).cast("string") for x in (data_type, symbol, timeframe, series, "2024-01-02", "0123456789abcdef"))
        return spark.range(1).select(fn.storage_uri("s3://b/", *parts)).first()[0]

    assert uri("ohlcv", "AAPL", "1d", None) == "s3://b/datasets/ohlcv/AAPL/1d/2024/AAPL_1d_20240102_01234567.parquet"
    assert uri("news", "AAPL", None, None) == "s3://b/datasets/news/AAPL/2024/AAPL_news_20240102_01234567.parquet"
    assert uri("fundamentals", "AAPL", None, None) == (
        "s3://b/datasets/fundamentals/AAPL/AAPL_fundamentals_20240102_01234567.parquet"
    )
    assert uri("macro", None, None, "CPI") == "s3://b/datasets/macro/CPI/CPI_2024_01234567.parquet"


def test_ttl(spark):
    cases = [
        ("ohlcv", "1d", 86_400), ("ohlcv", "1w", 86_400), ("ohlcv", "1m", 86_400), ("ohlcv", "5m", 3_600),
        ("ohlcv", None, 86_400), ("news", None, 21_600), ("fundamentals", None, 86_400), ("macro", None, 259_200),
        ("other", None, 86_400),
    ]
    df = spark.createDataFrame(cases, "d STRING, t STRING, want INT")
    assert all(r.want == r.got for r in df.withColumn("got", fn.ttl_seconds(F.col("d"), F.col("t"))).collect())


def test_default_provider(spark):
    got = column(spark, ["ohlcv", "news", "fundamentals", "macro", "x"], fn.default_provider)
    assert got == ["yahoo", "news", "yahoo", "fred", None]


class TestTimes:
    def test_utc(self, spark):
        got = column(
            spark,
            ["2024-01-02", "2024-01-02T14:30:00Z", "2024-01-02 14:30:00+05:00", "2024-01-02T14:30:00.25", "12:30", "soon", "", None,
             "20240102", "20240102T143000", "20240102T143000Z", "1/2/2024", "01/02/2024 14:30", "202401", "2024-13-01", "20241301", "2024"],
            fn.utc_timestamp,
        )
        assert got == [
            datetime(2024, 1, 2), datetime(2024, 1, 2, 14, 30), datetime(2024, 1, 2, 9, 30),
            datetime(2024, 1, 2, 14, 30, 0, 250_000), None, None, None, None,
            datetime(2024, 1, 2), datetime(2024, 1, 2, 14, 30), datetime(2024, 1, 2, 14, 30), datetime(2024, 1, 2),
            datetime(2024, 1, 2, 14, 30), None, None, None, datetime(2024, 1, 1),
        ]

    def test_iso_with_z_removed(self, spark):
        got = column(spark, ["2024-01-02T14:30:00Z", "2024-01-02T14:30:00ZZ", "2024-01-02T14:30:00+02:00", "x"], fn.iso_z_timestamp)
        assert got == [datetime(2024, 1, 2, 14, 30)] * 2 + [datetime(2024, 1, 2, 12, 30), None]

    def test_rfc2822(self, spark):
        got = column(
            spark,
            ["Tue, 02 Jan 2024 14:30:00 +0000", "02 Jan 2024 14:30:00 GMT", "Tue, 2 Jan 2024 14:30:00 -0500", "02/01/2024", None],
            fn.rfc2822_timestamp,
        )
        at = datetime(2024, 1, 2, 14, 30)
        assert got == [at, at, datetime(2024, 1, 2, 19, 30), None, None]

    def test_as_of_drops_the_offset(self, spark):
        now = F.lit("2024-06-01 00:00:00")
        got = column(
            spark, ["2024-01-02", "2024-01-02T10:00:00+05:00", "2024-01-02T10:00:00Z", "bad", "", None],
            lambda c: fn.as_of_timestamp(c, now),
        )
        at, ten = datetime(2024, 6, 1), datetime(2024, 1, 2, 10)
        assert got == [datetime(2024, 1, 2), ten, ten, at, at, at]

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.datetimes(datetime(1970, 1, 1), datetime(2100, 1, 1)), min_size=1, max_size=50))
    def test_created_at_is_isoformat(self, spark, moments):
        got = column(spark, moments, fn.iso_created_at, "TIMESTAMP")
        assert got == [m.replace(tzinfo=timezone.utc).isoformat() for m in moments]


class TestNumbers:
    def test_to_double(self, spark):
        got = column(spark, ["1.5", " 2 ", "1e3", "n/a", "", "NaN", "1.0d", "2f", None], fn.to_double)
        assert got == [1.5, 2.0, 1000.0, None, None, None, None, None, None]

    def test_safe_double_keeps_nan(self, spark):
        got = column(spark, ["NaN", "inf", "x"], fn.safe_double)
        assert math.isnan(got[0]) and got[1:] == [math.inf, None]

    def test_abs_pct_change(self, spark):
        df = spark.createDataFrame([(1.2, 1.0), (0.5, 0.0), (0.0, 0.0), (1.0, None), (-3.0, -2.0)], "v DOUBLE, p DOUBLE")
        got = [r[0] for r in df.select(fn.abs_pct_change(F.col("v"), F.col("p"))).collect()]
        assert got[0] == pytest.approx(0.2) and got[1] == math.inf and math.isnan(got[2])
        assert got[3] is None and got[4] == 0.5

    def test_nan_to_null(self, spark):
        df = spark.createDataFrame([("a", math.nan), ("b", 1.0)], "k STRING, v DOUBLE")
        assert [tuple(r) for r in fn.nan_to_null(df).collect()] == [("a", None), ("b", 1.0)]


def test_blank_text(spark):
    values = ["", "  ", "\t\n", " ", " ", "\x1f", "a", " a "]
    assert column(spark, values, fn.is_blank) == [not v.strip() for v in values]
