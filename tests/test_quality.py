"""Quality checks, expectations and the exchange calendar."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlake import schemas
from marketlake.operators import calendar, expectations, quality
from marketlake.operators.series import even_slices
from tests import samples

def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def report(bars, check: str, **options):
    return quality.check_bars(bars, checks=[check], **options)


class TestBarChecks:
    def test_clean_data_passes_all(self, spark):
        rows = quality.check_bars(samples.bars(spark), calendar.weekday_calendar(spark, "2024-01-01", "2024-02-01"))
        assert samples.passed(rows) and samples.issues(rows) == [] and rows.count() == 13

    def test_high_below_low(self, spark):
        rows = report(samples.bars(spark, high={2: 42.0}, low={2: 43.5}), "check_price_range")
        assert not samples.passed(rows)
        assert "check_price_range: 1 rows where high < low" in samples.issues(rows)

    def test_close_outside(self, spark):
        rows = report(samples.bars(spark, 3, close={0: 55.0}), "check_price_range")
        assert samples.issues(rows) == ["check_price_range: 1 rows where close is outside [low, high]"]

    def test_zero_volume_only_warns(self, spark):
        rows = report(samples.bars(spark, 3, volume={0: 0.0, 1: 0.0, 2: 0.0}), "check_zero_volume")
        assert samples.passed(rows)
        assert samples.issues(rows) == ["check_zero_volume: 3 bars with volume=0 (warning only)"]

    def test_spike(self, spark):
        rows = report(samples.bars(spark, close={2: 83.0}), "check_price_spike")
        said = samples.issues(rows)
        assert "check_price_spike: 2 close values differ from prior close by >20%" in said
        assert "check_price_spike: 1 open values differ from prior close by >20%" in said

    def test_single_row_is_no_spike(self, spark):
        assert samples.passed(report(samples.bars(spark, 1), "check_price_spike"))

    def test_threshold_is_strict_and_zero_prior_is_a_spike(self, spark):
        flat = {c: {i: 100.0 for i in range(3)} for c in ("open", "high", "low")}
        at = samples.bars(spark, 3, **flat, close={0: 100.0, 1: 120.0, 2: 96.0})
        rows = report(at, "check_price_spike").where("field = 'close'").first()
        assert rows.n_bad == 0
        zero = samples.bars(spark, 3, **flat, close={0: 0.0, 1: 0.0, 2: 0.0})
        assert report(zero, "check_price_spike").where("field = 'close'").first().n_bad == 2

    def test_duplicates(self, spark):
        twice = samples.bars(spark, 3).unionAll(samples.bars(spark, 3))
        assert samples.issues(report(twice, "check_duplicates")) == ["check_duplicates: 3 duplicate timestamps found"]

    def test_null_times_count_as_one_value(self, spark):
        rows = samples.bars(spark, 3, timestamp={0: None, 1: None})
        assert report(rows, "check_duplicates").first().n_bad == 1

    def test_negative_prices_per_column(self, spark):
        rows = report(samples.bars(spark, open={0: -5.0}), "check_negative_prices")
        assert samples.issues(rows) == ["check_negative_prices: 1 rows with open < 0"]

    def test_gaps(self, spark):
        days = calendar.weekday_calendar(spark, "2024-01-01", "2024-02-01")
        holed = samples.bars(spark, 10).where(~F.col("timestamp").isin(datetime(2024, 1, 4), datetime(2024, 1, 9)))
        rows = report(holed, "check_gaps", calendar=days)
        assert samples.issues(rows) == [
            "check_gaps: AAPL missing 2 NYSE trading days (sample: ['2024-01-04', '2024-01-09'])"
        ]
        weekly = holed.withColumn("timeframe", F.lit("1w"))
        assert samples.passed(report(weekly, "check_gaps", calendar=days))

    @pytest.mark.parametrize("days", [0.5, 3, 30, 400, "even"])
    def test_slices_do_not_change_the_counts(self, spark, days):
        rng = random.Random(7)
        rows = [
            (datetime(2024, 1, 1) + timedelta(hours=rng.randrange(2000)), *(rng.choice([0.0, 90.0, 100.0, 130.0]) for _ in range(4)), 1.0, s, "1h", "p", i)
            for i, s in enumerate(rng.choices("AAAB", k=600))
        ]
        df = spark.createDataFrame(rows, schemas.struct(**{f.name: f.dataType for f in schemas.BARS}, seq="long"))
        firsts: dict = {}
        for r in rows:
            firsts.setdefault((r[6], r[0]), r)
        spikes = {c: 0 for c in schemas.PRICES}
        for symbol in "AB":
            series = [firsts[k] for k in sorted(firsts) if k[0] == symbol]
            for before, bar in zip(series, series[1:]):
                for i, c in enumerate(schemas.PRICES, 1):
                    p = before[4]
                    spikes[c] += p == 0 or abs((bar[i] - p) / p) > 0.2
        days = even_slices(df, "timestamp", rows_per_slice=20) if days == "even" else days
        counts = quality.bar_counts(df, days=days).groupBy().sum().first()
        assert {c: counts[f"sum(spike_{c})"] for c in schemas.PRICES} == spikes
        assert counts["sum(duplicates)"] == len(rows) - len(firsts)

    def test_summary(self, spark):
        bars = samples.bars(spark, 3, volume={0: 0.0}, open={1: -5.0})
        got = quality.summarize(quality.check_bars(bars, checks=["check_negative_prices", "check_zero_volume"])).first()
        assert not got.quality_passed
        assert got.quality_issues == [
            "check_negative_prices: 1 rows with open < 0", "check_zero_volume: 1 bars with volume=0 (warning only)",
        ]


class TestNewsChecks:
    def news(self, spark, headlines, at):
        rows = [(h, at, "AAPL", "news") for h in headlines]
        return spark.createDataFrame(rows, "headline STRING, published_at TIMESTAMP, symbol STRING, provider STRING")

    def test_clean(self, spark):
        assert samples.passed(quality.check_news(self.news(spark, ["a", "b"], datetime(2024, 1, 2)), as_of()))

    def test_future(self, spark):
        rows = quality.check_news(self.news(spark, ["a"], datetime(2024, 6, 2)), as_of())
        assert samples.issues(rows) == ["check_future_timestamps: 1 articles with future published_at"]

    def test_blank(self, spark):
        rows = quality.check_news(self.news(spark, ["", "  ", "a"], datetime(2024, 1, 2)), as_of())
        assert samples.issues(rows) == ["check_empty_headlines: 2 empty headlines (should have been filtered)"]


class TestExpectations:
    def test_split(self, spark):
        bars = samples.bars(spark, 4, low={1: 200.0}, volume={2: -1.0}, timestamp={3: None})
        valid, bad = expectations.split_valid(bars, expectations.bar_expectations())
        assert valid.count() == 1 and valid.schema.fieldNames() == bars.schema.fieldNames()
        assert sorted(r.reasons for r in bad.collect()) == [
            ["high_gte_low"], ["timestamp_present"], ["volume_non_negative"],
        ]

    def test_warnings_do_not_quarantine(self, spark):
        warn = expectations.Expectation("busy", F.col("volume") > 1e12, "warn")
        valid, _ = expectations.split_valid(samples.bars(spark), [warn])
        assert valid.count() == 5
        row = expectations.count_violations(samples.bars(spark), ["symbol"], [warn]).first()
        assert (row.n_bad, row.passed) == (5, True)

    def test_news(self, spark):
        rows = [("a", datetime(2024, 1, 2)), (" ", datetime(2024, 1, 2)), ("b", None)]
        news = spark.createDataFrame(rows, "headline STRING, published_at TIMESTAMP")
        valid, bad = expectations.split_valid(news, expectations.news_expectations())
        assert [r.headline for r in valid.collect()] == ["a"] and bad.count() == 2


class TestCalendar:
    def test_weekdays_without_holidays(self, spark):
        holidays = spark.createDataFrame([(date(2024, 1, 1),)], "day DATE")
        days = calendar.weekday_calendar(spark, "2024-01-01", "2024-01-08", holidays)
        assert sorted(r.day.day for r in days.collect()) == [2, 3, 4, 5, 8]

    @pytest.mark.parametrize("span", [("2024-01-01", "2024-03-01"), ("2024-01-10", "2024-01-20"), ("2025-01-01", "2025-02-01")])
    def test_missing_days_equal_brute_force(self, spark, span):
        """Also where days fall on weekends or outside of the calendar."""
        rng = random.Random(3)
        present = {s: {date(2024, 1, 1) + timedelta(days=rng.randrange(60)) for _ in range(n)} for s, n in (("A", 25), ("B", 2), ("C", 1))}
        rows = [(s, datetime(d.year, d.month, d.day, h)) for s, ds in present.items() for d in ds for h in (0, 9)]
        ticks = spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP")
        days = calendar.weekday_calendar(spark, *span)
        trading = {r.day for r in days.collect()}
        expected = {(s, d) for s, ds in present.items() for d in trading - ds if min(ds) <= d <= max(ds)}
        got = {(r.symbol, r.day) for r in calendar.missing_days(ticks, days, ["symbol"], "ts").collect()}
        assert got == expected
        for r in calendar.gap_summary(ticks, days, ["symbol"], "ts").collect():
            of = sorted(d for s, d in expected if s == r.symbol)
            assert r.n_missing == len(of)
            assert (r.sample or []) == [d.isoformat() for d in of[:5]]

    def test_coverage(self, spark):
        row = calendar.coverage(samples.bars(spark)).first()
        assert (row.first_day, row.last_day, row.n_days) == (date(2024, 1, 2), date(2024, 1, 8), 5)


def test_exchange_days(spark):
    """Easter of two centuries against the church's dates by another rule; holidays of known years."""

    def easter(y: int) -> date:  # the first Sunday after the full moon that a table of golden numbers gives
        golden, century = y % 19 + 1, y // 100 + 1
        moon = (11 * golden + 20 + (8 * century + 5) // 25 - 5 - (3 * century // 4 - 12)) % 30
        moon += 1 if moon == 24 or moon == 25 and golden > 11 else 0
        n = 44 - moon + (30 if 44 - moon < 21 else 0)
        full = date(y, 3, 1) + timedelta(days=n - 1)
        return full + timedelta(days=7 - (full.weekday() + 1) % 7)

    good_friday = spark.createDataFrame([("E", "easter", None, 0, None, None, "none", 1900, 2100)], calendar.RULE)
    got = {r.day for r in calendar.holidays(good_friday, "1901-01-01", "2099-12-31").collect()}
    assert got == {easter(y) for y in range(1900, 2101)}
    closed = calendar.holidays(calendar.holiday_rules(spark), "2021-01-01", "2024-12-31").where("day BETWEEN '2021-01-01' AND '2024-12-31'")
    days = {x: sorted(r.day.isoformat() for r in closed.where(F.col("exchange") == x).collect() if r.day.weekday() < 5) for x in ("XNYS", "XLON")}
    assert days["XNYS"] == [
        "2021-01-01", "2021-01-18", "2021-02-15", "2021-04-02", "2021-05-31", "2021-07-05", "2021-09-06", "2021-11-25", "2021-12-24",
        "2022-01-17", "2022-02-21", "2022-04-15", "2022-05-30", "2022-06-20", "2022-07-04", "2022-09-05", "2022-11-24", "2022-12-26",
        "2023-01-02", "2023-01-16", "2023-02-20", "2023-04-07", "2023-05-29", "2023-06-19", "2023-07-04", "2023-09-04", "2023-11-23", "2023-12-25",
        "2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
    ]
    assert days["XLON"][:8] == ["2021-01-01", "2021-04-02", "2021-04-05", "2021-05-03", "2021-05-31", "2021-08-30", "2021-12-27", "2021-12-28"]
    assert {"2022-01-03", "2022-12-26", "2022-12-27"} <= set(days["XLON"])
    open_ = calendar.exchange_calendar(spark, "2024-01-01", "2024-01-07", closures=spark.sql("SELECT 'XLON' AS exchange, DATE '2024-01-03' AS day"))
    assert {(r.exchange, r.day.day) for r in open_.collect()} == {("XNYS", d) for d in (2, 3, 4, 5)} | {("XLON", d) for d in (2, 4, 5)}
