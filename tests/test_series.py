"""Bars from ticks, first-wins, prior close, outages: against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlake import schemas
from marketlake.operators.outages import outages
from marketlake.operators.resample import TIMEFRAMES, arrival_order, resample_bars
from marketlake.operators.series import dedup_bars, even_slices, with_prior_close
from tests import samples


def random_ticks(n: int = 400):
    """Ticks with many equal times, so that only seq orders them."""
    rng = random.Random(1)
    start = datetime(2024, 1, 29)
    return [
        (rng.choice("AAAB"), start + timedelta(minutes=10 * rng.randrange(600)), seq, float(rng.randrange(100)))
        for seq in rng.sample(range(10_000), n)
    ]


def start_of(ts: datetime, timeframe: str) -> datetime:
    day = ts.replace(hour=0, minute=0)
    if timeframe == "1d":
        return day
    if timeframe == "1w":
        return day - timedelta(days=day.weekday())
    if timeframe == "1m":
        return day.replace(day=1)
    minutes = {"5m": 5, "15m": 15, "30m": 30, "1h": 60}[timeframe]
    passed = (ts - day).seconds // 60
    return day + timedelta(minutes=passed - passed % minutes)


@pytest.mark.parametrize("timeframe", TIMEFRAMES)
def test_resample_equals_brute_force(spark, timeframe):
    rows = random_ticks()
    expected: dict = {}
    for symbol, ts, seq, price in sorted(rows, key=lambda r: (r[1], r[2])):
        expected.setdefault((symbol, start_of(ts, timeframe)), []).append(price)
    ticks = spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP, seq BIGINT, price DOUBLE")
    got = {
        (r.symbol, r.timestamp): (r.open, r.high, r.low, r.close, r.volume, r.timeframe, r.provider)
        for r in resample_bars(ticks.repartition(7), timeframe, "p").collect()
    }
    assert got == {
        k: (v[0], max(v), min(v), v[-1], float(len(v)), timeframe, "p") for k, v in expected.items()
    }


def test_arrival_order_over_all_of_bigint(spark):
    """Time first, then seq over its whole range, nulls before all numbers."""
    late, early = datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1)
    rows = [(early, None), (early, -(2**63)), (early, -1), (early, 0), (early, 2**63 - 1), (late, None), (late, -(2**63)), (late, 2**62 + 5), (datetime(9999, 12, 31), 2**63 - 1)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP, seq BIGINT").withColumn("o", arrival_order(F.col("ts"), "seq"))
    got = [r.o for r in df.collect()]
    assert None not in got and got == sorted(got) and len(set(got)) == len(got)


def test_unknown_timeframe(spark):
    with pytest.raises(ValueError, match="unsupported timeframe"):
        resample_bars(samples.bars(spark), "2d", "p")


def test_resample_carries_providers(spark):
    ticks = spark.createDataFrame(
        [("A", datetime(2024, 1, 1), 1, 5.0, p) for p in "xy"], "symbol STRING, ts TIMESTAMP, seq BIGINT, price DOUBLE, provider STRING"
    )
    assert sorted(r.provider for r in resample_bars(ticks, "1d").collect()) == ["x", "y"]


def test_dedup_keeps_the_first_by_seq(spark):
    df = samples.bars(spark, 2).withColumn("seq", F.lit(5).cast("long"))
    later = df.withColumns({"seq": F.lit(9).cast("long"), "open": F.lit(1.0)})
    no_seq = df.withColumns({"seq": F.lit(None).cast("long"), "open": F.lit(2.0)})
    assert [r.open for r in dedup_bars(later.unionAll(no_seq).unionAll(df)).orderBy("timestamp").collect()] == [41.0, 41.5]


@pytest.mark.parametrize("days", [None, 0.25, 2, 30, "even"])
def test_prior_close_across_slices(spark, days):
    rng = random.Random(2)
    rows = []
    for symbol, n in (("A", 200), ("B", 1), ("C", 40)):
        hours = sorted(rng.sample(range(3000), n))
        rows += [(datetime(2024, 1, 1) + timedelta(hours=h), 1.0, 1.0, 1.0, float(rng.randrange(50)), 1.0, symbol, "1h", "p") for h in hours]
    bars = spark.createDataFrame(rows, schemas.BARS)
    if days == "even":
        days = even_slices(bars, "timestamp", rows_per_slice=10)
    got = with_prior_close(bars, days=days).collect()
    assert len(got) == len(rows)
    by_series = {}
    expected = {}
    for r in rows:
        expected[(r[6], r[0])] = by_series.get(r[6])
        by_series[r[6]] = r[4]
    assert {(r.symbol, r.timestamp): r.prior_close for r in got} == expected


class TestOutages:
    def log(self, spark, rows):
        return spark.createDataFrame(rows, "provider STRING, completed_at TIMESTAMP, status STRING, id BIGINT")

    def brute(self, rows, threshold, gap):
        found = set()
        for provider in {r[0] for r in rows}:
            run: list = []
            for _, at, status, _ in sorted((r for r in rows if r[0] == provider), key=lambda r: (r[1], r[3])) + [(0, None, "success", 0)]:
                ends = status == "success" or (run and (at - run[-1]).total_seconds() > gap)
                if ends:
                    if len(run) >= threshold:
                        found.add((provider, run[0], run[-1], len(run)))
                    run = []
                if status == "failed":
                    run.append(at)
        return found

    @pytest.mark.parametrize("rows_per_slice", [1, 7, 100, 1_000_000])
    def test_equals_brute_force(self, spark, rows_per_slice):
        rng = random.Random(5)
        rows = [
            (rng.choice("PPPQ"), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(20_000)), rng.choice(["failed"] * 6 + ["success"]), i)
            for i in range(1500)
        ]
        got = outages(self.log(spark, rows), ["provider"], ["id"], rows_per_slice=rows_per_slice).collect()
        expected = self.brute(rows, 5, 60)
        assert len(expected) > 10
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)

    def test_exact_threshold_and_gap(self, spark):
        at = [datetime(2024, 1, 1, 23, 59, 0) + timedelta(seconds=60 * i) for i in range(5)]
        rows = [("P", t, "failed", i) for i, t in enumerate(at)]
        assert outages(self.log(spark, rows), ["provider"], ["id"]).first().n_failures == 5
        late = rows[:4] + [("P", at[4] + timedelta(microseconds=1), "failed", 4)]
        assert outages(self.log(spark, late), ["provider"], ["id"]).count() == 0
        broken = rows[:2] + [("P", at[2], "success", 2)] + rows[3:]
        assert outages(self.log(spark, broken), ["provider"], ["id"]).count() == 0
