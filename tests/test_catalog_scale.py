"""Deep pages, lookups by hash and day sets."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlake import schemas
from marketlake.operators import calendar, catalog, day_sets
from marketlake.sinks.store import write_catalog
from marketlake.sources.lake import lookup_hashes

ROW = "hash STRING, created_at TIMESTAMP"


def registry(spark, n=3000):
    """Many moments, one that a third of all rows share, some without a moment or a hash."""
    at = datetime(2024, 1, 1)
    rows = [(f"{i * 7919 % 65536:04x}", at if i % 3 == 0 else None if i % 50 == 1 else at + timedelta(microseconds=i * i * 31)) for i in range(n)]
    return spark.createDataFrame([*rows, (None, at), (None, None)], ROW)


@pytest.mark.parametrize("rows_at_once", [7, 100, 100_000])
def test_deep_pages_are_the_pages(spark, rows_at_once):
    df = registry(spark)
    order = [tuple(r) for r in df.orderBy(F.desc("created_at"), F.coalesce("hash", F.lit(""))).collect()]
    for offset in (0, 1, 999, 2000, 2500, 2990, 3001):
        got = [tuple(r) for r in catalog.deep_page(df, 20, offset, rows_at_once).collect()]
        assert [(r[1], r[0] or "") for r in got] == [(r[1], r[0] or "") for r in order[offset : offset + 20]], offset
    assert catalog.deep_page(df, 20, 5000).count() == 0 and catalog.deep_page(df.limit(0), 20).count() == 0
    with pytest.raises(ValueError):
        catalog.deep_page(df, 0)


def test_no_task_holds_what_comes_before_the_page(spark):
    df = registry(spark)
    plan = catalog.deep_page(df, 20, 2800, 50)._jdf.queryExecution().executedPlan().toString()
    assert int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= 70


def test_lookups_pass_over_row_groups(spark, folder):
    rows = spark.range(0, 200_000, 1, 4).select(
        F.sha2(F.col("id").cast("string"), 256).alias("hash"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.REGISTRY if f.name not in ("hash", "rows")), F.col("id").alias("rows"),
    )
    write_catalog(rows, "registry", folder, "r1", **{"parquet.block.size": str(1 << 20)})
    wanted = [r.hash for r in rows.where("rows in (5, 77777)").select("hash").collect()]
    found = lookup_hashes(spark, folder, [*wanted, "no such hash"]).select("hash", "rows")
    assert sorted(r.rows for r in found.collect()) == [5, 77777]

    def scanned(df) -> int:
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan()
        plan.execute().count()
        scan = plan.collectLeaves().apply(0)
        return scan.metrics().apply("numOutputRows").value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert scanned(lookup_hashes(spark, folder, wanted).select("hash", "rows")) < 100_000
        spark.conf.set("spark.sql.parquet.filterPushdown", "false")
        assert scanned(lookup_hashes(spark, folder, wanted).select("hash", "rows")) == 200_000
    finally:
        spark.conf.set("spark.sql.parquet.filterPushdown", "true")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_day_sets_merge_to_the_coverage(spark):
    days = [date(1969, 12, 30), date(1970, 1, 1), date(2024, 1, 2), date(2024, 1, 2), date(2024, 1, 5), date(2060, 5, 5), date(2090, 1, 1)]
    rows = [(s, "1d", "p", datetime(d.year, d.month, d.day, 5)) for s, own in (("A", days), ("B", days[2:5])) for d in own] + [("B", "1d", "p", None)]
    bars = spark.createDataFrame(rows, "symbol STRING, timeframe STRING, provider STRING, timestamp TIMESTAMP")
    runs = [day_sets.day_sets(bars.where(F.pmod(F.xxhash64("timestamp"), F.lit(2)) == k)) for k in range(2)]
    sets = runs[0].unionByName(runs[1]).unionByName(runs[0])
    order = ["symbol"]
    assert day_sets.covered(sets).orderBy(order).collect() == calendar.coverage(bars).orderBy(order).collect()
    weekdays = calendar.weekday_calendar(spark, "1969-12-01", "2024-01-31")
    same = lambda df: sorted((r.symbol, r.day) for r in df.collect())
    assert same(day_sets.missing_days(sets, weekdays)) == same(calendar.missing_days(bars, weekdays))
    assert day_sets.covered(sets.limit(0)).count() == 0 and day_sets.missing_days(sets.limit(0), weekdays).count() == 0
    assert day_sets.missing_days(sets, weekdays.limit(0)).count() == 0
