"""Small deterministic inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from marketlake import schemas

FIRST_DAY = datetime(2024, 1, 2)


def business_days(n: int) -> list[datetime]:
    days, day = [], FIRST_DAY
    while len(days) < n:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    return days


def values(i: int) -> tuple[float, float, float, float, float]:
    """Open, high, low, close and volume of the bar of day ``i``: a slow zigzag, exact in binary."""
    opened = 41.0 + (i % 4) * 0.5
    return opened, opened + 1.5, opened - 0.75, opened + 0.25, 1_200.0 + 35 * i


def raw_bars(spark: SparkSession, n: int = 5, copies: int = 1) -> DataFrame:
    rows = [(d.strftime("%Y-%m-%d"), *values(i)[:4], int(values(i)[4])) for i, d in enumerate(business_days(n))] * copies
    return spark.createDataFrame(
        [(*r, seq) for seq, r in enumerate(rows)],
        "Date STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume BIGINT, seq BIGINT",
    )


def bars(spark: SparkSession, n: int = 5, **changes: dict[int, float]) -> DataFrame:
    """Clean canonical bars; ``close={2: 9.0}`` changes the close of the third one."""
    rows = []
    for i, day in enumerate(business_days(n)):
        row = dict(zip(("open", "high", "low", "close", "volume"), values(i), strict=True))
        row |= {"timestamp": day, "symbol": "AAPL", "timeframe": "1d", "provider": "yahoo"}
        row |= {column: by_row[i] for column, by_row in changes.items() if i in by_row}
        rows.append(tuple(row[f] for f in schemas.BARS.fieldNames()))
    return spark.createDataFrame(rows, schemas.BARS)


def raw_news(spark: SparkSession, headlines: list[str | None]) -> DataFrame:
    start = datetime(2024, 1, 3, 9, 5)
    rows = [
        (h, (start + timedelta(minutes=50 * i)).strftime("%Y-%m-%dT%H:%M:%SZ"), "wire desk", f"https://desk.example/a{i}")
        for i, h in enumerate(headlines)
    ]
    return spark.createDataFrame(rows, "headline STRING, published_at STRING, source STRING, url STRING")


def raw_macro(spark: SparkSession, n: int = 12) -> DataFrame:
    rows = [(f"2023-{i + 1:02d}-01", 12.5 - 0.25 * i) for i in range(n)]
    return spark.createDataFrame(rows, "date STRING, value DOUBLE")


def issues(report: DataFrame) -> list[str]:
    return [r.message for r in report.orderBy("position").collect() if r.message]


def passed(report: DataFrame) -> bool:
    return all(r.passed for r in report.collect())
