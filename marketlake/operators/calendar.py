"""Exchange days and the days a series lacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlake.operators.series import BAR_KEYS


def weekday_calendar(
    spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None
) -> DataFrame:
    """Trading days (``day``) from ``start`` to ``end``: weekdays without the given holidays."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    ).where(F.weekday("day") < 5)
    return days if holidays is None else days.join(holidays.select("day"), "day", "left_anti")


RULE = "exchange STRING, kind STRING, month INT, day INT, weekday INT, nth INT, shift STRING, first_year INT, last_year INT"

# Holidays of two exchanges. kind "date": month and day; "nth": the nth weekday (Monday 0, nth -1: the last) of a
# month; "easter": day days from Easter Sunday. shift: where a holiday on a weekend goes.
HOLIDAY_RULES = (
    ("XNYS", "date", 1, 1, None, None, "sunday", 1900, 9999),
    ("XNYS", "nth", 1, None, 0, 3, "none", 1998, 9999),
    ("XNYS", "nth", 2, None, 0, 3, "none", 1971, 9999),
    ("XNYS", "easter", None, -2, None, None, "none", 1900, 9999),
    ("XNYS", "nth", 5, None, 0, -1, "none", 1971, 9999),
    ("XNYS", "date", 6, 19, None, None, "nearest", 2022, 9999),
    ("XNYS", "date", 7, 4, None, None, "nearest", 1900, 9999),
    ("XNYS", "nth", 9, None, 0, 1, "none", 1900, 9999),
    ("XNYS", "nth", 11, None, 3, 4, "none", 1942, 9999),
    ("XNYS", "date", 12, 25, None, None, "nearest", 1900, 9999),
    ("XLON", "date", 1, 1, None, None, "after", 1974, 9999),
    ("XLON", "easter", None, -2, None, None, "none", 1900, 9999),
    ("XLON", "easter", None, 1, None, None, "none", 1900, 9999),
    ("XLON", "nth", 5, None, 0, 1, "none", 1978, 9999),
    ("XLON", "nth", 5, None, 0, -1, "none", 1971, 9999),
    ("XLON", "nth", 8, None, 0, -1, "none", 1971, 9999),
    ("XLON", "date", 12, 25, None, None, "two", 1900, 9999),
    ("XLON", "date", 12, 26, None, None, "two", 1900, 9999),
)


def holiday_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HOLIDAY_RULES), RULE)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _easter(y: Column) -> Column:
    """Easter Sunday of a Gregorian year, from the moon's age in March (the church's own tables, in numbers)."""
    whole = lambda a, n: F.floor(a / n)
    century = whole(y, 100)
    skipped, moon = century - whole(century, 4), whole(8 * century + 13, 25)
    epact = F.pmod(19 * (y % 19) + skipped - moon + 15, F.lit(30))
    # Two epacts share the last day but one: full moon never falls after April 18.
    epact = _let(epact, lambda e: e - F.when((e == 29) | (e == 28) & (y % 19 > 10), 1).otherwise(0))
    full_moon = F.date_add(F.make_date(y, F.lit(3), F.lit(21)), epact.cast("int"))
    return _let(full_moon, lambda m: F.date_add(m, 7 - F.pmod(F.weekday(m) + 1, F.lit(7))))


def holidays(rules: DataFrame, start: str, end: str) -> DataFrame:
    """(exchange, day) of the rules' holidays; a rule row is its own small table of years, so nothing is joined."""
    years = F.sequence(F.greatest("first_year", F.year(F.lit(start).cast("date")) - 1), F.least("last_year", F.year(F.lit(end).cast("date")) + 1))
    rows = rules.where(F.col("first_year") <= F.year(F.lit(end).cast("date")) + 1).where(F.col("last_year") >= F.year(F.lit(start).cast("date")) - 1)
    rows = rows.withColumn("y", F.explode(years)).withColumn("first", F.make_date("y", F.coalesce("month", F.lit(1)), F.lit(1)))
    ahead = F.date_add("first", (F.pmod(F.col("weekday") - F.weekday("first"), F.lit(7)) + 7 * (F.col("nth") - 1)).cast("int"))
    back = _let(F.last_day("first"), lambda d: F.date_sub(d, F.pmod(F.weekday(d) - F.col("weekday"), F.lit(7)).cast("int")))
    day = (
        F.when(F.col("kind") == "date", F.date_add("first", F.col("day") - 1))
        .when(F.col("kind") == "easter", F.date_add(_easter(F.col("y")), F.col("day")))
        .when(F.col("nth") > 0, ahead)
        .otherwise(back)
    )

    def observed(on: Column) -> Column:
        saturday, sunday = F.weekday(on) == 5, F.weekday(on) == 6
        moved = F.when((F.col("shift") == "nearest") & saturday, -1).when((F.col("shift") == "after") & saturday, 2)
        moved = moved.when((F.col("shift") == "two") & (saturday | sunday), 2)
        return F.date_add(on, moved.when(F.col("shift").isin("nearest", "after", "sunday") & sunday, 1).otherwise(0))

    return rows.select("exchange", _let(day, observed).alias("day")).distinct()


def exchange_calendar(
    spark: SparkSession, start: str, end: str, rules: DataFrame | None = None, closures: DataFrame | None = None
) -> DataFrame:
    """Trading days (exchange, day): weekdays without the rules' holidays and without single ``closures`` (exchange, day)."""
    rules = holiday_rules(spark) if rules is None else rules
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    open_ = rules.select("exchange").distinct().select("exchange", days).where(F.weekday("day") < 5)
    open_ = open_.join(holidays(rules, start, end), ["exchange", "day"], "left_anti")
    return open_ if closures is None else open_.join(closures.select("exchange", "day"), ["exchange", "day"], "left_anti")


def present_days(bars: DataFrame, keys: Sequence[str] = BAR_KEYS, ts: str = "timestamp") -> DataFrame:
    """Distinct (series, day). Folded per map task before the shuffle."""
    return bars.where(F.col(ts).isNotNull()).select(*keys, F.to_date(ts).alias("day")).distinct()


def _with_missing(
    bars: DataFrame, calendar: DataFrame, keys: Sequence[str], ts: str
) -> DataFrame:
    """Per series ``missing``: the sorted trading days between its first and last day that it lacks.

    Rows fold to distinct (series, day) in each map task, and only those days are gathered per series:
    an array with at most one entry per calendar date, as is the calendar's own. Bars are never
    joined to the calendar. Where keys and calendar have an ``exchange``, each series has its own exchange's days; one
    whose exchange has no calendar lacks nothing.
    """
    by_exchange = "exchange" in keys and "exchange" in calendar.columns
    days = F.sort_array(F.collect_set("day"))
    per_series = (
        present_days(bars, keys, ts)
        .groupBy(*keys)
        .agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.collect_list("day").alias("present"))
    )
    if by_exchange:
        per_series = per_series.join(calendar.groupBy("exchange").agg(days.alias("trading")), "exchange", "left")
    else:
        per_series = per_series.withColumn("trading", calendar.agg(days.alias("days")).scalar())
    expected = F.filter("trading", lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))
    # No calendar rows at all leave nothing to miss.
    missing = F.array_except(F.coalesce(expected, F.array().cast("array<date>")), F.col("present"))
    return per_series.select(*keys, missing.alias("missing"))


def missing_days(
    bars: DataFrame, calendar: DataFrame, keys: Sequence[str] = BAR_KEYS, ts: str = "timestamp"
) -> DataFrame:
    """Trading days between a series' first and last day on which it has no row."""
    return _with_missing(bars, calendar, keys, ts).select(*keys, F.explode("missing").alias("day"))


def gap_summary(
    bars: DataFrame, calendar: DataFrame, keys: Sequence[str] = BAR_KEYS, ts: str = "timestamp", sample: int = 5
) -> DataFrame:
    """Per series: the number of missing days and the first few of them (``array<string>``)."""
    first = F.transform(F.slice("missing", 1, sample), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return _with_missing(bars, calendar, keys, ts).select(
        *keys, F.size("missing").cast("long").alias("n_missing"), first.alias("sample")
    )


def coverage(bars: DataFrame, keys: Sequence[str] = BAR_KEYS, ts: str = "timestamp") -> DataFrame:
    """First and last day and the number of days per series."""
    return (
        present_days(bars, keys, ts)
        .groupBy(*keys)
        .agg(
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.count("*").alias("n_days"),
        )
    )
