"""Registered queries on bars: resampling, normalizing, range reads, validity and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.functions import abs_pct_change, iso_day, iso_seconds
from marketlake.operators import calendar, expectations, quality
from marketlake.operators.normalize import normalize_bars, split_readable
from marketlake.operators.reads import get_bars
from marketlake.operators.resample import resample_bars
from marketlake.operators.series import dedup_bars, with_prior_close
from marketlake.plans import views
from marketlake.plans.oracle_views import over
from marketlake.schemas import PRICES

_SHOWN = ("symbol", "timestamp", *PRICES, "volume")


def _shown(bars: DataFrame) -> DataFrame:
    return bars.withColumn("timestamp", iso_seconds(F.col("timestamp"))).select(*_SHOWN)


def price_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to daily bars, prior close, and the bars that moved by more than the threshold."""
    daily = with_prior_close(views.bars(spark, sf_dir, "1d"), days=None)
    moved = abs_pct_change(F.col("close"), F.col("prior_close")) > quality.SPIKE_THRESHOLD
    return daily.where(moved).select(
        "symbol", iso_seconds(F.col("timestamp")).alias("timestamp"), *PRICES, "volume", "prior_close"
    )


def _bars(timeframe: str):
    return lambda spark, sf_dir: _shown(views.bars(spark, sf_dir, timeframe))


def prior_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior close over the canonical bars, cut into slices of two days."""
    bars = with_prior_close(views.canonical_bars(spark, sf_dir), days=2)
    return bars.select("symbol", iso_seconds(F.col("timestamp")).alias("timestamp"), "close", "prior_close")


def range_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_bars(views.bars(spark, sf_dir, "1h"), None, "1h", "2024-01-05", "2024-01-20")


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return expectations.split_valid(views.typed_bars(spark, sf_dir), expectations.bar_expectations())


def valid_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = _judged(spark, sf_dir)
    return _shown(valid)


def quarantined_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = _judged(spark, sf_dir)
    return bad.select("symbol", "seq", F.array_join("reasons", ",").alias("reasons"))


def misdated_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol, what became of every row of a feed with times in several forms: folded into bars, or unreadable."""
    readable, rest = split_readable(views.misdated_bars(spark, sf_dir))
    symbol = F.upper("symbol").alias("symbol")
    counts = readable.groupBy(symbol).agg(F.count("*").alias("n_readable"))
    unread = rest.groupBy(symbol).agg(F.count("*").alias("n_unreadable"))
    bars = normalize_bars(readable).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.sum("volume").alias("volume"))
    every = counts.join(unread, "symbol", "full").join(bars, "symbol", "full")
    return every.select("symbol", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_readable", "n_unreadable", "n_bars")), "volume")


def expectation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectations.count_violations(
        views.typed_bars(spark, sf_dir), ["symbol"], expectations.bar_expectations()
    )


def _check(check: str, copies: bool = True):
    """One check over the typed bars with their copies, or over the canonical ones."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = views.typed_bars(spark, sf_dir) if copies else views.canonical_bars(spark, sf_dir)
        return quality.check_bars(bars, checks=[check]).select(
            "symbol", "check", F.coalesce("field", F.lit("")).alias("field"), "n_bad", "passed"
        )

    return query


def bar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the canonical bars, folded to one row per series."""
    bars = views.canonical_bars(spark, sf_dir)
    report = quality.check_bars(bars, views.user_calendar(spark, sf_dir), days=2)
    return quality.summarize(report).select(
        "symbol", "quality_passed", F.array_join("quality_issues", "; ").alias("issues")
    )


def _user_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ticks(spark, sf_dir, "user_id")


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.missing_days(_user_ticks(spark, sf_dir), views.user_calendar(spark, sf_dir), ["symbol"], "ts")
    return days.select("symbol", iso_day(F.col("day")).alias("day"))


def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = calendar.gap_summary(_user_ticks(spark, sf_dir), views.user_calendar(spark, sf_dir), ["symbol"], "ts")
    return gaps.select("symbol", "n_missing", F.coalesce(F.array_join("sample", ","), F.lit("")).alias("sample"))


def exchange_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing days of symbols of two exchanges, each by its own calendar."""
    ticks = _user_ticks(spark, sf_dir).withColumn("exchange", F.expr("if(substr(symbol, 2) % 2 = 0, 'XNYS', 'XLON')"))
    days = calendar.missing_days(ticks, views.exchange_days(spark, sf_dir), ["symbol", "exchange"], "ts")
    return days.select("symbol", "exchange", iso_day(F.col("day")).alias("day"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.coverage(_user_ticks(spark, sf_dir), ["symbol"], "ts")
    return days.select("symbol", iso_day(F.col("first_day")).alias("first_day"), iso_day(F.col("last_day")).alias("last_day"), "n_days")


QUERIES = {
    "price_spikes": price_spikes,
    **{f"bars_{t}": _bars(t) for t in ("5m", "15m", "30m", "1h", "1d", "1w", "1m")},
    "misdated_bars": misdated_bars,
    "normalize_bars": lambda spark, sf_dir: _shown(views.canonical_bars(spark, sf_dir)),
    "dedup_bars": lambda spark, sf_dir: _shown(dedup_bars(views.typed_bars(spark, sf_dir))),
    "prior_close": prior_close,
    "range_bars": range_bars,
    "split_valid": valid_bars,
    "quarantine": quarantined_bars,
    "expectation_report": expectation_report,
    "check_duplicates": _check("check_duplicates"),
    "check_negative_prices": _check("check_negative_prices"),
    "check_price_range": _check("check_price_range"),
    "check_zero_volume": _check("check_zero_volume"),
    "check_price_spike": _check("check_price_spike", copies=False),
    "check_bars_report": bar_report,
    "missing_days": missing_days,
    "gap_summary": gap_summary,
    "exchange_gaps": exchange_gaps,
    "coverage": coverage,
}

_BAR = """symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, open, high, low, close, volume"""


def _resampled(start: str) -> str:
    return over(["ticks"], f"""
        SELECT symbol, strftime({start}, '%Y-%m-%dT%H:%M:%S') AS timestamp, first(price ORDER BY ts, seq) AS open,
               max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
               CAST(count(*) AS DOUBLE) AS volume
        FROM ticks GROUP BY 1, 2""")


# When New York was closed on weekdays of the year the events are of.
_CLOSED = (
    "('2024-01-01', '2024-01-15', '2024-02-19', '2024-03-29', '2024-05-27', '2024-06-19', '2024-07-04', '2024-09-02', "
    "'2024-11-28', '2024-12-25')"
)
_DAYS = f"""
    days AS (SELECT DISTINCT 'S' || user_id AS symbol, CAST(ts AS DATE) AS day FROM events),
    calendar AS (
        SELECT CAST(d AS DATE) AS day
        FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events)
        WHERE isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN {_CLOSED}),
    spans AS (SELECT symbol, min(day) AS lo, max(day) AS hi FROM days GROUP BY symbol),
    missing AS (
        SELECT s.symbol, c.day FROM spans s JOIN calendar c ON c.day BETWEEN s.lo AND s.hi
        ANTI JOIN days d ON d.symbol = s.symbol AND d.day = c.day)
"""


def _spiked(c: str, p: str = "prior_close") -> str:
    return (
        f"({p} IS NOT NULL AND CASE WHEN {p} = 0 THEN true ELSE abs(({c} - {p}) / {p}) > 0.2 END)"
    )


def _per_field(fields: dict[str, str], check: str, source: str, warn: bool = False) -> str:
    """One row per symbol and field: how many rows meet the field's condition."""
    parts = [
        f"SELECT symbol, '{check}' AS \"check\", '{field}' AS field, count(*) FILTER (WHERE {condition}) AS n_bad "
        f"FROM {source} GROUP BY symbol"
        for field, condition in fields.items()
    ]
    passed = "true" if warn else "n_bad = 0"
    return f"SELECT *, {passed} AS passed FROM ({' UNION ALL '.join(parts)})"


_LAGGED = "(SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS prior_close FROM canonical_bars)"
_REASONS = {
    **{f"{c}_non_negative": f"coalesce({c} < 0, true)" for c in (*PRICES, "volume")},
    "high_gte_low": "coalesce(high < low, true)",
}

ORACLES = {
    "price_spikes": over(["bars_1d"], f"""
        SELECT {_BAR}, prior_close
        FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS prior_close FROM bars_1d)
        WHERE {_spiked('close')}"""),
    "bars_5m": _resampled("time_bucket(INTERVAL 5 MINUTE, ts)"),
    "bars_15m": _resampled("time_bucket(INTERVAL 15 MINUTE, ts)"),
    "bars_30m": _resampled("time_bucket(INTERVAL 30 MINUTE, ts)"),
    "bars_1h": _resampled("date_trunc('hour', ts)"),
    "bars_1d": _resampled("date_trunc('day', ts)"),
    "bars_1w": _resampled("date_trunc('week', ts)"),
    "bars_1m": _resampled("date_trunc('month', ts)"),
    "normalize_bars": over(["canonical_bars"], f"SELECT {_BAR} FROM canonical_bars"),
    "misdated_bars": over(["typed_bars"], """
        , unread AS (
            SELECT 'S' || (user_id % 20) AS symbol, count(*) AS n,
                   count(*) FILTER (WHERE event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0) AS bad
            FROM events GROUP BY 1),
        bars AS (
            SELECT symbol, count(*) AS n_bars, sum(volume) AS volume FROM (
                SELECT *, row_number() OVER (PARTITION BY symbol, timestamp ORDER BY seq) AS rn FROM typed_bars
                WHERE seq % 31 <> 0 AND seq % 37 <> 0 AND seq % 41 <> 0)
            WHERE rn = 1 GROUP BY symbol)
        SELECT symbol, n - bad AS n_readable, bad AS n_unreadable, coalesce(n_bars, 0) AS n_bars, volume
        FROM unread LEFT JOIN bars USING (symbol)"""),
    "dedup_bars": over(["canonical_bars"], f"SELECT {_BAR} FROM canonical_bars"),
    "prior_close": over(["canonical_bars"], f"""
        SELECT symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, close, prior_close FROM {_LAGGED}"""),
    "range_bars": over(["bars_1h"], f"""
        SELECT {_BAR} FROM bars_1h
        WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20'"""),
    "split_valid": over(["typed_bars"], f"""
        SELECT {_BAR} FROM typed_bars
        WHERE open >= 0 AND high >= 0 AND low >= 0 AND close >= 0 AND volume >= 0 AND high >= low"""),
    "quarantine": over(["typed_bars"], f"""
        SELECT symbol, seq, reasons
        FROM (SELECT symbol, seq, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _REASONS.items())}) AS reasons
              FROM typed_bars)
        WHERE reasons <> ''"""),
    "expectation_report": over(["typed_bars"], """
        SELECT *, n_bad = 0 AS passed FROM (
        """ + " UNION ALL ".join(
            f"SELECT symbol, '{n}' AS \"check\", 'error' AS severity, count(*) FILTER (WHERE {c}) AS n_bad FROM typed_bars GROUP BY symbol"
            for n, c in {"timestamp_present": "timestamp IS NULL", **_REASONS}.items()
        ) + ")"),
    "check_duplicates": over(["typed_bars"], """
        SELECT symbol, 'check_duplicates' AS "check", '' AS field, count(*) - count(DISTINCT timestamp) AS n_bad,
               count(*) = count(DISTINCT timestamp) AS passed
        FROM typed_bars GROUP BY symbol"""),
    "check_negative_prices": over(
        ["typed_bars"], _per_field({c: f"{c} < 0" for c in PRICES}, "check_negative_prices", "typed_bars")),
    "check_price_range": over(["typed_bars"], _per_field(
        {"high": "high < low", "close": "close < low OR close > high"}, "check_price_range", "typed_bars")),
    "check_zero_volume": over(
        ["typed_bars"], _per_field({"volume": "volume = 0"}, "check_zero_volume", "typed_bars", warn=True)),
    "check_price_spike": over(
        ["canonical_bars"], _per_field({c: _spiked(c) for c in PRICES}, "check_price_spike", _LAGGED)),
    "check_bars_report": over(["canonical_bars"], f"""
        , calendar AS (
            SELECT CAST(d AS DATE) AS day FROM (
                SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events)
            WHERE isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN {_CLOSED}),
        spans AS (SELECT symbol, min(CAST(timestamp AS DATE)) AS lo, max(CAST(timestamp AS DATE)) AS hi FROM canonical_bars GROUP BY symbol),
        missing AS (
            SELECT s.symbol, c.day FROM spans s JOIN calendar c ON c.day BETWEEN s.lo AND s.hi
            ANTI JOIN (SELECT DISTINCT symbol, CAST(timestamp AS DATE) AS day FROM canonical_bars) d
                ON d.symbol = s.symbol AND d.day = c.day),
        found AS (
            SELECT symbol, position, message FROM (
                SELECT symbol, 1 + i AS position, n, 'check_negative_prices: ' || n || ' rows with ' || f || ' < 0' AS message FROM (
                    {' UNION ALL '.join(f"SELECT symbol, {i} AS i, '{c}' AS f, count(*) FILTER (WHERE {c} < 0) AS n FROM canonical_bars GROUP BY symbol" for i, c in enumerate(PRICES))})
                UNION ALL
                SELECT symbol, 5, n, 'check_price_range: ' || n || ' rows where high < low' FROM (
                    SELECT symbol, count(*) FILTER (WHERE high < low) AS n FROM canonical_bars GROUP BY symbol)
                UNION ALL
                SELECT symbol, 6, n, 'check_price_range: ' || n || ' rows where close is outside [low, high]' FROM (
                    SELECT symbol, count(*) FILTER (WHERE close < low OR close > high) AS n FROM canonical_bars GROUP BY symbol)
                UNION ALL
                SELECT symbol, 7, n, 'check_zero_volume: ' || n || ' bars with volume=0 (warning only)' FROM (
                    SELECT symbol, count(*) FILTER (WHERE volume = 0) AS n FROM canonical_bars GROUP BY symbol)
                UNION ALL
                SELECT symbol, 8 + i, n, 'check_price_spike: ' || n || ' ' || f || ' values differ from prior close by >20%' FROM (
                    {' UNION ALL '.join(f"SELECT symbol, {i} AS i, '{c}' AS f, count(*) FILTER (WHERE {_spiked(c)}) AS n FROM {_LAGGED} GROUP BY symbol" for i, c in enumerate(PRICES))})
                UNION ALL
                SELECT symbol, 12, n, 'check_gaps: ' || symbol || ' missing ' || n || ' NYSE trading days (sample: [' || days || '])' FROM (
                    SELECT symbol, count(*) AS n, string_agg('''' || day || '''', ', ' ORDER BY day) FILTER (WHERE r <= 5) AS days
                    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS r FROM missing) GROUP BY symbol)
            ) WHERE n > 0)
        SELECT b.symbol, count(*) FILTER (WHERE position <> 7) = 0 AS quality_passed,
               coalesce(string_agg(message, '; ' ORDER BY position), '') AS issues
        FROM (SELECT DISTINCT symbol FROM canonical_bars) b LEFT JOIN found f ON f.symbol = b.symbol
        GROUP BY b.symbol"""),
    "missing_days": f"WITH {_DAYS} SELECT symbol, strftime(day, '%Y-%m-%d') AS day FROM missing",
    "exchange_gaps": f"""
        WITH {_DAYS.replace(f"NOT IN {_CLOSED}", "<> '2024-01-01'")}
        SELECT symbol, CASE WHEN substr(symbol, 2)::INTEGER % 2 = 0 THEN 'XNYS' ELSE 'XLON' END AS exchange, strftime(day, '%Y-%m-%d') AS day
        FROM missing WHERE exchange = 'XLON' OR strftime(day, '%Y-%m-%d') NOT IN {_CLOSED}""",
    "gap_summary": f"""
        WITH {_DAYS},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS r FROM missing)
        SELECT s.symbol, count(r.day) AS n_missing,
               coalesce(string_agg(strftime(r.day, '%Y-%m-%d'), ',' ORDER BY r.day) FILTER (WHERE r.r <= 5), '') AS sample
        FROM spans s LEFT JOIN ranked r ON r.symbol = s.symbol GROUP BY s.symbol""",
    "coverage": f"""
        WITH {_DAYS}
        SELECT symbol, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day,
               count(*) AS n_days
        FROM days GROUP BY symbol""",
}
