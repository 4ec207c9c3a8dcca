"""Quality checks. They count bad rows per series and drop nothing.

Reports are long: ``(series…, position, check, field, severity, n_bad, passed, message)``; a message
is null when there is nothing to say. ``summarize`` folds them to one row per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlake.functions import abs_pct_change, count_if, is_blank
from marketlake.operators.calendar import gap_summary
from marketlake.operators.resample import TIMEFRAMES
from marketlake.operators.series import BAR_KEYS, SLICE_DAYS, first_by_seq, time_slice
from marketlake.schemas import PRICES

SPIKE_THRESHOLD = 0.20

#: Timeframes on which a bar is due every exchange day.
GAP_TIMEFRAMES = tuple(t for t in TIMEFRAMES if t not in ("1w", "1m"))

BAR_CHECKS = (
    "check_duplicates", "check_negative_prices", "check_price_range", "check_zero_volume", "check_price_spike",
    "check_gaps",
)

# Message formats of the checks, in the order in which the checks run.
MESSAGES = {
    "check_duplicates": "check_duplicates: %d duplicate timestamps found",
    "check_negative_prices": "check_negative_prices: %d rows with {field} < 0",
    "check_price_range:high_low": "check_price_range: %d rows where high < low",
    "check_price_range:close": "check_price_range: %d rows where close is outside [low, high]",
    "check_zero_volume": "check_zero_volume: %d bars with volume=0 (warning only)",
    "check_price_spike": "check_price_spike: %d {field} values differ from prior close by >{percent}%%",
    "check_gaps": "check_gaps: %s missing %d NYSE trading days (sample: [%s])",
    "check_future_timestamps": "check_future_timestamps: %d articles with future published_at",
    "check_empty_headlines": "check_empty_headlines: %d empty headlines (should have been filtered)",
}


def _finding(position: int, check: str, field: str | None, n: Column, message: Column, severity: str = "error") -> Column:
    found = n > 0
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(check).alias("check"),
        F.lit(field).cast("string").alias("field"),
        F.lit(severity).alias("severity"),
        n.alias("n_bad"),
        (~found | F.lit(severity == "warn")).alias("passed"),
        F.when(found, message).alias("message"),
    )


def _row_counts(checks: Sequence[str]) -> dict[str, Column]:
    """Counts that need no other row, as aggregates."""
    counts = {}
    if "check_negative_prices" in checks:
        counts |= {f"neg_{c}": count_if(F.col(c) < 0) for c in PRICES}
    if "check_price_range" in checks:
        outside = (F.col("close") < F.col("low")) | (F.col("close") > F.col("high"))
        counts |= {"high_lt_low": count_if(F.col("high") < F.col("low")), "close_outside": count_if(outside)}
    if "check_zero_volume" in checks:
        counts["zero_volume"] = count_if(F.col("volume") == 0)
    return counts


def bar_counts(
    bars: DataFrame,
    checks: Sequence[str] = BAR_CHECKS,
    threshold: float = SPIKE_THRESHOLD,
    keys: Sequence[str] = BAR_KEYS,
    days: float | Column = SLICE_DAYS,
) -> DataFrame:
    """The wanted bar checks as one wide row of counts per series; only what they need is computed.

    Row-level counts alone are one aggregate. Duplicates add a fold to one row per (series,
    timestamp): map-side first, so copies collapse before they move, and without a new shuffle on a
    table that ``dedup_bars`` just made. Spikes then work inside (series, time slice), and a last step
    over one row per slice compares the first bar of a slice with the close before it.

    Spikes are measured on the series as it would be stored, the first row per timestamp. ``days`` is
    the slice width; for bars off their grid, ``even_slices(bars, "timestamp")`` fits it to the data.
    """
    row_counts = _row_counts(checks)
    add_up = [F.sum(c).alias(c) for c in row_counts]
    spikes = "check_price_spike" in checks
    if not spikes and "check_duplicates" not in checks:
        return bars.groupBy(*keys).agg(
            F.count("*").alias("rows"), *(n.alias(c) for c, n in row_counts.items())
        )

    has_seq = "seq" in bars.columns
    firsts = [first_by_seq(c, has_seq).alias(c) for c in PRICES] if spikes else []
    folded = bars.groupBy(*keys, "timestamp").agg(
        F.count("*").alias("n"), *firsts, *(n.alias(c) for c, n in row_counts.items())
    )
    if not spikes:
        return folded.groupBy(*keys).agg(
            F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("duplicates"), *add_up
        )

    in_slice = Window.partitionBy(*keys, "slice").orderBy("timestamp")
    moves = (
        folded.withColumn("slice", time_slice(F.col("timestamp"), days))
        .withColumn("bar", F.row_number().over(in_slice))
        .withColumn("prior", F.lag("close").over(in_slice))
    )
    slices = moves.groupBy(*keys, "slice").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("n_timestamps"),
        *add_up,
        *(count_if(abs_pct_change(F.col(c), F.col("prior")) > threshold).alias(f"spike_{c}") for c in PRICES),
        *(F.max(F.when(F.col("bar") == 1, F.col(c))).alias(f"head_{c}") for c in PRICES),
        F.max_by("close", "bar").alias("last_close"),
    )
    before = F.lag("last_close").over(Window.partitionBy(*keys).orderBy("slice"))
    edges = slices.withColumn("before", before)
    spiked = {
        c: F.col(f"spike_{c}")
        + F.when(abs_pct_change(F.col(f"head_{c}"), F.col("before")) > threshold, 1).otherwise(0)
        for c in PRICES
    }
    return edges.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        (F.sum("rows") - F.sum("n_timestamps")).alias("duplicates"),
        *add_up,
        *(F.sum(expr).alias(f"spike_{c}") for c, expr in spiked.items()),
    )


def check_bars(
    bars: DataFrame,
    calendar: DataFrame | None = None,
    checks: Sequence[str] = BAR_CHECKS,
    threshold: float = SPIKE_THRESHOLD,
    keys: Sequence[str] = BAR_KEYS,
    gap_timeframes: Sequence[str] = GAP_TIMEFRAMES,
    days: float | Column = SLICE_DAYS,
) -> DataFrame:
    """Long report of the wanted bar checks. Gaps are checked when a calendar is given."""
    wide = bar_counts(bars, checks, threshold, keys, days)
    percent = f"{threshold * 100:.0f}"
    spike, negative = MESSAGES["check_price_spike"], MESSAGES["check_negative_prices"]
    # (check, field, column of the count, message), in report order.
    plan = [
        ("check_duplicates", None, "duplicates", MESSAGES["check_duplicates"]),
        *(("check_negative_prices", c, f"neg_{c}", negative.format(field=c)) for c in PRICES),
        ("check_price_range", "high", "high_lt_low", MESSAGES["check_price_range:high_low"]),
        ("check_price_range", "close", "close_outside", MESSAGES["check_price_range:close"]),
        ("check_zero_volume", "volume", "zero_volume", MESSAGES["check_zero_volume"]),
        *(("check_price_spike", c, f"spike_{c}", spike.format(field=c, percent=percent)) for c in PRICES),
    ]
    findings = [
        _finding(
            position, check, field, F.col(count), F.format_string(message, count),
            "warn" if check == "check_zero_volume" else "error",
        )
        for position, (check, field, count, message) in enumerate(plan)
        if check in checks
    ]
    if calendar is not None and "check_gaps" in checks:
        due = bars.where(F.col("timeframe").isin(*gap_timeframes)) if "timeframe" in bars.columns else bars
        wide = wide.join(gap_summary(due, calendar, keys), list(keys), "left")
        sample = F.array_join(F.transform("sample", lambda d: F.concat(F.lit("'"), d, F.lit("'"))), ", ")
        missing = F.coalesce("n_missing", F.lit(0))
        message = F.format_string(MESSAGES["check_gaps"], F.col("symbol"), missing, sample)
        findings.append(_finding(len(plan), "check_gaps", None, missing, message))
    return wide.select(*keys, F.inline(F.array(*findings)))


def check_news(news: DataFrame, as_of: Column, keys: Sequence[str] = ("symbol", "provider")) -> DataFrame:
    """Long report of the news checks; ``as_of`` stands for now. One aggregate, folded map-side."""
    wide = news.groupBy(*keys).agg(
        count_if(F.col("published_at") > as_of).alias("future"),
        count_if(is_blank(F.col("headline"))).alias("blank"),
    )
    findings = [
        _finding(i, check, field, F.col(n), F.format_string(MESSAGES[check], n))
        for i, (check, field, n) in enumerate(
            [("check_future_timestamps", "published_at", "future"), ("check_empty_headlines", "headline", "blank")]
        )
    ]
    return wide.select(*keys, F.inline(F.array(*findings)))


def summarize(report: DataFrame, keys: Sequence[str] = BAR_KEYS) -> DataFrame:
    """One row per series: did all checks pass, and the messages in check order (at most 13)."""
    return report.groupBy(*keys).agg(
        F.bool_and("passed").alias("quality_passed"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("position", "message")))),
            lambda m: m["message"],
        ).alias("quality_issues"),
    )
