"""Row expectations: named conditions, folded into one aggregate or split into valid and quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketlake import schemas
from marketlake.functions import count_if, is_blank


@dataclass(frozen=True)
class Expectation:
    """A condition every row should meet; null does not meet it."""

    name: str
    condition: Column
    severity: str = "error"

    def violated(self) -> Column:
        return ~F.coalesce(self.condition, F.lit(False))


def bar_expectations() -> list[Expectation]:
    fields = (*schemas.PRICES, "volume")
    return [
        Expectation("timestamp_present", F.col("timestamp").isNotNull()),
        *(Expectation(f"{c}_non_negative", F.col(c) >= 0) for c in fields),
        Expectation("high_gte_low", F.col("high") >= F.col("low")),
    ]


def news_expectations() -> list[Expectation]:
    return [
        Expectation("published_at_present", F.col("published_at").isNotNull()),
        Expectation("headline_not_empty", F.col("headline").isNotNull() & ~is_blank(F.col("headline"))),
    ]


def with_reasons(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """Add ``reasons``: names of the violated error expectations, in their given order."""
    named = [F.when(e.violated(), F.lit(e.name)) for e in expectations if e.severity == "error"]
    return df.withColumn("reasons", F.array_compact(F.array(*named)))


def split_valid(df: DataFrame, expectations: Sequence[Expectation]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all expectations, the others with their ``reasons``). Row by row, no shuffle."""
    judged = with_reasons(df, expectations)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def count_violations(
    df: DataFrame, keys: Sequence[str], expectations: Sequence[Expectation]
) -> DataFrame:
    """Long report per key: one aggregate for all expectations, one row per expectation."""
    wide = df.groupBy(*keys).agg(
        *(count_if(e.violated()).alias(f"n{i}") for i, e in enumerate(expectations))
    )
    rows = [
        F.struct(F.lit(e.name).alias("check"), F.lit(e.severity).alias("severity"), F.col(f"n{i}").alias("n_bad"))
        for i, e in enumerate(expectations)
    ]
    return wide.select(*keys, F.inline(F.array(*rows))).withColumn(
        "passed", (F.col("n_bad") == 0) | (F.col("severity") == "warn")
    )
