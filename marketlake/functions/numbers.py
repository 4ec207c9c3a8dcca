"""Numeric parsing and arithmetic with the defined results for bad input and zero divisors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Java accepts a trailing type letter ("1.0d", "2f") as part of a number; a feed must not.
_NOT_A_NUMBER = r"(?i)[0-9.][df]\s*$"
_MISSING = r"(?i)([0-9.][df]|nan)\s*$"


def safe_double(c: Column) -> Column:
    """Any value to double; what is not a number becomes null. NaN stays NaN."""
    text = c.cast("string")
    return F.when(~text.rlike(_NOT_A_NUMBER), text.try_cast("double"))


def to_double(c: Column) -> Column:
    """As :func:`safe_double`, and NaN counts as missing."""
    text = c.cast("string")
    return F.when(~text.rlike(_MISSING), text.try_cast("double"))


def numeric_column(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as double with missing for NaN; numbers skip the text route."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return to_double(F.col(name))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to null over every floating column, for delivery."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats})


def count_if(condition: Column) -> Column:
    """Number of rows where the condition is true, with a fixed-width buffer (hash aggregation)."""
    return F.count(F.when(condition, F.lit(1)))


def abs_pct_change(value: Column, prior: Column) -> Column:
    """|value - prior| / |prior|; infinite for a move away from zero, NaN for zero to zero."""
    return (
        F.when(prior.isNull() | value.isNull(), None)
        .when((prior == 0) & (value == 0), F.lit(float("nan")))
        .when(prior == 0, F.lit(float("inf")))
        .otherwise(F.abs((value - prior) / F.when(prior != 0, prior)))
    )
