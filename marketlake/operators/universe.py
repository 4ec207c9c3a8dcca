"""Which symbols exist, overall and per provider."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def symbol_universe(*tables: DataFrame) -> DataFrame:
    """Distinct (provider, symbol) over tables; each is reduced before the union."""
    pairs = [t.select("provider", "symbol").distinct() for t in tables]
    return reduce(DataFrame.unionByName, pairs).where(F.col("symbol").isNotNull()).distinct()


def all_symbols(universe: DataFrame) -> DataFrame:
    """The sorted union over providers."""
    return universe.select("symbol").distinct().orderBy("symbol")


def symbols_of(universe: DataFrame, provider: str, registered: tuple[str, ...] | None = None) -> DataFrame:
    """Symbols of one provider; a provider that is not registered is an error."""
    if registered is not None and provider not in registered:
        raise KeyError(f"provider {provider!r} is not registered; one of {', '.join(registered)}")
    return universe.where(F.col("provider") == provider).select("symbol").orderBy("symbol")


def symbol_lists(universe: DataFrame, buckets: int = 64) -> DataFrame:
    """Sorted arrays of distinct symbols per (provider, bucket), for delivery as lists.

    ``buckets`` splits a provider by symbol hash, so that no single row has to hold all its symbols.
    """
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int").alias("bucket")
    return universe.groupBy("provider", bucket).agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
