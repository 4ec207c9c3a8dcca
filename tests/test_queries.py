"""Every registered query of the lake against its oracle, and the shape of the plans that matter at scale.

The training-data queries, where their package is present, have tests of their own.
"""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from marketlake.plans import bar_queries, catalog_queries, feed_queries, lake_queries, provider_queries, text_queries
from tests.compare import compare, connect

MODULES = (bar_queries, text_queries, catalog_queries, lake_queries, feed_queries, provider_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


@pytest.fixture(scope="module")
def oracle(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, oracle, name):
    assert compare(spark, oracle, QUERIES[name], ORACLES[name], sf) is None


def plan(spark, sf, name) -> str:
    df = QUERIES[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bars_5m", "bars_1d", "bars_1m", "dedup_bars", "normalize_bars", "check_duplicates"])
def test_folds_hash_and_combine_before_the_shuffle(spark, sf, name):
    text = plan(spark, sf, name)
    assert "SortAggregate" not in text and "Window" not in text
    assert "partial_" in text


@pytest.mark.parametrize("name", ["normalize_news", "split_valid", "quarantine", "normalize_fundamentals"])
def test_row_by_row_operators_do_not_group(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Aggregate" not in text and "hashpartitioning(symbol" not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(provider_queries.QUERIES)))
def test_no_python_and_no_cartesian_product(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_bars_read_three_columns(spark, sf):
    read = plan(spark, sf, "bars_1d").split("ReadSchema:")[1]
    assert "props" not in read and "event_type" not in read
