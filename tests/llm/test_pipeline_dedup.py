"""The pipeline's near_dedup stage against brute force over all pairs of SimHash words."""

from __future__ import annotations

import corpus_pipeline
from marketlake.llm import simhash
from tests.llm import brute
from tests.llm.test_operators import DOCS, none, odd, prose  # noqa: F401


def _kept(rows) -> list[tuple]:
    """One (doc_id, text) per component: the smallest doc_id; of its texts there, the smallest word, then text."""
    named = [r for r in rows if r.doc_id is not None]
    prints = [brute.simhash(r.text) for r in named]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    groups: dict = {}
    for k, root in enumerate(brute.components(list(range(len(named))), prints)):
        groups.setdefault(root, []).append((named[k].doc_id, signed[k], named[k].text is not None, named[k].text or ""))
    first = [min(g) for g in groups.values()]
    return sorted((d, t if there else None) for d, _, there, t in first) + [(None, r.text) for r in rows if r.doc_id is None]


def _rows(df):
    out = [(r.doc_id, r.text) for r in df.collect()]
    return sorted([r for r in out if r[0] is not None], key=repr), sorted([r for r in out if r[0] is None], key=repr)


def test_stage_keeps_one_of_each_component(spark, odd):  # noqa: F811
    near = [prose(40, 400).replace("alpha", "beta", k) for k in range(6)]
    rows = [*(tuple(r) for r in odd.collect()), *((100 + k, t, "en", "a", 1) for k, t in enumerate(near))]
    # A third of all rows share one id and one text; one id has two unlike texts; one row has no id.
    rows += [(7000, prose(41, 50), "en", "a", 1)] * 14 + [(5, prose(42, 60), "en", "a", 1), (None, prose(43, 9), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    want = _kept(docs.collect())
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert _rows(got) == (sorted(want[:-1], key=repr), want[-1:])
    clashing = docs.selectExpr("*", "n_chars AS fp", "lang AS _id", "source AS _fp", "text AS _row", "doc_id AS root")
    assert simhash.deduplicated(clashing).count() == len(want) and simhash.deduplicated(clashing).columns == clashing.columns


def test_stage_on_the_given_table_and_on_none(spark, sf, none):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert _rows(corpus_pipeline.drop_near_duplicates(spark, docs, sf)) == (sorted(_kept(docs.collect()), key=repr), [])
    assert simhash.deduplicated(none).count() == 0
