"""Ranked search against scores computed plainly; bounds against the scores they bound."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from marketlake.llm import lexical_search as ls, queries
from tests.compare import compare, connect
from tests.llm.test_operators import none, odd, prose  # noqa: F401


def _terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def _brute(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text). Rows (item_id, rank, doc_id, score)."""
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in _terms(text))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def _rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_equals_its_sql_and_brute_force(spark, sf):
    assert compare(spark, connect(sf), queries.op12_max_sketch_search, queries.ORACLES["op12_max_sketch_search"], sf) is None
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = _brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert _rows(queries.op12_max_sketch_search(spark, sf)) == want


def test_odd_rows(spark, odd, none):  # noqa: F811
    hot = [(500 + i, prose(9, 30), "en", "a", 1) for i in range(40)] + [(None, prose(9, 30), "en", "a", 1), (900, "Alpha1 " * 400, "en", "a", 1)]
    docs = odd.unionByName(spark.createDataFrame(hot, odd.schema))
    docs = docs.selectExpr("*", "lang AS body", "source AS item_id", "n_chars AS n", "text AS sketch", "1 AS score")
    items = {1: prose(9, 12), 2: None, 3: "", 4: "ALPHA1 alpha1 漢字", 5: "nothing-here", 6: prose(1, 30), 7: "the ! ?", 8: prose(2, 3000)}
    table = spark.createDataFrame(list(items.items()), "item_id bigint, text string").selectExpr("*", "text AS body", "item_id AS doc_id")
    want = _brute([(r.doc_id, r.text) for r in docs.collect()], list(items.items()))
    assert _rows(ls.search(docs, table)) == want
    assert _rows(ls.search(docs, table.unionByName(table), pass_bytes=200)) == want  # repeated items, several passes
    assert _rows(ls.search(docs.repartition(5), table, k=3)) == [r for r in want if r[1] <= 3]
    assert ls.search(none, table).count() == 0 and ls.search(docs, table.limit(0)).count() == 0
    assert ls.search(docs, table.selectExpr("text AS item_id", "text")).dtypes[0] == ("item_id", "string")


@pytest.mark.parametrize("spread", [2, 0.1])
def test_bounds_hold_and_spare_documents(monkeypatch, spread):
    monkeypatch.setattr(ls, "SPREAD", 2)
    monkeypatch.setattr(ls, "MOST_WIDTH", 1 << 16 if spread == 2 else 32)
    rng = np.random.default_rng(4)
    words = [b"w%d" % i for i in range(3000)]
    rare = 1 / np.arange(1, 3001)
    texts = [b" ".join(rng.choice(words, rng.integers(1, 400), p=rare / rare.sum())) for _ in range(300)] + [b"w1 " * 900]
    counts = [Counter(t.split()) for t in texts]
    n = np.array([c.total() for c in counts])
    df = Counter(t for c in counts for t in c)
    terms = [list(rng.choice(words, 12)) for _ in range(20)] + [[b"w1"], [b"absent"]]
    weight = {t: int(1000 * np.log((2 * len(texts) + 2) / (2 * df[t] + 1))) for own in terms for t in own}
    group = ls.Group(ls.Queries(None, 0, terms, weight, len(texts), int(n.sum())), range(len(terms)))
    lengths = 25 + (75 * n * len(texts)) // n.sum()
    sketches = [ls.sketch(c).tobytes() for c in counts]
    bounds, exact = group.bounds(sketches, lengths), group.scores(texts, lengths)
    assert (bounds >= exact).all()
    best = ls.Best(len(terms), 5)
    scored = sum(ls.search_batch(group, best, sketches[a : a + 60], lengths[a : a + 60], np.arange(a, min(a + 60, 301)), lambda r, a=a: texts[a + r]) for a in range(0, 301, 60))
    for item in range(len(terms)):
        want = sorted((-s, d) for d, s in enumerate(exact[:, item]) if s > 0)[:5]
        own = best.item == item
        assert sorted(zip(-best.score[own], best.doc[own])) == want
    few = ls.Group(ls.Queries(None, 0, terms[:2], weight, len(texts), int(n.sum())), range(2))
    if spread == 2:
        assert ls.search_batch(few, ls.Best(2, 5), sketches, lengths, np.arange(301), texts.__getitem__) < 301
