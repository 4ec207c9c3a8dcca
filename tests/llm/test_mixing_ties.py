"""The mix meets its targets where ids and rows repeat; the query against plain arithmetic."""

from __future__ import annotations

import re

from marketlake.llm import mixing, queries
from tests.llm.test_operators import DOCS, water_level


def _check(out, rows):
    sizes = {}
    for *_, source, words in rows:
        sizes[source] = sizes.get(source, 0) + words
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water_level([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for source in order:
        own = [r for r in out if r.source == source]
        assert sum(r.source_size for r in own[:1]) == sizes[source] and abs(own[0].target - want[source]) < 1e-6 * max(1, want[source])
        least = min((r.size for r in own if r.size), default=0)
        assert abs(sum(r.taken for r in own) - want[source]) <= max(least, 1, 0.005 * want[source]), source
        assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)


def test_repeated_ids_texts_and_null_ids(spark):
    text = lambda i, n=10: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(7 if i < 900 else i, text(0 if i < 600 else i), "en", "abc"[i % 3], 1) for i in range(1200)]
    rows += [(None, text(1), "en", "d", 1)] * 300 + [(None, None, "en", None, 1)] * 3 + [(9, text(2, 3), "en", None, 1)] * 40
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    _check(out, [(r[3], len((r[1] or "").split())) for r in rows])
    again = mixing.mixed(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", str(r.source), r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_the_query_meets_the_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r.doc_id: r for r in queries.op3_entropy_balance(spark, sf).collect()}
    assert len(out) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(out[d.doc_id].size == size(d.text) for d in docs)

    class Row:
        def __init__(self, r, source):
            self.source, self.size, self.source_size, self.target, self.taken, self.copies = source, r["size"], r.source_size, r.target, r.taken, r.copies

    _check([Row(out[d.doc_id], d.source) for d in docs], [(d.source, size(d.text)) for d in docs])
