"""All labelled languages are learned; short items are left alone."""

from __future__ import annotations

import numpy as np

from marketlake.llm import decontaminate, language
from tests.llm.test_operators import DOCS, none, odd  # noqa: F401


def test_a_hundred_languages(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(100):
        words = ["".join(chr(0x4E00 + n * 150 + int(c)) for c in rng.integers(0, 140, 3)) for _ in range(40)]
        rows += [(100 * n + k, " ".join(rng.choice(words, 60)), f"l{n:03d}", "a", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learn(docs.where(~language.held_out()))
    assert len(model) == 100 and sum(len(d) for own in model.values() for d in own) <= language.BUDGET_BYTES
    out = language.identified(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)


def test_without_labels_all_documents_stay(spark, odd, none):  # noqa: F811
    unlabelled = odd.selectExpr("doc_id", "text", "CAST(null AS STRING) AS lang", "source", "n_chars")
    assert language.accepted_documents(unlabelled).count() == odd.count() and language.accepted_documents(none).count() == 0


def test_short_items_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "over the hill and the dale", "en", "a", 1), (2, "one two three four five six seven", "en", "a", 1)], DOCS)
    items = spark.createDataFrame([(1, "the"), (2, "two three four five six"), (3, None)], "item_id bigint, text string")
    kept = {r.doc_id: r.text for r in decontaminate.remove_hits(docs, items, max_coverage=0.9, least_words=5).collect()}
    assert kept == {1: "over the hill and the dale", 2: "one  seven"}
