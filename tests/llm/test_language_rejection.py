"""Texts in no learned language are rejected; clean held-out documents stay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marketlake.llm import language


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs.where(~language.held_out()))
    rng = np.random.default_rng(6)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (8, 20, 60, 200, 1000) for _ in range(8)]
    out = language.identified(spark.createDataFrame(list(enumerate(junk)), "doc_id bigint, text string"), model).collect()
    assert not any(r.accepted for r in out) and any(r.margin >= 1 for r in out)
    held = language.identified(docs.where(language.held_out()), model).where(F.length("text") >= 50).collect()
    right = [r.accepted for r in held if r.lang_pred == r.lang]
    assert np.mean(right) > 0.98
