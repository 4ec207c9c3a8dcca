"""Every place of a disclosing term is marked, and identifiers in few texts have terms."""

from __future__ import annotations

import numpy as np

from marketlake.llm import privacy
from tests.llm.test_operators import WORDS, odd  # noqa: F401


def test_places_far_from_identifiers_and_in_other_documents(spark):
    rng = np.random.default_rng(4)
    filler = lambda: " ".join(rng.choice(WORDS, 30))
    rows = [f"Zorblatt {filler()} Zorblatt writes from zb@corp.example today {filler()} ZORBLATT" for _ in range(40)]
    rows += [f"{filler()} writes from today {filler()}" for _ in range(60)] + [f"{filler()} zorblatt {filler()}"]
    # In two texts only, and in three copies of one text; "quux" is also elsewhere.
    rows += [f"{filler()} Mimsy quux two@corp.example {filler()} Mimsy" for _ in range(2)]
    rows += [f"{filler()} Borogove three@corp.example"] * 3 + [f"{filler()} quux {filler()}", None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r.doc_id: [rows[r.doc_id][s.start : s.end] for s in r.terms] for r in privacy.find(docs).collect()}
    assert all(found[i] == ["Zorblatt", "Zorblatt", "ZORBLATT"] for i in range(40))
    assert not any(found[i] for i in range(40, 100)) and found[100] == ["zorblatt"]
    assert found[101] == found[102] == ["Mimsy", "Mimsy"] and found[103] == found[104] == found[105] == ["Borogove"]
    assert found[106] == found[107] == found[108] == []
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert len(clean) == len(rows) and not any("zorblatt" in (t or "").lower() for t in clean.values())


def test_names_that_clash(spark, odd):  # noqa: F811
    docs = odd.selectExpr("*", "doc_id AS close", "text AS entities", "lang AS _th", "source AS base", "1 AS terms", "text AS _bytes", "lang AS _row", "lang AS _doc")
    found = privacy.find(docs)
    assert found.columns == [c for c in docs.columns if c not in ("base", "terms")] + ["base", "terms"] and found.count() == odd.count()
    clean = privacy.sanitised(docs)
    assert clean.columns == docs.columns
    plain = {(r.doc_id, r.text) for r in privacy.sanitised(odd).collect()}
    assert {(r.doc_id, r.text) for r in clean.collect()} == plain and {r.base for r in clean.collect()} == {r.source for r in odd.collect()}


def test_several_filters_give_what_one_gives(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted((r.doc_id, str(r.base), str(r.terms)) for r in privacy.find(docs, ["doc_id"]).collect())
    once = rows()
    monkeypatch.setattr(privacy, "MOST_BITS", 1 << 17)
    assert rows() == once
