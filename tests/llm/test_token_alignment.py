"""Token alignment against all pairs of token ranges."""

from __future__ import annotations

import hashlib
import pathlib
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketlake.llm import queries, token_alignment as ta
from tests.llm.test_operators import none, odd  # noqa: F401


@pytest.fixture(scope="module")
def plain():
    """The two tokenizers by their own libraries: ids and byte ranges of a text, or None."""
    left = Tokenizer.from_file(ta.BYTE_BPE)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=ta.PIECE_BPE)
    shown = ta._shown_bytes()

    def ranges(ids, raws):
        out, at = [], 0
        for i, raw in zip(ids, raws):
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def run(text):
        if not text:
            return None
        a = left.encode(" " + text, add_special_tokens=False).ids
        b = right.encode(text)
        raw_a = [bytes(shown[c] for c in left.id_to_token(i)) for i in a]
        raw_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        return ranges(a, raw_a), ranges(b, raw_b)

    return run


def _brute(texts, plain):
    held, rows = [], []
    for text in texts:
        a, b = plain(text) or ([], [])
        cuts = sorted({z for *_, z in a} & {z for *_, z in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < cut) for side in (a, b)))
            low = cut
        links, first = [], 0
        for i, s, z in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < z:
                links.append((i, b[k][0]))
                k += 1
        held.append(links)
        rows.append((len(a), len(b), len(groups), len(links), ";".join(groups)))
    count = Counter(p for links in held for p in set(links))
    best: dict[int, int] = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(*r[:4], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, held)]


def test_query_over_the_whole_table(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op11_token_alignment(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    want = _brute(list(docs.text), plain)
    own = list(zip(got.n_a, got.n_b, got.n_groups, got.n_links, got.n_best, got.count_sum, got.groups_sha256))
    assert own == [(*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for w in want]


def test_odd_rows(spark, odd, none, plain):  # noqa: F811
    more = ["x▁y", "<s> </s> <|endoftext|><unk>", "  two  spaces ", "\n\n a \t b\n", "tab\there it's 12345 we'll", "<0x41>", "\x00 \x01\x85\xa0 ", "é" * 300]
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, "en", "a", 1) for i, t in enumerate(more)], odd.schema))
    rows = docs.collect()
    want = {(r.doc_id, *w) for r, w in zip(rows, _brute([r.text for r in rows], plain))}
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    out = ta.link_scores(docs)
    assert out.columns == [*docs.columns, *columns[:6]]
    full = ta.link_scores(docs, keep=["doc_id"], derived={"text_of_groups": ta.F.col("groups")}).collect()
    assert {(r.doc_id, *(r[c] for c in columns[:6]), r.text_of_groups) for r in full} == want and len(full) == len(rows)
    clashing = docs.selectExpr("*", "1 AS n_a", "lang AS groups", "source AS links", "n_chars AS _page", "text AS _text", "0 AS count_sum")
    assert ta.link_scores(clashing).count() == len(rows) and ta.alignments(clashing).columns == [*docs.columns, *columns[:4], "groups", "links"]
    assert ta.link_scores(none).count() == 0 and ta.alignments(none).count() == 0


def test_links_of_a_text(spark):
    row = ta.alignments(spark.createDataFrame([(1, "unbelievable unbelievable")], "doc_id bigint, text string")).first()
    assert sum(x.times for x in row.links) == row.n_links and [(x.a, x.b) for x in row.links] == sorted({(x.a, x.b) for x in row.links})
    assert row.groups.count(";") + 1 == row.n_groups


def test_pages_of_any_size_give_the_same_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    once = sorted(map(tuple, ta.link_scores(docs, keep=["doc_id"]).collect()))
    repeated = docs.repartition(7)
    assert sorted(map(tuple, ta.link_scores(repeated, keep=["doc_id"]).collect())) == once


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        ta.ByteTokens(b'{"model": {}, "normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": false, "use_regex": true}}')


def test_memory_of_a_page(monkeypatch):
    """What a worker needs beside its tokenizers follows the slice, not the rows it is handed; a page's links are still counted once."""
    monkeypatch.setattr(ta, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    files = tuple(pathlib.Path(f).read_bytes() for f in (ta.BYTE_BPE, ta.PIECE_BPE))
    text = " ".join(f"word{i % 977} and {i}" for i in range(2_000))
    batch = pa.record_batch({"doc_id": pa.array(range(60)), "_text": pa.array([text.encode()] * 60)})
    run = ta._aligner(SimpleNamespace(value=files))
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    found = [b.column("_page_links").to_pylist() for b in run(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    links = [links for rows in found for links in rows if links]
    one = ta.aligned_texts([text], ta.sides(*files))
    assert len(links) == 1 and [(l["a"], l["b"], l["docs"]) for l in links[0]] == [(a, b, 60) for a, b in zip(one["link_a"], one["link_b"])]
