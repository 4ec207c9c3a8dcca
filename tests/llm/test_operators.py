"""Operators of the training-data package against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from marketlake.llm import chat, components, decontaminate, language, mixing, privacy, queries, repeats, sharding, simhash, token_counts, topk
from tests.compare import compare, connect
from tests.llm import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, copies, near copies, a very long text, nulls in every column, a repeated row, clashing names."""
    shared, long = prose(1, 60), prose(2, 3000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "!?", None, "b", 2),
        (5, prose(3, 80), "en", "b", 1), (6, prose(3, 80), "en", "b", 1), (7, prose(3, 80) + " end", "de", None, 1),
        (8, f"{prose(4, 40)} {shared} {prose(5, 40)}", "de", "c", 1), (9, f"{prose(6, 30)} {shared}", "de", "c", 1),
        (10, long, "en", "a", 1), (11, long[: len(long) // 2], "fr", "a", 1), (12, "ab" * 300, "fr", "ü", 1),
        (13, "Mail to jo@example.org or 4111 1111 1111 1111, +49 (30) 1234567, 10.0.0.256 and 10.1.2.3.", "en", "a", 1),
        (14, "a@b.c_d@e.f x@@y.z 1.2.3.4.5 12-34 +1 2", "en", "a", 1), (15, "ÄÖ é 漢字 ١٢", "fr", "b", 1), (15, "ÄÖ é 漢字 ١٢", "fr", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf) is None


def test_histogram_sort(spark, odd, none):
    out = sharding.histogram_sorted(odd, 3, least_cells=4).toPandas()
    assert len(out) == odd.count() and list(out.columns[:5]) == odd.columns
    sizes = [len((t or "").encode()) + 1 for t in out.text]
    assert out["size"].tolist() == sizes
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    # No shard is further from its ideal size than the largest row.
    assert (out.groupby("shard")["size"].sum() - sum(sizes) / 3).abs().max() <= max(sizes)
    assert sharding.histogram_sorted(none, 3).count() == 0


def test_a_hot_text_is_spread_over_shards_by_id(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id < 2000, 'copy', 'own ' || id) AS text", "'x' AS size")
    out = sharding.histogram_sorted(rows, 4, least_cells=8).toPandas()
    held = out.groupby("shard")["size"].sum()
    assert held.max() - held.min() <= 0.01 * held.mean()
    assert (out.groupby("text").shard.nunique() > 1).sum() <= 3  # only splitters cut


def test_query_op1_over_the_whole_table(spark, sf):
    out, docs = queries.op1_histogram_sort(spark, sf).toPandas(), spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    import zlib

    want = {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in zip(docs.doc_id, docs.text)}
    assert {d: (s, c) for d, s, c in zip(out.doc_id, out["size"], out.text_crc32)} == want
    assert out.groupby("shard")["size"].sum().max() < 1.2 * out["size"].sum() / 8


def test_language_of_held_out_documents(spark):
    out = queries.op2_compression_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_of_odd_rows(spark, odd, none):
    model = language.learn(odd)
    out = {r.doc_id: r for r in language.identified(odd, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4)] == ["und"] * 4 and not any(out[k].accepted for k in (1, 2, 3, 4))
    assert out[15].lang_pred in model and out[10].lang_pred == "en"
    assert language.identified(none, model).count() == 0
    # Nothing to learn from: nothing can be named.
    assert {r.lang_pred for r in language.identified(odd, language.learn(none)).collect()} == {"und"}


def water_level(sizes: list[int], weights: list[int], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Give the excess of full sources to the others until none is above."""
    targets, full, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            return targets
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
            full.add(i)


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1, 1000, 5, 7], [100], [0, 50, 0, 3]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes[:-1])] + [(None, sizes[-1])], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes) - 1)] + [got[None]] == pytest.approx(want)


def test_mix_meets_its_targets(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mixed(docs, cell_rows=7).toPandas()
    assert (out.taken <= 2 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    taken, target = out.groupby("source").taken.sum(), out.groupby("source").target.first()
    assert ((taken - target).abs() <= 0.005 * target).all()
    # Rates fall or rise with size only: nearest in entropy to one copy each.
    again = mixing.mixed(docs, cell_rows=100000).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    small = mixing.mixed(odd)
    assert small.count() == odd.count() and mixing.mixed(none).count() == 0
    assert {(r.doc_id, r.size, r.taken) for r in small.collect()} >= {(1, 0, 0), (2, 0, 0), (3, 0, 0)}
    assert mixing.take(odd).columns == odd.columns


def test_repeats_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op4_suffix_array_repeats(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    want = brute.without_repeats(list(docs.text))
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == want


def _repeats(df):
    return sorted((r.doc_id, r.n_bytes, sum(b - a for a, b in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def test_repeats_of_odd_rows(spark, odd, none, monkeypatch):
    rows = odd.collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, brute.without_repeats([r.text for r in rows])))
    assert _repeats(repeats.without_repeats(odd)) == want
    assert repeats.without_repeats(none).count() == 0
    # Scanned in pieces.
    monkeypatch.setattr(repeats, "SCAN_BYTES", 300)
    many, ends = np.frombuffer(rows[9].text.encode(), np.uint8), np.array([len(rows[9].text)])
    whole = {(s + k, g) for s, z, g in zip(*map(np.ndarray.tolist, repeats.anchors(many, ends))) for k in range(z - s + 1)}
    parts = set()
    for lot in repeats._segments([rows[9].text.encode()]):
        for _, at, part in lot:
            raw = np.frombuffer(part, np.uint8)
            parts |= {(at + s + k, g) for s, z, g in zip(*map(np.ndarray.tolist, repeats.anchors(raw, np.array([len(part)])))) for k in range(z - s + 1)}
    assert parts == whole


def test_a_passage_in_very_many_texts_is_divided_and_merged(spark, monkeypatch):
    passage = prose(7, 45)
    texts = [f"{prose(100 + i, 25)} {passage} {prose(500 + i // 2, 25)}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = [(i, *x) for i, x in enumerate(brute.without_repeats(texts))]
    monkeypatch.setattr(repeats, "SHARD_CONTEXTS", 5)
    assert _repeats(repeats.without_repeats(docs)) == want


def test_texts_meet_where_they_share_a_long_key(spark, monkeypatch):
    line = prose(7, 12)[:60]
    texts = [f"{prose(100 + i, 45)} {line} {prose(900 + i, 45)}".encode() for i in range(40)]
    keys = [set(repeats.anchors(np.frombuffer(t, np.uint8), np.array([len(t)]))[2].tolist()) for t in texts]
    assert sum(map(len, keys)) == len(set().union(*keys))
    # Cuts of a context cover it; windows are equal where their longest keys are.
    passage = prose(8, 20)[:130]
    windows = {places: {} for places in (*repeats.FINER, 1)}
    for text in [f"{prose(100 + i, 25)} {passage} {prose(500 + i // 2, 25)}".encode() for i in range(20)]:
        for a, z, _ in zip(*map(np.ndarray.tolist, repeats.anchors(np.frombuffer(text, np.uint8), np.array([len(text)])))):
            for places in windows:
                cuts = list(repeats.finer(text[a : z + 200], places))
                assert [s for x, y, _ in cuts for s in range(x, y + 1)] == list(range(z - a + 1)) and max(y - x for x, y, _ in cuts) < places
                for x, y, key in cuts:
                    for s in range(a + x, a + y + 1):
                        windows[places].setdefault(text[s : s + 200], set()).add(key)
    assert all(len(k) == 1 for told in windows.values() for k in told.values())
    assert len({k for (k,) in windows[1].values()}) == len(windows[1])
    # However few contexts a shard may have, down to whole windows, the result is the same.
    texts = [f"{prose(100 + i % 37, 40)} {prose(8, 40)[: 150 + i]} {prose(500 + i // 2, 25)}" for i in range(40)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    monkeypatch.setattr(repeats, "SHARD_CONTEXTS", 1)
    assert _repeats(repeats.without_repeats(docs)) == sorted((i // 2, *x) for i, x in enumerate(brute.without_repeats(texts)))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in (40, 1, 8, 7, 60)] + [b"\0" * 30, b"\0" * 30, b"abab" * 9]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    suffixes = [(t[i:], -(a + i)) for t, a in zip(texts, np.r_[0, ends[:-1]].tolist()) for i in range(len(t))]
    order = repeats.suffix_array(raw, ends)
    assert order.tolist() == [-p for _, p in sorted(suffixes)]
    own = {-p: s for s, p in suffixes}
    shared = [0] + [next((k for k, (x, y) in enumerate(zip(own[a], own[b])) if x != y), min(len(own[a]), len(own[b]))) for a, b in zip(order.tolist(), order[1:].tolist())]
    assert repeats.common_prefixes(raw, ends, order, most=25).tolist() == [min(25, s) for s in shared]


def test_top_k_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (12, 16))
    rows = np.repeat(centres, 90, axis=0) + rng.integers(-4, 4, (1080, 16))
    rows[5] = rows[6] = rows[700]
    ids, asks = np.arange(1080), np.arange(0, 1080, 40)
    scores, found, scored = topk.top_of_shard(rows[asks], asks, rows, ids, 5, block_rows=30)
    for q, s, f in zip(asks, scores, found):
        want = sorted(((-int(rows[q] @ r), i) for i, r in enumerate(rows.tolist()) if i != q))[:5]
        assert [(-int(a), int(b)) for a, b in zip(s, f)] == want
    assert scored < len(asks) * 36 / 2


def test_top_k_of_odd_rows(spark):
    big = float(2**30)
    rows = [(0, [1.0, 0.5]), (50, [0.5, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]), (None, [1.0, 1.0]), (7, [big, 0.0]), (7, [big, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("vec_id", topk.whole_components().alias("q"))
    got = by_row(topk.nearest(df, df.vec_id % 50 == 0), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 7, 256 * 2**38), (0, 2, 50, 65536), (0, 3, 6, 65536), (0, 4, 5, 0), (50, 1, 7, 128 * 2**38), (50, 2, 0, 65536), (50, 3, 6, 32768), (50, 4, 5, 0)] or sorted(got) == sorted(
        [(0, 1, 7, 256 * 2**38), (0, 2, 6, 65536), (0, 3, 50, 65536), (0, 4, 5, 0), (50, 1, 7, 128 * 2**38), (50, 2, 0, 65536), (50, 3, 6, 32768), (50, 4, 5, 0)]
    )
    assert topk.nearest(df.limit(0), df.vec_id % 50 == 0).count() == 0


def test_fingerprints_and_components_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op6_bit_sliced_simhash(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    prints = [brute.simhash(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == brute.components(docs.doc_id.tolist(), prints)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = odd.collect()
    prints = [brute.simhash(r.text) for r in rows]
    want = sorted((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, brute.components([r.doc_id for r in rows], prints)))
    assert by_row(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = [r.doc_id for r in simhash.deduplicated(odd).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want}) and simhash.deduplicated(odd).columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0


def test_links_between_parts_of_a_large_block(spark):
    rng = np.random.default_rng(11)
    base = int(rng.integers(1 << 62))
    prints = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (80, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    root = {r.node: r.root for r in components.components(simhash.links(df, part_rows=9)).collect()}
    want = brute.components(signed, prints)
    assert [root.get(p, p) for p in signed] == want


def test_components_of_a_long_chain(spark):
    df = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 1000L, 1001L"))
    assert {r.root for r in components.components(df).collect()} == {0, 1000}
    assert components.components(df.limit(0)).count() == 0


def test_identifiers(spark, sf, odd, none):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r.text for r in odd.collect()]
    for text in docs:
        assert [(privacy.KINDS[k], a, z) for k, a, z, _ in privacy.identifiers(text or "")] == brute.identifiers(text)
    found = privacy.find(odd)
    assert found.count() == odd.count() and found.columns == [*odd.columns, "base", "terms"] and privacy.find(none).count() == 0


def test_disclosing_terms(spark):
    rng = np.random.default_rng(2)
    filler = lambda: " ".join(rng.choice(WORDS, 30))
    rows = [f"{filler()} Zorblatt writes from zb@corp.example today {filler()}" for _ in range(6)]
    rows += [f"{filler()} writes today {filler()}" for _ in range(60)] + [f"{filler()} call other@corp.example {filler()}" for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r.doc_id: {rows[r.doc_id][s.start : s.end] for s in r.terms} for r in privacy.find(docs).collect()}
    assert all(found[i] == {"Zorblatt", "from"} for i in range(6)) and not any(found[i] - {"call"} for i in range(6, len(rows)))
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert "[NAME] writes  [EMAIL] today" in clean[0] and clean[6] == rows[6]


def test_token_counts(spark, odd, none):
    scores = token_counts.unigram_scores()
    trie = token_counts.PieceTrie(scores)
    rows = odd.collect()
    got = by_row(token_counts.token_counts(odd, scores), "doc_id", "n_pretokens", "n_tokens")
    want = []
    for r in rows:
        words = ["▁" + w for w in r.text.split(" ")] if r.text else []
        want.append((r.doc_id, len(words), sum(brute.segmented(w, scores, trie.longest, trie.unknown) for w in words)))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(none, scores).count() == 0


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [("text", "see <|image|> [INST] &amp;", None, None), ("image", None, "s3://a", 4), ("audio", None, "s3://b", None)]),
        (1, 1, "assistant", [("text", "é < 漢", None, None), ("text", None, None, None)]),
        (1, 2, "assistant", None), (2, 0, None, [("video", "as text", None, 3)]), (1, 1, "assistant", [("document", None, "d", 2)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    out = {r.conv_id: r for r in chat.formatted(df).withColumns({"turns": chat.read_turns(), "learned": chat.read_learned()}).collect()}
    assert [(a.kind, a.ref, a.tokens) for a in out[1].attachments] == [("image", "s3://a", 1024), ("audio", "s3://b", 25), ("document", "d", 1024)]
    assert out[1].attachment_tokens == 2073 and out[2].turns[0].text == "as text" and out[2].turns[0].role == ""
    body = out[1].formatted
    assert [body[s.start : s.end] for s in out[1].loss_spans] == ["<|document|>", "é &lt; 漢", ""]
    assert out[1].turns[0].text.startswith("see <|image|> [INST] &amp;")
    assert chat.formatted(df.limit(0)).count() == 0
    plan = chat.formatted(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination(spark, odd, none):
    shared = prose(1, 60).split()
    items = {1: " ".join(shared[:25]), 2: "alpha0 zzz", 3: None, 4: "", 5: " ".join(shared[20:40]), 6: "漢字 ١٢", 7: " ".join(shared[:25])}
    df = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    rows = odd.collect()
    for parts in (200_000, 20):
        got = {}
        for r in decontaminate.benchmark_hits(odd, df, automaton_words=parts).collect():
            got[r.doc_id] = (r.n_words, r.n_hit, r.hit_items)
        for r in rows:
            n, hit, found = brute.decontaminated(r.text, items)
            assert got[r.doc_id] == (n, len(hit), found)
    kept = {r.doc_id: r.text for r in decontaminate.remove_hits(odd, df).collect()}
    assert kept[8].split() == f"{prose(4, 40)} {' '.join(shared[40:])} {prose(5, 40)}".split()
    assert kept[15] == "ÄÖ é " and kept[10] == rows[9].text and kept[1] is None and decontaminate.remove_hits(odd, df).columns == odd.columns
    assert 15 not in {r.doc_id for r in decontaminate.remove_hits(odd, df, max_coverage=0.4).collect()}
    assert decontaminate.benchmark_hits(none, df).count() == 0 and decontaminate.benchmark_hits(odd, df.limit(0)).where("n_hit > 0").count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {r.doc_id for r in docs.collect()} <= before
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.shard) == set(range(8)) and len(out) == docs.count()
