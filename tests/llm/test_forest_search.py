"""The projection forest against all distances: recall where it prunes, equality where it visits every leaf."""

from __future__ import annotations

import numpy as np
import pytest

from marketlake.llm import forest_search as fs, queries


def _brute(rows, every, k=10):
    """rows: distinct (vec_id, vector); (query_id, rank, vec_id, score)."""
    width = max((len(v) for _, v in rows), default=0)
    held = sorted((i, [*v, *[0.0] * (width - len(v))]) for i, v in rows)
    out = []
    for q, x in held:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in held if i != q)[:k]
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return out


def _rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, folder):
    sf = f"/root/testdata/{folder}"
    got = _rows(queries.op13_projection_forest(spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = _brute(rows, 100)
    assert len(got) == len(want) and [g[:2] for g in got] == [w[:2] for w in want]
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    exact = {(q, i): d for q, _, i, d in want}
    assert all(exact[q, i] == d for q, _, i, d in got if (q, i) in exact)
    assert all(a[3] <= b[3] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_a_forest_that_prunes(spark, monkeypatch):
    # Little effort over many leaves: clustered vectors are still found.
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16)) * 4
    rows = [(i, (centres[i % 40] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(4000)]
    monkeypatch.setattr(fs, "VISITED", 600)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("vec_id", fs.fit_vectors().alias("v"))
    monkeypatch.setattr(fs, "PART_ROWS", 7)
    monkeypatch.setattr(fs, "PART_QUERIES", 3)
    got, want = _rows(fs.nearest(df, df.vec_id % 100 == 0, effort=0.0)), _brute(rows, 100)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_odd_rows(spark):
    same = [3.0, 4.0]
    rows = [(i, same) for i in range(0, 300, 3)] + [(1, None), (2, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (7, []), (8, [0.0, -0.0]), (None, same)]
    rows += [(10, [1.0]), (11, [1.0, 0.0]), (13, [3.0, 4.5]), (13, [3.0, 4.5]), (100, [-3.0, 4.0]), (14, [3.0, -4.0]), (200, [9.0, 9.0]), (200, [1.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = df.select("*", fs.fit_vectors().alias("v"), df.vec_id.alias("class"), df.embedding.alias("ids"), df.vec_id.alias("leaf"), df.vec_id.alias("query"))
    kept = {i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and (i, v) != (200, [9.0, 9.0])}
    want = sorted(_brute(list(kept.items()), 50))
    assert _rows(fs.nearest(vectors, vectors.vec_id % 50 == 0)) == want
    assert _rows(fs.nearest(vectors, vectors.vec_id % 50 == 0, k=3)) == [w for w in want if w[1] <= 3]
    assert fs.nearest(vectors.limit(0), vectors.vec_id % 50 == 0).count() == 0
    one = vectors.where("vec_id = 100")
    assert fs.nearest(one, one.vec_id % 50 == 0).count() == 0


def test_leaves_are_visited_by_the_worst_crossing():
    rng = np.random.default_rng(1)
    sample, asked = rng.standard_normal((500, 8)), rng.standard_normal((20, 8))
    forest = fs.Forest(sample, trees=3, leaf=8)
    sizes = np.bincount(forest.leaf_of(sample).ravel(), minlength=3 * forest.leaves)
    assert sizes.sum() == 1500 and sizes.max() <= 3 * sizes[sizes > 0].min() + 8
    margins, own = forest.margins(asked), forest.leaf_of(asked)
    for q, leaves in enumerate(forest.visits(asked, sizes.tolist(), 1e9)):
        assert sorted(leaves) == np.flatnonzero(sizes).tolist()
        crossed = []
        for leaf in leaves:
            tree, node, worst = leaf // forest.leaves, leaf % forest.leaves + forest.leaves - 1, 0.0
            while node:
                up = (node - 1) // 2
                if (margins[q, tree, up] > 0) != (node == 2 * up + 2):
                    worst = max(worst, abs(margins[q, tree, up]))
                node = up
            crossed.append(worst)
        assert crossed == sorted(crossed) and {x for x in leaves[:3] if sizes[x]} == {x for x in own[q] if sizes[x]}
