"""Exact top-k by inner product, a block of vectors at a time.

Vectors with near directions are put into the same block of a shard. Per block and dimension ("term") the largest and
smallest component are known; with a query's components they bound every score in the block. A query visits blocks from
the highest bound down, scores each through the block's forward index (its rows), and stops where a bound is below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlake.llm.common import stored

#: Vectors in a block, vectors in a shard, queries in a group: a task holds one shard and one group.
BLOCK_ROWS, SHARD_ROWS, GROUP_ROWS = 128, 8192, 2048
#: Sums up to here are exact in the doubles that the matrix product uses.
_EXACT = 2.0**53


def whole_components(embedding: str = "embedding", factor: int = 256) -> Column:
    """floor(factor * x) of every component; null where the vector is null or holds a null or non-finite component."""
    fit = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(fit, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    at = np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = lists.flatten().to_numpy()
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_of_shard(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best rows per query, -inf where there are fewer; and how many (query, block) pairs were scored."""
    # Ranges of near vectors: by the signs of the dimensions that vary most, then by id.
    varied = np.argsort(-rows.var(0), kind="stable")[:16]
    order = np.lexsort((row_ids, (rows[:, varied] > 0) @ (1 << np.arange(len(varied))[::-1]) if len(varied) else row_ids))
    rows, row_ids = rows[order], row_ids[order]
    largest = float(max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)))
    kind = np.float64 if rows.shape[1] * largest**2 < _EXACT else object
    rows, queries = rows.astype(kind), queries.astype(kind)
    starts = np.arange(0, len(rows), block_rows)
    top, bottom = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    bounds = (np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ bottom.T).astype(np.float64)
    if kind is object:
        bounds *= 1 + 1e-9 * np.sign(bounds)
    visits = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf, kind)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    scored = 0
    for turn in range(len(starts)):
        block = visits[:, turn]
        # An equal bound may still bring an equal score with a smaller id.
        active = np.flatnonzero(np.take_along_axis(bounds, visits[:, turn : turn + 1], 1)[:, 0] >= best[:, -1].astype(np.float64))
        if not len(active):
            break
        active = active[np.argsort(block[active], kind="stable")]
        for own in np.split(active, np.flatnonzero(np.diff(block[active])) + 1):
            a = starts[block[own[0]]]
            scores = queries[own] @ rows[a : a + block_rows].T
            here = np.broadcast_to(row_ids[a : a + block_rows], scores.shape)
            scores[here == query_ids[own][:, None]] = -np.inf
            best[own], ids[own] = _best(np.hstack([best[own], scores]), np.hstack([ids[own], here]), k)
            scored += len(own)
    return best, ids, scored


def _shard_search(k: int):
    def search(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        asking, asked = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(asking) or not len(asked):
            return schema.empty_table()
        width = max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max()) for c in (asking.column("q"), asked.column("q")))
        query_ids = asking.column("vec_id").to_numpy()
        scores, ids, _ = top_of_shard(_matrix(asking.column("q"), width), query_ids, _matrix(asked.column("q"), width), asked.column("vec_id").to_numpy(), k)
        rows, places = np.nonzero(scores != -np.inf)
        return pa.table([query_ids[rows], ids[rows, places], scores[rows, places].astype(np.int64)], schema=schema)

    return search


def nearest(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every row where ``asks`` holds with all other rows.

    ``vectors``: (vec_id, q array of longs). Exact: equal scores go to the smaller vec_id; fewer rows give fewer results.
    Vectors meet in blocks: shards of ``SHARD_ROWS`` vectors with groups of ``GROUP_ROWS`` queries, each pair one task's
    work; the k best per pair are folded afterwards. Work is queries times vectors less what the bounds save.

    Rows with a null id or vector take no part; a repeated vec_id counts once, with its smallest vector; shorter vectors are
    taken as ending in zeros; an empty table gives an empty result; other columns are ignored. Scores must fit a long.
    """
    rows = vectors.where("vec_id is not null and q is not null").groupBy("vec_id").agg(F.min("q").alias("q"), F.max(asks).alias("asks"))
    rows = stored(rows)
    n, n_asks = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, groups = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_asks // GROUP_ROWS))
    spread = F.xxhash64("vec_id")
    every = rows.select("vec_id", "q", F.pmod(spread, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"), F.lit(False).alias("asks"))
    asking = rows.where("asks").select("vec_id", "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.pmod(F.shiftrightunsigned(spread, 7), F.lit(groups)).alias("group"), F.lit(True).alias("asks"))
    found = every.unionByName(asking).groupBy("group", "shard").applyInArrow(_shard_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
