"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and every vector is put into one leaf of each. A query walks all trees
through one shared priority queue, whose nodes wait by how far the query lies on the wrong side of a split above them, until the leaves it
reached hold enough vectors; those are then compared exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlake.llm.common import mapped, stored

#: Trees, distinct vectors they are fitted on at most, and sampled vectors for each leaf. The forest so has at most
#: TREES * (SAMPLE / LEAF) nodes, whatever the table's size.
TREES, SAMPLE, LEAF = 12, 16_384, 64
#: Leaves are visited until they hold so many vectors, and this share of all distinct ones besides, repeats over trees counted.
#: Vectors without any structure, like the given ones, need a large share for a recall of 0.9; clustered ones do with less.
VISITED, EFFORT = 4096, 0.7
#: Members and queries that meet in one task's block.
PART_ROWS, PART_QUERIES = 4096, 1024


class Forest:
    """Complete binary trees in arrays: node i's children are 2i + 1 and 2i + 2, leaves are numbered from 0 in each tree."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.log2(max(1, len(sample) / leaf))))
        inner = (1 << self.depth) - 1
        self.trees, self.leaves = trees, 1 << self.depth
        self.normals = rng.standard_normal((trees, inner, sample.shape[1]))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True).clip(min=1e-12)
        self.splits = np.zeros((trees, inner))
        for tree in range(trees):
            node = np.zeros(len(sample), np.int64)
            for k in range(inner):
                own = node == k
                along = sample[own] @ self.normals[tree, k]
                # The median halves the sample; the mean of the middle two lies on no vector.
                self.splits[tree, k] = np.median(along) if len(along) else 0.0
                node[own] = 2 * k + 1 + (along > self.splits[tree, k])

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distance of every vector to every split: (vector, tree, inner node)."""
        flat = self.normals.reshape(-1, self.normals.shape[2])
        return (vectors @ flat.T).reshape(len(vectors), self.trees, -1) - self.splits

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Every vector's leaf in each tree, numbered over all trees."""
        sides = self.margins(vectors) > 0
        node = np.zeros((len(vectors), self.trees), np.int64)
        row, tree = np.ogrid[: len(vectors), : self.trees]
        for _ in range(self.depth):
            node = 2 * node + 1 + sides[row, tree, node]
        return node - (self.leaves - 1) + np.arange(self.trees) * self.leaves

    def visits(self, vectors: np.ndarray, sizes: np.ndarray, enough: float) -> list[list[int]]:
        """Per vector, the leaves it visits: nearest first over all trees, until they hold ``enough`` vectors."""
        inner = self.leaves - 1
        out = []
        for margin in self.margins(vectors).tolist():
            # The queue waits by the worst split that a path crossed to the wrong side of.
            queue, found, held = [(0.0, tree, 0) for tree in range(self.trees)], [], 0
            while queue and held < enough:
                crossed, tree, node = heapq.heappop(queue)
                while node < inner:
                    away = margin[tree][node]
                    near, far = (2 * node + 2, 2 * node + 1) if away > 0 else (2 * node + 1, 2 * node + 2)
                    heapq.heappush(queue, (max(crossed, abs(away)), tree, far))
                    node = near
                leaf = node - inner + tree * self.leaves
                if sizes[leaf]:
                    found.append(leaf)
                    held += sizes[leaf]
            out.append(found)
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles; a shorter vector ends in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _with_leaves(shared, width: int, enough: float):
    """Rows with the leaves of their vector; of queries, those they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sizes = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                vectors = _matrix(part.column("v"), width)
                leaves = forest.leaf_of(vectors).tolist() if sizes is None else forest.visits(vectors, sizes, enough)
                yield part.set_column(part.schema.get_field_index("leaves"), "leaves", pa.array(leaves, pa.list_(pa.int32())))

    return run


def _block_search(width: int, k: int):
    def run(rows: pa.Table) -> pa.Table:
        """The k members of a block that are nearest to each of its queries: (query, member, score)."""
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        queries, members = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
        ids, of = members.column("class").to_numpy(), queries.column("class").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, left, right = ids[order], _matrix(queries.column("v"), width), _matrix(members.column("v"), width)[order]
        found = [[], [], []]
        step = max(1, (1 << 20) // max(1, right.size))
        for a in range(0, len(left) if len(ids) else 0, step):
            far = np.sqrt(((left[a : a + step, None, :] - right[None]) ** 2).sum(-1))
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            for x, y in zip(found, (np.repeat(of[a : a + step], best.shape[1]), ids[best].ravel(), np.take_along_axis(far, best, 1).ravel()), strict=True):
                x.append(y)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found, kinds, strict=True)], names=["query", "member", "score"])

    return run


def fit_vectors(column: str = "embedding") -> Column:
    """The vector as doubles; null where it is null, zero, or holds a null or non-finite component."""
    fit = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(column, lambda x: x != 0)
    return F.when(fit, F.transform(column, lambda x: x.cast("double")))


def nearest(vectors: DataFrame, asks: Column, k: int = 10, effort: float = EFFORT) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``asks`` holds, the ``k`` nearest other rows that the forest finds,
    by Euclidean distance in doubles.

    ``vectors``: (vec_id, v array of doubles). Equal vectors are one class, represented by its k + 1 smallest ids: more can't be
    among a query's k nearest. So copies, however many, are one vector to the trees, and no leaf is hot for them. The trees are
    fitted on the ``SAMPLE`` classes with the smallest hashes; all classes are put into leaves. Leaves and the queries that visit
    them are dealt out in blocks of ``PART_ROWS`` and ``PART_QUERIES``, so that no leaf must fit a task.

    Rows with a null id or vector take no part;
    a repeated vec_id counts once, with its smallest vector; shorter vectors are taken as ending in zeros; distances that are
    equal go to the smaller vec_id; fewer candidates give fewer results; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max(asks).alias("asks")))
    # Of a class, no task passes on more than k + 1 ids.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    classes = first.groupBy("v").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes)
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    # Every asking row with its class; a class of many asking rows is searched once.
    asking = stored(rows.where("asks").join(classes.select("v", "class").hint("merge"), "v").select("vec_id", "class"))
    sample = [r.v for r in classes.orderBy(F.xxhash64("v"), "class").limit(SAMPLE).select("v").collect()]
    points = np.zeros((len(sample), width))
    for row, v in enumerate(sample):
        points[row, : len(v)] = v
    forest = Forest(points)
    schema = "class bigint, v array<double>, leaves array<int>"
    bare = classes.select("class", "v", F.lit(None).cast("array<int>").alias("leaves"))
    members = stored(mapped(bare, _with_leaves(spark.sparkContext.broadcast((forest, None)), width, 0), schema))
    # As many rows as the forest has leaves, which the sample bounds.
    sizes = np.zeros(forest.trees * forest.leaves, np.int64)
    for r in members.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]
    wanted = bare.join(asking.select("class").distinct().hint("merge"), "class").select("class", "v", "leaves")
    queries = stored(mapped(wanted, _with_leaves(spark.sparkContext.broadcast((forest, sizes.tolist())), width, VISITED + effort * n), schema))
    visited = queries.select("class", "v", F.explode("leaves").alias("leaf"))
    held = members.select("class", "v", F.explode("leaves").alias("leaf"))
    parts = visited.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / PART_QUERIES).alias("query_parts"))
    # Again one row per leaf at most.
    told = [(leaf, int(-(-size // PART_ROWS))) for leaf, size in enumerate(sizes.tolist()) if size]
    leaf_parts = spark.createDataFrame(told, "leaf int, parts int").join(parts, "leaf")
    salt = F.xxhash64("class", F.lit("part"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)

    def dealt(side: DataFrame, own: str, other: str, ask: bool) -> DataFrame:
        out = side.join(F.broadcast(leaf_parts), "leaf").withColumn("n", F.col(other).cast("bigint")).withColumn("o", F.explode(every))
        return out.select("class", "v", "leaf", F.pmod(salt, F.col(own).cast("bigint")).alias(own), F.col("o").alias(other), F.lit(ask).alias("asks"))

    blocks = dealt(held, "parts", "query_parts", False).unionByName(dealt(visited, "query_parts", "parts", True))
    met = blocks.groupBy("leaf", "parts", "query_parts").applyInArrow(_block_search(width, k + 1), "query bigint, member bigint, score double")
    # A pair that met in several trees has one distance. A query's own class counts: its other ids are candidates.
    met = met.groupBy("query", "member").agg(F.min("score").alias("score"))
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "member"))).where(F.col("place") <= k + 1)
    ids = met.join(classes.select(F.col("class").alias("member"), "ids").hint("merge"), "member").select("query", "score", F.explode("ids").alias("vec_id"))
    best = ids.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    own = asking.withColumnRenamed("vec_id", "query_id").join(best, F.col("class") == F.col("query"))
    others = F.slice(F.filter("best", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", "b.score")
