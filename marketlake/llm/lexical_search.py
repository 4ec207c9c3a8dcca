"""Ranked lexical search through hashed max-sketches.

Every document is folded into a sketch: each term hashes to a few coordinates, and a coordinate holds the largest frequency of
the terms that meet there. A term's impact rises with its frequency in a given document, so these are the coordinatewise maxima of
impacts, and a query's weights times the least impact at each term's coordinates bound its score from above.
Documents are scored exactly in order of falling bounds until no bound reaches the query's k-th score.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlake.llm.common import mapped, pieces, stored, utf8_bytes
from marketlake.llm.decontaminate import words_of

#: Coordinates that a term meets, coordinates a sketch has for each distinct term, and the fewest and most it has.
HASHES, SPREAD, LEAST_WIDTH, MOST_WIDTH = 3, 8, 16, 1 << 20
#: Bytes of items whose words one pass over the documents looks for, and items that are bounded together in a task.
PASS_BYTES, TOGETHER = 1 << 20, 256
#: A frequency that a sketch doesn't tell from larger ones. No impact reaches LIMIT.
_MOST, LIMIT = 255, 1_000_000
#: Stands for a document without an id: behind all others of its score.
_NO_ID = (1 << 63) - 1


def coordinates(terms, width: int) -> np.ndarray:
    """Per hash and term, a place below ``width``, a power of two."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    return places(hashed, width)


def places(hashed: np.ndarray, width: int) -> np.ndarray:
    start, step = hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32) | np.uint64(1)
    return ((start + np.arange(HASHES, dtype=np.uint64)[:, None] * step) & np.uint64(width - 1)).astype(np.int64)


def sketch(counts: Counter[bytes]) -> np.ndarray:
    """The coordinatewise maxima of a document's frequencies, as bytes; as many coordinates as its distinct terms need."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (SPREAD * len(counts) - 1).bit_length()))
    out = np.zeros(width, np.uint8)
    often = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), _MOST)
    rising = np.argsort(often, kind="stable")
    for at in coordinates(counts, width):
        # The last of equal places stays, so the largest; what an earlier hash left may be larger still.
        own = np.zeros(width, np.uint8)
        own[at[rising]] = often[rising]
        np.maximum(out, own, out=out)
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "body"):
        counts = [Counter(words_of(t)) for t in batch.column("body").to_pylist()]
        n = pa.array([c.total() for c in counts], pa.int64())
        found = pa.array([sketch(c).tobytes() for c in counts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, found, batch.column("body")], names=["doc_id", "n", "sketch", "body"])


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sketch, body) of the documents with at least one term, written down: whatever the queries are, they read
    this table, and of its texts only those that bounds can't rule out are cut into terms."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8_bytes().alias("body"))
    return stored(mapped(rows, _sketches, "doc_id bigint, n bigint, sketch binary, body binary").where("n > 0"))


@dataclass
class Queries:
    """The items of one pass: their terms, with weights once the documents are counted."""

    ids: pa.Array
    first: int
    terms: list[list[bytes]]
    weight: dict[bytes, int]
    n_docs: int = 0
    n_terms: int = 0


def _document_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many of a task's documents each wanted term occurs: at most one row a term and task."""
        wanted, found = shared.value, Counter()
        for batch in pieces(batches, "body"):
            for text in batch.column("body").to_pylist():
                found.update(wanted & set(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "docs"])

    return run


def weights(terms: set[bytes], index: DataFrame, n_docs: int) -> dict[bytes, int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of every term, df counted over all documents."""
    shared = index.sparkSession.sparkContext.broadcast(terms)
    counted = mapped(index.select("body"), _document_counts(shared), "term binary, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
    df = {bytes(r.term): r.docs for r in counted.collect()}
    return {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))) for t in terms}


class Group:
    """Some of a pass's items: their distinct terms, and weights of terms (rows) in items (columns), repeats added."""

    def __init__(self, queries: Queries, items: range):
        self.items = items
        self.place = {t: i for i, t in enumerate(sorted({t for k in items for t in queries.terms[k]}))}
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.place), np.uint64, len(self.place))
        self.matrix = np.zeros((len(self.place), len(items)))
        for column, k in enumerate(items):
            for t, often in Counter(queries.terms[k]).items():
                self.matrix[self.place[t], column] = often * queries.weight[t]
        if self.matrix.sum(0).max(initial=0) * LIMIT >= 2.0**53:
            raise ValueError("an item's scores don't fit the whole numbers of a double")

    def bounds(self, sketches: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Per document and item, what the sketch allows at most."""
        out = np.zeros((len(sketches), len(self.items)))
        widths = np.fromiter(map(len, sketches), np.int64, len(sketches))
        often = np.arange(_MOST + 1)
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            at = places(self.hashes, int(width))
            for rows in np.split(own, range(256, len(own), 256)):
                held = np.frombuffer(b"".join(sketches[r] for r in rows), np.uint8).reshape(len(rows), width)
                table = impact(often[None, :], lengths[rows][:, None]).astype(np.float64)
                table[:, _MOST] = LIMIT
                often_at_most = functools.reduce(np.minimum, (held[:, own_at] for own_at in at))
                out[rows] = np.take_along_axis(table, often_at_most.astype(np.int64), 1) @ self.matrix
        return out

    def scores(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Per document and item, exactly: whole numbers below 2**53."""
        out = np.zeros((len(texts), len(self.items)))
        for row, text in enumerate(texts):
            counts = Counter(words_of(text))
            held = [(self.place[t], n) for t, n in counts.items() if t in self.place]
            if held:
                at, often = np.array(held, np.int64).T
                out[row] = impact(often, lengths[row]).astype(np.float64) @ self.matrix[at]
        return out


def impact(often: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of a term that occurs ``often`` in a document whose ``length`` is weighed against the mean."""
    return (1_000_000_000 * often) // (1000 * often + 8 * length)


class Best:
    """The k best documents of every item of a group so far: higher scores first, then smaller ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        #: What a score must reach to count.
        self.least = np.ones(items)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        item, score, doc = np.r_[self.item, item], np.r_[self.score, scores[row, item]], np.r_[self.doc, docs[row]]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][: len(item)])
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        full = rank[kept] == self.k - 1
        self.least[self.item[full]] = self.score[full]


def search_batch(group: Group, best: Best, sketches: list[bytes], lengths: np.ndarray, docs: np.ndarray, text_of) -> int:
    """Documents by falling bounds, until none is left whose bound reaches an item's k-th score. Returns how many were scored."""
    bounds = group.bounds(sketches, lengths)
    scored, step = 0, best.k
    while True:
        open_ = bounds >= best.least
        left = int(open_.sum(0).max(initial=0))
        if not left:
            return scored
        high = np.where(open_, bounds, -1.0)
        if left > step:
            next_ = np.argpartition(-high, step - 1, axis=0)[:step]
            rows = np.unique(next_[np.take_along_axis(high, next_, 0) >= 0])
        else:
            rows = np.flatnonzero(open_.any(1))
        best.add(group.scores([text_of(r) for r in rows], lengths[rows]), docs[rows])
        bounds[rows] = -1.0
        scored, step = scored + len(rows), 2 * step


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        groups = [Group(queries, range(i, min(i + TOGETHER, len(queries.terms)))) for i in range(0, len(queries.terms), TOGETHER)]
        bests = [Best(len(g.items), k) for g in groups]
        for batch in pieces(batches, "body"):
            n = batch.column("n").to_numpy()
            lengths = 25 + (75 * n * queries.n_docs) // queries.n_terms
            docs, sketches, body = batch.column("doc_id").fill_null(_NO_ID).to_numpy(), batch.column("sketch").to_pylist(), batch.column("body")
            for group, best in zip(groups, bests, strict=True):
                search_batch(group, best, sketches, lengths, docs, lambda r, body=body: body[int(r)].as_py())
        for group, best in zip(groups, bests, strict=True):
            at = best.item + group.items.start
            doc = pa.array(best.doc, mask=best.doc == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(at + queries.first), queries.ids.take(pa.array(at)), doc, pa.array(best.score.astype(np.int64))], names=["_item", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item, its ``k`` documents with the highest score above 0.

    Terms are runs of digits, letters a-z (A-Z folded) and characters beyond ASCII. With N documents that have a term, L
    terms in them and df documents that hold a term, the term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document
    of n terms has m = 25 + 75 n N div L, and scores w (10^9 tf div (1000 tf + 8 m)) for each of the item's terms, repeats included.

    Exact at every size: a sketch only rules out documents whose bound is below the k-th score a task has already found.
    Each task gives its k best per item, which are folded afterwards; texts are never shuffled. Items are read by the driver
    and broadcast in passes of about ``pass_bytes``, each one pass over the sketches; work is items times documents.

    Null and empty texts have no terms: such documents are never found and such items find nothing. Equal scores go to the
    smaller doc_id, documents without one come last. Repeated documents are each ranked; rows of one item and text count
    once, and one item id with several texts gets results for each. An empty table on either side gives none. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    index = sketched(docs)
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    asked = stored(items.select("item_id", utf8_bytes().alias("body")).distinct())
    passes = max(1, -(-(asked.agg(F.sum(F.length("body"))).first()[0] or 0) // pass_bytes))
    kind = asked.schema["item_id"]
    found, first = None, 0
    for part in range(passes if n_docs else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(passes)) == part).collect()
        terms = [words_of(bytes(r.body)) for r in rows]
        wanted = {t for own in terms for t in own}
        queries = Queries(pa.array([r.item_id for r in rows], to_arrow_type(kind.dataType)), first, terms, weights(wanted, index, n_docs), n_docs, n_terms)
        first += len(rows)
        own = mapped(index, _searcher(spark.sparkContext.broadcast(queries), k), f"_item bigint, item_id {kind.dataType.simpleString()}, doc_id bigint, score bigint")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], f"_item bigint, item_id {kind.dataType.simpleString()}, doc_id bigint, score bigint")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
