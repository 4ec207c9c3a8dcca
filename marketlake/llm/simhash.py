"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that share two of their four 16-bit quarters meet in a block (two differing bits leave at least two quarters
equal). Inside a block, bit planes are stored vertically: bit b of up to 64 fingerprints is one machine word. One
fingerprint is compared with 64 others at once by adding its differing planes into carry-save counters; words in which
every lane has passed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from marketlake.llm.common import mapped, pieces, stored, utf8_bytes
from marketlake.llm.components import components

#: Two words that differ in at most this many bits are linked; the block keys below rely on it.
RADIUS = 2
_QUARTERS = list(combinations(range(4), 2))
_PLANES_BETWEEN_CHECKS = 8
#: Comparisons of one fingerprint with one word of 64 that are held at a time.
_COMPARED = 1 << 17


def fingerprint(words: list[bytes], width: int, seed: int) -> int:
    """Bits that are set in over half of the shingles' hashes, counted once per occurrence."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    last = stops[min(width, len(words)) - 1 :]
    hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:z], seed) for a, z in zip(starts, last)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        votes += np.unpackbits(hashed[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_bytes"):
            # bytes.lower and bytes.split know ASCII only: A-Z, and the six ASCII white space characters.
            prints = np.array([fingerprint(t.lower().split(), width, seed) for t in batch.column("_bytes").to_pylist()], np.uint64)
            rest = [n for n in batch.schema.names if n not in ("_bytes", "fp")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(prints.view(np.int64))], names=[*rest, "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) of ``docs`` and ``fp``, a signed long. Null texts have no words, so fingerprint 0."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    rows = docs.select(*keep, utf8_bytes().alias("_bytes"))
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("bigint")).schema
    return mapped(rows, _fingerprints(width, seed), schema)


def _words_of_groups(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lay groups out in words of 64 lanes; per (row, word of its group): row, word."""
    sizes = np.bincount(group)
    starts = np.cumsum(sizes) - sizes
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    lane = np.arange(len(group)) - starts[group]
    word_of_row = first_word[group] + lane // 64
    row = np.repeat(np.arange(len(group)), words[group])
    word = first_word[group][row] + np.arange(len(row)) - np.repeat(np.cumsum(words[group]) - words[group], words[group])
    return row, word, word_of_row, (lane % 64).astype(np.uint64)


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a < b) of rows of one group within ``radius`` bits. ``group``: rising numbers from 0."""
    row, word, word_of_row, lane = _words_of_groups(prints, group)
    n_words, one = int(word_of_row[-1]) + 1, np.uint64(1)
    bits = one << lane
    breaks = np.flatnonzero(np.r_[True, word_of_row[1:] != word_of_row[:-1]])
    planes = [np.bitwise_or.reduceat(np.where(prints >> np.uint64(b) & one, bits, np.uint64(0)), breaks) for b in range(64)]
    valid, first_row = np.bitwise_or.reduceat(bits, breaks), breaks
    assert len(valid) == n_words
    found_a, found_b = [], []
    for k in range(0, len(row), _COMPARED):
        r, w = row[k : k + (_COMPARED)], word[k : k + (_COMPARED)]
        ones = twos = np.zeros(len(r), np.uint64)
        over = ~valid[w]
        for b in range(64):
            # All lanes flip where this row has the bit; a lane is then set where it differs.
            flip = np.negative(prints[r] >> np.uint64(b) & one)
            differ = planes[b][w] ^ flip
            carry = ones & differ
            ones = ones ^ differ
            over = over | (twos & carry)
            twos = twos ^ carry
            over |= ones & twos  # three or more
            if b % _PLANES_BETWEEN_CHECKS == _PLANES_BETWEEN_CHECKS - 1:
                live = ~over != 0
                if not live.all():
                    r, w, ones, twos, over = r[live], w[live], ones[live], twos[live], over[live]
        close = ~over
        for b in range(64):
            hit = np.flatnonzero(close >> np.uint64(b) & one)
            other = first_row[w[hit]] + b
            later = other > r[hit]
            found_a.append(r[hit][later])
            found_b.append(other[later])
    assert radius == 2, "the counters stop at three"
    return np.concatenate(found_a or [np.empty(0, int)]), np.concatenate(found_b or [np.empty(0, int)])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row, the smallest row it is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block: compare whole blocks, some thousands of rows at a time."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        block, prints = t.column("block").to_numpy(), t.column("fp").to_numpy()
        group = np.cumsum(np.r_[False, block[1:] != block[:-1]])
        a, b = close_pairs(prints.view(np.uint64), group)
        root = _roots(len(prints), a, b)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(prints[root[linked]]), pa.array(prints[linked])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(h.num_rows for h in held) < 20_000:
            continue
        t = pa.Table.from_batches(held)
        block = t.column("block").to_numpy()
        whole = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
        if whole:
            yield compare(t.slice(0, whole))
            held = t.slice(whole).to_batches()
    if held:
        yield compare(pa.Table.from_batches(held))


def links(prints: DataFrame, part_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect exactly those distinct fingerprints which are ``RADIUS`` or fewer bits apart, through
    others of the same block where that joins the same set.

    ``prints``: column fp, distinct. Blocks of one member are dropped before the exchange of members. A block of over ``part_rows``
    members is cut into parts, and each pair of parts is a block of its own: no task holds more than two parts.
    """
    def quarter(k: int):
        return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))

    keys = F.array(*[F.lit(n).cast("bigint") * (1 << 32) + quarter(i) * (1 << 16) + quarter(j) for n, (i, j) in enumerate(_QUARTERS)])
    keyed = stored(prints.select("fp", F.explode(keys).alias("key")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(counts, "key").withColumn("parts", F.ceil(F.col("n") / part_rows))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("part")), "parts"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    blocks = pairs.select(block.alias("block"), "fp")
    return blocks.repartition("block").sortWithinPartitions("block", "fp").mapInArrow(_links, "a bigint, b bigint").distinct()


def _components(docs: DataFrame, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (_fp, root, component_id) of every distinct fingerprint."""
    prints = stored(fingerprints(docs, width, seed, keep=["doc_id"]))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joint = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, stored(rooted.join(joint, "root").select(F.col("fp").alias("_fp"), "root", "component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) of ``docs`` and: fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Documents with one fingerprint are one class, folded before any comparison; only distinct fingerprints are compared,
    and only classes with a link take part in the search for components.

    Null, empty and blank texts share fingerprint zero, which links like any other. Repeated rows are in the same
    component; null doc_ids never name one (a component of null ids has null). An empty table gives an empty result.
    Columns with the new names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id", "fp")]
    prints, named = _components(docs, width, seed)
    rows = prints if keep == ["doc_id"] else fingerprints(docs, width, seed, keep)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, rows.fp == named._fp).withColumn("fingerprint", hexed).select(*keep, "fingerprint", "component_id")


def deduplicated(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """One document of each component, that with its smallest doc_id; the columns stay.

    Rows without a doc_id stay. Where a doc_id is repeated, each of its texts is judged on its own: texts of one component become
    one (that with the smallest fingerprint, then text), others stay. An empty table gives an empty result.
    """
    prints, named = _components(docs, width, seed)
    own = prints.join(named, prints.fp == named._fp).where("doc_id = component_id")
    first = stored(own.groupBy("doc_id", "root").agg(F.min("fp").alias("_fp")).select(F.col("doc_id").alias("_id"), "_fp"))
    repeated = stored(prints.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    # One plan at every size: these tables grow with the documents, so they are never broadcast.
    single = first.join(repeated.hint("merge"), "_id", "left_anti").select("_id")
    once = docs.join(single.hint("merge"), docs["doc_id"] == single["_id"], "left_semi")
    # Whole rows as one column, so that no name clashes.
    others = docs.join(repeated.hint("merge"), docs["doc_id"] == repeated["_id"], "left_semi")
    others = fingerprints(others.select(F.struct("*").alias("_row"), "doc_id", "text"), width, seed, ["_row", "doc_id"])
    others = others.join(first.hint("merge"), (others["doc_id"] == first["_id"]) & (others["fp"] == first["_fp"]), "left_semi")
    others = others.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy("_row.text"))).where("_rank = 1")
    return once.unionByName(others.select("_row.*")).unionByName(docs.where("doc_id is null"))
