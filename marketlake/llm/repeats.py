"""Exact repeats of long byte strings, by suffix arrays of shards that equal strings are sure to share.

Any 200-byte string contains 32-byte grams; the one with the smallest hash is its anchor, and equal strings have equal
anchors at equal places. So a string can only repeat where its key repeats, the 116 bytes that all strings with this anchor in
the same half share, and all strings with one key can go to one shard. A shard builds the suffix array of the contexts around
its anchors (Larsson-Sadakane refinement in numpy) and the common prefixes of neighbours (Kasai's walk, over all contexts in
step): strings with a neighbour that shares 200 bytes repeat. A key with too many different contexts is told apart by longer
keys, of the strings with the anchor in the same quarter of that half and so on, down to the whole string: none is compared
across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from marketlake.llm.common import mapped, pieces, stored, utf8_bytes

WINDOW, GRAM = 200, 32
_SPAN = WINDOW - GRAM + 1  # grams in a window
#: Places of the anchor in a window that go by one key; longer keys, where too many contexts have one: the last is a whole window.
PLACES, FINER = 85, (22, 5, 1)
#: Bytes that a task scans at a time; longer texts are scanned in overlapping pieces of this size.
SCAN_BYTES = 512 << 10
#: Bytes of contexts in one suffix array, and different contexts of one key in one shard.
SHARD_BYTES, SHARD_CONTEXTS = 512 << 10, 1024
_FIRST = 7  # bytes compared by the first sort
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at every position, combined from 8, 16 and 32 bytes."""
    h = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,)) * _M1
    h ^= h >> np.uint64(29)
    for step, m in ((8, _M2), (16, _M3)):
        h = h[:-step] * m + h[step:]
        h ^= h >> np.uint64(31)
        h *= _M1
        h ^= h >> np.uint64(32)
    return h


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, key) of every run of windows with one anchor, in one half of them all. ``ends``: where the texts
    in ``raw`` end. The key is a hash of the bytes that all windows with this anchor in this half share."""
    none = np.empty(0, np.int64)
    if len(raw) < WINDOW:
        return none, none, none
    h = gram_hashes(raw)
    low = np.uint64(0xFFFFFFFF)
    chosen = (_sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), _SPAN) & low).astype(np.int64)
    # Windows that don't reach over the end of their text.
    crossing = np.zeros(len(chosen) + 1, np.int64)
    np.add.at(crossing, np.minimum(np.maximum(ends - WINDOW + 1, np.r_[0, ends[:-1]]), len(chosen)), 1)
    np.add.at(crossing, np.minimum(ends, len(chosen)), -1)
    starts = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    if not len(starts):
        return none, none, none
    own = chosen[starts]
    half = (own - starts) // PLACES
    new = np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | (half[1:] != half[:-1])]
    first = np.flatnonzero(new)
    shared = own[first] - PLACES * half[first]
    key = h[shared]
    for step in range(GRAM - 4, WINDOW - PLACES - GRAM + 2, GRAM - 4):  # grams that overlap, to the end of what is shared
        key = (key ^ key >> np.uint64(29)) * _M2 + h[shared + step]
    return starts[first], starts[np.r_[first[1:], len(starts)] - 1], key.view(np.int64)


def finer(body: bytes, places: int) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, key) of the windows in a context of one anchor, cut where ``places`` of the anchor share a longer key."""
    anchor, n = int(np.argmin(gram_hashes(np.frombuffer(body, np.uint8, WINDOW)) >> np.uint64(32))), len(body) - WINDOW + 1
    start = 0
    while start < n:
        shared = anchor - (anchor - start) // places * places
        last = min(n - 1, shared)
        yield start, last, xxhash.xxh3_64_intdigest(body[shared : shared + WINDOW - places + 1]) - (1 << 63)
        start = last + 1


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in lots of about ``SCAN_BYTES``; pieces of one text share what a window may straddle."""
    lot, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), SCAN_BYTES):
            part = text[at : at + SCAN_BYTES + WINDOW - 1]
            if len(part) >= WINDOW:
                lot.append((row, at, part))
                size += len(part)
            if size >= SCAN_BYTES:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


_ANCHORS = "id bigint, digest bigint, gram bigint, context bigint, start bigint, n int"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_bytes", 4 << 20):
        ids, digests = batch.column("id").to_numpy(), batch.column("digest").to_numpy()
        for lot in _segments(batch.column("_bytes").to_pylist()):
            joined = b"".join(p for _, _, p in lot)
            ends = np.cumsum([len(p) for _, _, p in lot])
            first, last, gram = anchors(np.frombuffer(joined, np.uint8), ends)
            at = np.searchsorted(ends, first, "right")
            rows = np.array([r for r, _, _ in lot])[at]
            offset = np.array([o for _, o, _ in lot])[at] - (ends - [len(p) for _, _, p in lot])[at]
            context = np.fromiter((xxhash.xxh3_64_intdigest(joined[a : z + WINDOW]) for a, z in zip(first.tolist(), last.tolist())), np.uint64, len(first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(digests[rows]), pa.array(gram), pa.array(context.view(np.int64)), pa.array(first + offset), pa.array((last - first + 1).astype(np.int32))],
                names=["id", "digest", "gram", "context", "start", "n"],
            )


def suffix_array(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes of all texts in ``raw``, sorted; a text's end sorts before every byte.

    Groups of suffixes that agree on h bytes are sorted by the group of what follows h bytes on; only groups of
    more than one are touched again, and h doubles.
    """
    n = len(raw)
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    left = end - np.arange(n)
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    words = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    short = np.minimum(left, _FIRST).astype(np.uint64)
    eight = np.uint64(8)
    mask = ~np.uint64(0) << (np.uint64(64) - short * eight)
    key = (words & mask & ~np.uint64(0xFF)) | short
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    start = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    size = np.diff(np.r_[start, n])
    place = np.flatnonzero(np.repeat(size > 1, size))  # places in the array that are not settled
    h = _FIRST
    while len(place):
        who = order[place]
        after = who + h
        inside = after < end[who]
        # Equal texts end together; the later one sorts first, at every suffix alike.
        second = np.where(inside, n + rank[np.minimum(after, n - 1)], n - 1 - who)
        combined = rank[who] * (2 * n) + second
        by = np.argsort(combined, kind="stable")
        who, combined = who[by], combined[by]
        order[place] = who
        new = np.r_[True, combined[1:] != combined[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(place)])
        # A group keeps the place of its first member.
        rank[who] = np.repeat(place[first], size)
        place = place[np.repeat(size > 1, size)]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Per place in the suffix array: bytes shared with the suffix before it, up to ``most``.

    Kasai's walk: from one suffix of a text to the next, the shared length drops by one at most. All texts walk in step.
    """
    n = len(raw)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    starts = np.r_[0, ends[:-1]]
    end = np.repeat(ends, ends - starts)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    texts = np.argsort(starts - ends, kind="stable")  # longest first: the active ones are a prefix
    at, stop = starts[texts].copy(), ends[texts]
    held = np.zeros(len(texts), np.int64)
    active = len(texts)
    while True:
        while active and at[active - 1] >= stop[active - 1]:
            active -= 1
        if not active:
            break
        i, k, h = at[:active], before[at[:active]], held[:active]
        h[k < 0] = 0
        room = np.minimum(np.minimum(stop[:active] - i, np.where(k >= 0, end[k] - k, 0)), most)
        grow = np.flatnonzero(h < room)
        while len(grow):
            same = raw[i[grow] + h[grow]] == raw[k[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < room[grow]]
        shared[i] = h
        held[:active] = np.maximum(h - 1, 0)
        at[:active] += 1
    return shared[order]


def repeated_starts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts whose window occurs more than once, one start per window that occurs only once) in the texts of ``raw``."""
    order = suffix_array(raw, ends)
    long = common_prefixes(raw, ends, order) >= WINDOW
    many = long | np.r_[long[1:], False]
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    first = ~long & (end[order] - order >= WINDOW)
    return order[many], order[first]


_RUNS = "id bigint, digest bigint, start bigint, end bigint"


def _shard_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of contexts that stand for one place. All contexts of a key come together."""

    def search(t: pa.Table) -> pa.RecordBatch:
        bodies = t.column("body").to_pylist()
        ends = np.cumsum([len(b) for b in bodies])
        begins = np.r_[0, ends[:-1]]
        many = np.sort(repeated_starts(np.frombuffer(b"".join(bodies), np.uint8), ends)[0])
        alone = t.column("copies").to_numpy() == 1
        ids, digests, starts = t.column("id").to_numpy(), t.column("digest").to_numpy(), t.column("start").to_numpy()
        text = np.searchsorted(ends, many, "right")
        many, text = many[alone[text]], text[alone[text]]
        new = np.flatnonzero(np.r_[True, (many[1:] != many[:-1] + 1) | (text[1:] != text[:-1])][: len(many)])
        last = np.r_[new[1:], len(many)][: len(new)] - 1
        own = text[new]
        a, z = many[new] - begins[own] + starts[own], many[last] - begins[own] + starts[own] + WINDOW
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(digests[own]), pa.array(a), pa.array(z)], names=["id", "digest", "start", "end"])

    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            held.append(batch.slice(k, 256))
            size += sum(len(b) for b in held[-1].column("body").to_pylist())
            if size < SHARD_BYTES:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("gram").to_numpy()
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if whole:
                yield search(t.slice(0, whole))
                held = t.slice(whole).to_batches()
                size = sum(len(b) for h in held for b in h.column("body").to_pylist())
    if held:
        yield search(pa.Table.from_batches(held))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: what the joins below move."""
    coder = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches, "_bytes"):
        packed = pa.array([coder.compress(t) for t in batch.column("_bytes").to_pylist()], pa.binary())
        names = [n for n in batch.schema.names if n != "_bytes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), packed], names=[*names, "packed"])


_BODIES = "id bigint, digest bigint, gram bigint, copies bigint, start bigint, n int, many boolean, body binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of each text."""
    coder = zstandard.ZstdDecompressor()
    for batch in pieces(batches, "packed", 4 << 20):
        out = []
        for row in batch.to_pylist():
            text = coder.decompress(row["packed"])
            for w in row["wanted"]:
                body = text[w["start"] : w["start"] + w["n"] + WINDOW - 1]
                out.append((row["id"], row["digest"], w["gram"], w["copies"], w["start"], w["n"], w["many"], body))
                if len(out) >= 20_000:
                    yield _rows(out, _BODIES)
                    out = []
        yield _rows(out, _BODIES)


_FINER_ROWS = "id bigint, digest bigint, gram bigint, context bigint, copies bigint, start bigint, n int, body binary"


def _finer_rows(places: int):
    """Contexts cut by longer keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for a, z, key in finer(row["body"], places):
                    body = row["body"][a : z + WINDOW]
                    context = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    out.append((row["id"], row["digest"], key, context, row["copies"], row["start"] + a, z - a + 1, body))
            yield _rows(out, _FINER_ROWS)

    return run


def _rows(rows: list[tuple], columns: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, kinds = zip(*(c.split(" ") for c in columns.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[kind]) for i, kind in enumerate(kinds)], names=list(names))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = zstandard.ZstdDecompressor()
    for batch in pieces(batches, "packed", 4 << 20):
        out = []
        for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text, runs = coder.decompress(packed), []
            for s in sorted(spans or [], key=lambda s: (s["start"], s["end"])):
                if runs and s["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["end"])
                else:
                    runs.append([s["start"], s["end"]])
            kept, at = [], 0
            for a, z in runs:
                kept.append(text[at:a])
                at = z
            out.append((len(text), runs, b"".join([*kept, text[at:]])))
        rest = [n for n in batch.schema.names if n not in ("packed", "spans")]
        new = [pa.array([n for n, _, _ in out], pa.int64()), pa.array([r for _, r, _ in out], pa.list_(pa.list_(pa.int64()))), pa.array([k for _, _, k in out], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *new], names=[*rest, "n_bytes", "removed", "kept"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, digest, spans) of the texts with a byte in a repeated window; spans (start, end) in bytes, in no order, may overlap.

    id is doc_id (null: the least long), digest the text's hash: rows that agree in both are equal texts and fare alike.
    """
    places = mapped(docs.select(*_row_key(), utf8_bytes().alias("_bytes")).where(F.length("_bytes") >= WINDOW), _anchor_rows, _ANCHORS)
    places = stored(places)
    grams = places.groupBy("gram").agg(F.count("*").alias("_n"), F.min("context").alias("_low"), F.max("context").alias("_high")).where("_n > 1")
    twice = places.join(grams.withColumn("_one", F.col("_low") == F.col("_high")).select("gram", "_one"), "gram")
    twice = stored(twice)
    run = ["id", "digest", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end")]
    # One gram, one context: all its places are copies of each other.
    alike = twice.where("_one").select(*run)
    unlike = twice.where("not _one").drop("_one")
    kinds = stored(_kinds(unlike.withColumn("copies", F.lit(1)), "id", "digest", "start", "n"))
    copied = kinds.where("copies > 1").select("gram", "context")
    copies = unlike.join(copied, ["gram", "context"]).select(*run)
    wanted = kinds.join(_crowded(kinds), "gram").groupBy("id", "digest")
    wanted = wanted.agg(F.collect_list(F.struct("gram", "copies", "start", "n", "many")).alias("wanted"))
    texts = _packed_texts(docs.select(*_row_key(), utf8_bytes().alias("_bytes")).where(F.length("_bytes") >= WINDOW))
    # Equal rows would give the same contexts twice: one of each is enough to read them from.
    bodies = stored(mapped(texts.join(wanted, ["id", "digest"]), _contexts, _BODIES))
    spans, shards = [alike, copies], [bodies.where("not many")]
    for places in FINER:
        bodies = bodies.where("many")
        if bodies.isEmpty():
            break
        cut = stored(mapped(bodies, _finer_rows(places), _FINER_ROWS))
        kinds = stored(_kinds(cut, "id", "digest", "start", "n", "body"))
        copied = kinds.where("copies > 1").select("gram", "context")
        # A context that stood for several places is told of already.
        spans.append(cut.where("copies = 1").join(copied, ["gram", "context"]).select(*run))
        bodies = stored(kinds.join(_crowded(kinds), "gram"))
        shards.append(bodies.where("not many"))
    columns = ["gram", "id", "digest", "copies", "start", "body"]
    sharded = reduce(DataFrame.unionByName, [s.select(*columns) for s in shards])
    sharded = sharded.repartition("gram").sortWithinPartitions("gram", "id", "digest", "start")
    spans.append(mapped(sharded, _shard_search, _RUNS))
    spans = reduce(DataFrame.unionByName, spans)
    return spans.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _kinds(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per different context of a key: for how many places it stands, and what one of them has in ``columns``."""
    return rows.groupBy("gram", "context").agg(F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in columns))


def _crowded(kinds: DataFrame) -> DataFrame:
    """The keys with more than one different context, and whether they are too many for a shard."""
    return kinds.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram", (F.col("_n") > SHARD_CONTEXTS).alias("many"))


def _row_key() -> list:
    return [F.coalesce("doc_id", F.lit(-(2**63))).cast("bigint").alias("id"), F.xxhash64("text").alias("digest")]


def _packed_texts(rows: DataFrame) -> DataFrame:
    schema = rows.drop("_bytes").withColumn("packed", F.lit(b"").cast("binary")).schema
    return mapped(rows, _packed, schema)


def without_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but text) of ``docs`` and: n_bytes, removed (array of [start, end) in bytes, maximal runs) and
    kept (the other bytes, joined).

    A byte goes if a string of 200 bytes around it also starts anywhere else, in the same text or another; all is judged on
    the input. Null is an empty text; texts under 200 bytes lose nothing; of repeated rows all copies lose everything,
    as each occurs elsewhere. Very long texts are scanned in pieces. An empty table gives an empty result. Columns with
    the new names are replaced.

    Moved: about 1/60 of the positions as anchors, once by key; the contexts of keys that repeat with different
    surroundings; the texts, compressed, twice. Exact copies and shared passages fold by hash before any suffix is sorted.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "n_bytes", "removed", "kept")]
    spans = repeated_spans(docs).withColumnsRenamed({"id": "_id", "digest": "_digest"})
    rows = docs.select(*keep, *(k.alias(f"_k{i}") for i, k in enumerate(_row_key())), utf8_bytes().alias("_bytes"))
    rows = _packed_texts(rows)
    joined = rows.join(spans, (rows._k0 == spans._id) & (rows._k1 == spans._digest), "left").select(*keep, "packed", "spans")
    schema = docs.select(*keep).withColumns({"n_bytes": F.lit(0).cast("bigint"), "removed": F.lit(None).cast("array<array<bigint>>"), "kept": F.lit(b"").cast("binary")}).schema
    return mapped(joined, _removed, schema)
