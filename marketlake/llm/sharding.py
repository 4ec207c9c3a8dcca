"""Sharding by histogram sort.

Documents are ordered by (hash of the text, doc_id). Candidate boundaries ("probes") are sent to all partitions, each
partition counts the bytes between them, and the sums show exactly how many bytes lie below every probe; new probes go
between the two that enclose a wanted boundary, until all boundaries are near enough. Then rows move once.
"""

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marketlake.llm.common import stored

_KEY_BITS = 128
_COUNTS = "bucket int, bytes bigint, n bigint, low binary, high binary"


def _keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two signed longs as one 16-byte string that sorts like the pair."""
    out = np.empty((len(first), 2), ">u8")
    out[:, 0] = first.view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = second.view(np.uint64) ^ np.uint64(1 << 63)
    return out.reshape(-1).view("S16")


def _padded(key: bytes) -> bytes:
    return bytes(key).ljust(16, b"\0")


def _histogram(probes: list[int]):
    """Count a partition's bytes and rows between probes; one row per bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([p.to_bytes(16, "big") for p in probes], "S16")
        size, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        low: dict[int, bytes] = {}
        high: dict[int, bytes] = {}
        for batch in batches:
            k0, k1, bytes_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys = _keys(k0, k1)
            bucket = np.searchsorted(edges, keys, "right")
            np.add.at(size, bucket, bytes_)
            np.add.at(n, bucket, 1)
            order = np.lexsort((keys, bucket))
            at, ordered = bucket[order], keys[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
            ends = np.r_[starts[1:], len(at)] - 1 if len(at) else at
            for b, a, z in zip(at[starts].tolist(), ordered[starts].tolist(), ordered[ends].tolist(), strict=True):
                a, z = _padded(a), _padded(z)
                low[b], high[b] = min(low.get(b, a), a), max(high.get(b, z), z)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(size[full]), pa.array(n[full]), pa.array([low[b] for b in full.tolist()], pa.binary()), pa.array([high[b] for b in full.tolist()], pa.binary())],
            names=["bucket", "bytes", "n", "low", "high"],
        )

    return count


def _counted(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bucket, bytes, rows, least key, greatest key) of every bucket that has rows."""
    parts = keyed.mapInArrow(_histogram(probes), _COUNTS)
    sums = parts.groupBy("bucket").agg(F.sum("bytes"), F.sum("n"), F.min("low"), F.max("high")).collect()
    return sorted((b, size, n, int.from_bytes(lo, "big"), int.from_bytes(hi, "big")) for b, size, n, lo, hi in sums)


def splitters(keyed: DataFrame, wanted: list[tuple[float, float]], probes_each: int = 16) -> list[int]:
    """Keys (128-bit numbers) with about so many bytes below them: ``wanted`` lists (bytes, tolerance), rising.

    ``keyed`` has (k0, k1, size). While an interval holds several k0, probes fall between groups of equal k0, so a group is
    cut only where the tolerance cannot be met otherwise. An interval shrinks to the keys that are really in it, so
    rounds end where keys are few or equal, too. At most one bucket per probe comes to the driver.
    """
    if not wanted:
        return []
    span = [(0, 0, 1 << _KEY_BITS, None)] * len(wanted)  # (low, bytes below it, high, bytes below it)
    done: list[int | None] = [None] * len(wanted)
    while None in done:
        probes = set()
        for i, (lo, _, hi, _) in enumerate(span):
            if done[i] is None:
                each = probes_each if hi - lo < 1 << _KEY_BITS else 1
                cuts = [lo + (hi - lo) * j // (each + 1) for j in range(1, each + 1)] if each > 1 else [(1 << _KEY_BITS) * (i + 1) // (len(wanted) + 1)]
                if lo >> 64 != (hi - 1) >> 64:
                    cuts = [max(c >> 64 << 64, (lo >> 64) + 1 << 64) for c in cuts]
                probes |= {c for c in [lo, *cuts, hi] if lo <= c <= hi and 0 < c < 1 << _KEY_BITS}
        edges = sorted(probes)
        found = _counted(keyed, edges)
        below, rows = 0, []
        for b, size, _, lo, hi in found:
            rows.append((below, below + size, lo, hi + 1))
            below += size
        ends = [r[1] for r in rows]
        for i, (want, tolerance) in enumerate(wanted):
            if done[i] is not None:
                continue
            if not rows:
                done[i] = 0
                continue
            at = min(bisect.bisect_left(ends, want), len(rows) - 1)
            under, over, lo, hi = rows[at]
            near, miss = (lo, want - under) if want - under <= over - want else (hi, over - want)
            if abs(miss) <= tolerance or hi - lo <= 1:
                done[i] = near
            span[i] = (lo, under, hi, over)
    return done


def histogram_sorted(docs: DataFrame, n_shards: int, tolerance: float = 0.001, cell_bytes: int = 64 << 20, least_cells: int = 64) -> DataFrame:
    """The columns of ``docs`` and: size (UTF-8 bytes of the text, null none, plus 1), shard (0 to ``n_shards`` - 1, of
    near equal bytes) and slot (the row's place in its shard, gapless from 0).

    A boundary between shards is within ``tolerance`` of a shard's bytes of its ideal place, or at the nearest row where
    rows are larger than that. Each shard is cut the same way, more loosely, into cells of about ``cell_bytes`` (at
    least ``least_cells`` of them), which are what one task receives and sorts: a group of equal texts with a third of
    all rows is spread over cells by doc_id. Equal texts lie side by side; a shard boundary cuts a group only
    if leaving it whole would miss the tolerance.

    Null texts are one group, empty ones another. Rows with the same text and doc_id stay together, in any order
    among themselves; a null doc_id sorts first. An empty table gives an empty result. Columns with the new names are replaced.
    """
    keyed = docs.drop("size", "shard", "slot").withColumns(
        {"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1, "_k0": F.xxhash64("text"), "_k1": F.coalesce("doc_id", F.lit(-(2**63))).cast("bigint")}
    )
    slim = stored(keyed.select("_k0", "_k1", "size"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    cells = max(least_cells, -(-total // (n_shards * cell_bytes)))
    ideal = total / n_shards
    wanted = [(total * i / (n_shards * cells), ideal * (0.25 / cells if i % cells else tolerance)) for i in range(1, n_shards * cells)]
    edges = splitters(slim, wanted)
    cut = sorted(set(edges))
    between = sorted(edges[cells - 1 :: cells])
    shard_of_cell = [bisect.bisect_right(between, c) for c in [0, *cut]]
    counts = {b: n for b, _, n, _, _ in _counted(slim, cut)}
    starts, seen = [], [0] * n_shards
    for cell, shard in enumerate(shard_of_cell):
        starts.append(seen[shard])
        seen[shard] += counts.get(cell, 0)
    plan = docs.sparkSession.createDataFrame(list(zip(range(len(starts)), shard_of_cell, starts, strict=True)), "_cell int, shard int, _start bigint")
    placed = keyed.withColumn("_cell", _cell_of(cut)("_k0", "_k1"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_k0", "_k1")) - 1
    return placed.withColumn("_place", place).join(plan, "_cell").withColumn("slot", F.col("_start") + F.col("_place")).drop("_cell", "_place", "_start", "_k0", "_k1")


def _cell_of(edges: list[int]):
    @F.pandas_udf("int")
    def cell(first: pd.Series, second: pd.Series) -> pd.Series:
        bounds = np.array([e.to_bytes(16, "big") for e in edges], "S16")
        return pd.Series(np.searchsorted(bounds, _keys(first.to_numpy(np.int64), second.to_numpy(np.int64)), "right").astype(np.int32))

    return cell
