"""Alignment of two tokenizers over the same texts, and how common each pair of overlapping tokens is in the corpus.

Per Arrow batch, pandas ``merge_asof`` keyed by document finds for every token start the covering token of the other side;
the two directions together give all overlaps, and overlaps whose tokens end together close a group. Links are counted
per page, a run of documents one task has read, before anything is shuffled: what meets across the corpus is a page's distinct
id pairs, not tokens.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from marketlake.llm.common import mapped, pieces, stored

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level BPE of this family cuts a text into words before merging.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are aligned at a time (a hundred times that is a worker's memory for them), and that share a page of distinct pairs.
SLICE_BYTES, PAGE_BYTES = 256 << 10, 8 << 20


def _shown_bytes() -> dict[str, int]:
    """Byte-level vocabularies show a printable byte as itself and the others, in order, as the characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """The byte-level BPE of a tokenizer file: ids of texts, bytes of an id. Special tokens' strings are plain text."""

    def __init__(self, file: bytes):
        told = json.loads(file)
        model, cut = told["model"], told["pre_tokenizer"]
        if told.get("normalizer") or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("not a plain byte-level BPE")
        special, shown = {t["content"] for t in told["added_tokens"] if t["special"]}, _shown_bytes()
        ranks = {bytes(shown[c] for c in entry): i for entry, i in model["vocab"].items() if entry not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids don't follow the order of merges")
        self.bytes = [b""] * (1 + max(ranks.values()))
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self._encoding = tiktoken.Encoding("bytes", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids of a space and the text; None where they don't give back its bytes."""
        out = [self._encoding.encode_ordinary(" " + t) for t in texts]
        return [ids if self._encoding.decode_bytes(ids) == b" " + t.encode() else None for ids, t in zip(out, texts, strict=True)]


class PieceTokens:
    """The pieces of a sentence-piece model with byte fallback, which puts a space before the text."""

    def __init__(self, file: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=file)
        ids = range(self._model.get_piece_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [self._model.id_to_piece(i)]]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids of the text; None where they don't give back the bytes of a space and the text."""
        out = self._model.encode(texts, num_threads=1)
        return [ids if b"".join(map(self.bytes.__getitem__, ids)) == b" " + t.encode() else None for ids, t in zip(out, texts, strict=True)]


@functools.lru_cache(maxsize=2)
def sides(byte_file: bytes, piece_file: bytes) -> tuple[ByteTokens, PieceTokens]:
    """Both tokenizers, made once per worker."""
    return ByteTokens(byte_file), PieceTokens(piece_file)


def encoded(texts: list[str | None], both: tuple[ByteTokens, PieceTokens]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per side, the tokens of all texts: ids, and number of the text each belongs to.

    A text that is null or empty, or that one side can't give back byte by byte, has no tokens on either side.
    """
    there = [k for k, t in enumerate(texts) if t]
    per_text = [[None] * len(texts) for _ in both]
    for side, own in zip(both, per_text, strict=True):
        for k, ids in zip(there, side.encode([texts[k] for k in there]), strict=True):
            own[k] = ids
    out = []
    for own in per_text:
        own = [ids if None not in pair else [] for ids, pair in zip(own, zip(*per_text, strict=True), strict=True)]
        sizes = [len(ids) for ids in own]
        out.append((np.fromiter(chain.from_iterable(own), np.int64, sum(sizes)), np.repeat(np.arange(len(texts)), sizes)))
    return out


def overlaps(doc: tuple[np.ndarray, np.ndarray], start: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (a, b) of all overlapping pairs, in order of the text. ``start``: rising over all documents."""
    a, b = (pd.DataFrame({"doc": d, "start": s, name: np.arange(len(s))}) for d, s, name in zip(doc, start, "ab", strict=True))
    over_a = pd.merge_asof(a, b, on="start", by="doc")
    over_b = pd.merge_asof(b, a, on="start", by="doc")
    # Both directions find the pair whose tokens start together.
    later = over_b["start"].to_numpy() != start[0][over_b["a"].to_numpy()]
    pairs = pd.concat([over_a[["a", "b"]], over_b.loc[later, ["a", "b"]]])
    first, second = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    order = np.argsort(first + second, kind="stable")
    return first[order], second[order]


@functools.lru_cache(maxsize=4)
def _written(n: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Every id as text, followed by the mark between ids, between sides, or between groups."""
    return tuple([b"%d%s" % (i, mark) for i in range(n)] for mark in (b",", b"|", b";"))


def _groups_as_text(ids: tuple[np.ndarray, np.ndarray], last: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], doc_of_group: np.ndarray, n_docs: int) -> list[bytes]:
    """Per document ``a1,a2|b1;a3|b2,b3``. ``last``: is it its group's last token of that side; ``group``: group numbers."""
    n_groups = len(doc_of_group)
    counts = [np.bincount(g, minlength=n_groups) for g in group]
    ends = [np.cumsum(c) for c in counts]
    # A group's tokens of the first side come before those of the second.
    place_a = np.arange(len(ids[0])) + (ends[1] - counts[1])[group[0]]
    place_b = np.arange(len(ids[1])) + ends[0][group[1]]
    words = np.empty(len(ids[0]) + len(ids[1]), object)
    for own, end, place, mark in ((ids[0], last[0], place_a, 1), (ids[1], last[1], place_b, 2)):
        tables = _written(1 << 16 if not len(own) else max(1 << 16, 1 + int(own.max())))
        table = np.array(tables[0] + tables[mark], object)
        words[place] = table[own + end * len(tables[0])]
    sizes = np.bincount(doc_of_group, counts[0] + counts[1], n_docs).astype(np.int64)
    stops = np.cumsum(sizes)
    words = words.tolist()
    return [b"".join(words[z - n : z])[:-1] for z, n in zip(stops.tolist(), sizes.tolist(), strict=True)]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and how often each occurs."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return values[starts], np.diff(np.r_[starts, len(values)])


def aligned_texts(texts: list[str | None], both: tuple[ByteTokens, PieceTokens]) -> dict[str, np.ndarray | list]:
    """Per text: n_a, n_b, n_groups, n_links, groups; and the distinct links of each text: link_doc, link_a, link_b, link_times."""
    ids, docs = zip(*encoded(texts, both), strict=True)
    # A text has as many bytes on either side, so that places count on over all texts.
    ends = [np.cumsum(side.lengths[own]) for side, own in zip(both, ids, strict=True)]
    starts = [end - side.lengths[own] for side, own, end in zip(both, ids, ends, strict=True)]
    a, b = overlaps(docs, starts)
    closing = ends[0][a] == ends[1][b]
    last = np.zeros(len(ids[0]), bool), np.zeros(len(ids[1]), bool)
    last[0][a[closing]] = last[1][b[closing]] = True
    group = tuple(np.cumsum(x) - x for x in last)
    doc_of_group = docs[0][last[0]]
    doc = docs[0][a]
    n = len(texts)
    # The links of a text in order of (a, b): one sort of whole numbers.
    n_ids = [len(side.bytes) for side in both]
    keys, times = _runs(np.sort((doc * n_ids[0] + ids[0][a]) * n_ids[1] + ids[1][b]))
    doc_and_a, second = np.divmod(keys, n_ids[1])
    of, first = np.divmod(doc_and_a, n_ids[0])
    return {
        "n_a": np.bincount(docs[0], minlength=n),
        "n_b": np.bincount(docs[1], minlength=n),
        "n_groups": np.bincount(doc_of_group, minlength=n),
        "n_links": np.bincount(doc, minlength=n),
        "groups": _groups_as_text(ids, last, group, doc_of_group, n),
        "link_doc": of,
        "link_a": first,
        "link_b": second,
        "link_times": times,
    }


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_LINKS, _SEEN_BY = "array<struct<a int, b int, times int>>", "array<struct<a int, b int, docs int>>"
_OWN = [*_COUNTS, "groups", "links", "n_best", "count_sum", "_page", "_page_links", "_text"]
_LINK, _SEEN = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())]), pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())])


def _lists(kind: pa.StructType, columns: list[np.ndarray], ends: np.ndarray) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), flat)


def _aligner(files):
    """Rows in, rows with their alignment out. The last row of a page also has its distinct links and in how many texts each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*files.value)
        base = len(both[1].bytes)
        page, seen, held, size = TaskContext.get().partitionId() << 32, [], None, 0

        def closed(last: pa.RecordBatch) -> pa.RecordBatch:
            """The batch with the page's links in its last row."""
            keys, docs = (np.concatenate(c) for c in zip(*seen, strict=True))
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.diff(keys[order], prepend=-1))
            keys, docs = keys[order[first]], np.add.reduceat(docs[order], first) if len(first) else docs
            ends = np.zeros(last.num_rows, np.int64)
            ends[-1:] = len(keys)
            return last.set_column(last.schema.get_field_index("_page_links"), "_page_links", _lists(_SEEN, [keys // base, keys % base, docs], ends))

        for batch in pieces(batches, "_text", SLICE_BYTES):
            if not batch.num_rows:
                continue
            if held is not None and size >= PAGE_BYTES:
                yield closed(held)
                page, seen, held, size = page + 1, [], None, 0
            if held is not None:
                yield held
            texts = batch.column("_text").cast(pa.string()).to_pylist()
            found = aligned_texts(texts, both)
            ends = np.cumsum(np.bincount(found["link_doc"], minlength=len(texts)))
            new = {n: pa.array(found[n].astype(np.int64)) for n in _COUNTS}
            new["groups"] = pa.array(found["groups"], pa.binary()).cast(pa.string())
            new["links"] = _lists(_LINK, [found["link_a"], found["link_b"], found["link_times"]], ends)
            new["_page"] = pa.array(np.full(len(texts), page))
            new["_page_links"] = _lists(_SEEN, [np.empty(0, np.int64)] * 3, np.zeros(len(texts), np.int64))
            kept = {n: batch.column(n) for n in batch.schema.names if n != "_text"}
            held = pa.RecordBatch.from_arrays([*kept.values(), *new.values()], names=[*kept, *new])
            # Of a slice, and then of a page, only distinct links and their numbers of texts are kept.
            seen.append(_runs(np.sort(found["link_a"] * base + found["link_b"])))
            size += sum(map(len, filter(None, texts)))
        if held is not None:
            yield closed(held)

    return run


def _paged(docs: DataFrame, keep: list[str], byte_file: str, piece_file: str) -> DataFrame:
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(tuple(open(path, "rb").read() for path in (byte_file, piece_file)))
    own = T.StructType.fromDDL(f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links {_LINKS}, _page bigint, _page_links {_SEEN_BY}")
    schema = T.StructType([*(docs.schema[c] for c in keep), *own.fields])
    return mapped(docs.select(*keep, F.col("text").cast("binary").alias("_text")), _aligner(files), schema)


def alignments(docs: DataFrame, keep: list[str] | None = None, byte_file: str = BYTE_BPE, piece_file: str = PIECE_BPE) -> DataFrame:
    """``keep`` (default: all columns) of ``docs`` and the alignment of its text: n_a, n_b, n_groups, n_links, groups, links.

    groups: ``a1,a2|b1;a3|b2,b3``, ids between places where tokens of both sides end. links: the distinct (a, b) ids of
    overlapping tokens, in order, with the number of overlaps. A map over the documents; nothing is shuffled.

    Null and empty texts, and those that one side's tokens don't give back byte by byte behind a space, have no tokens:
    zeros, an empty text and no links. Repeated rows count each on their own; an empty table gives an empty result; columns with
    the operator's names are replaced. One text's tokens must fit a worker.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in _OWN]
    return _paged(docs, keep, byte_file, piece_file).drop("_page", "_page_links")


def _page_scores(schema: pa.Schema):
    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        """A page's documents, and the corpus-wide count of each of its links."""
        links = rows.column("links").combine_chunks()
        a, b, times = (links.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("a", "b", "times"))
        known, n, best = ((counts.column("a").to_numpy().astype(np.int64) << 32) + counts.column("b").to_numpy(), counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False))
        order = np.argsort(known)
        at = order[np.searchsorted(known, (a << 32) + b, sorter=order)] if len(known) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(rows)), np.diff(links.offsets.to_numpy()))

        def per_row(values: np.ndarray) -> pa.Array:
            total = np.zeros(len(rows), np.int64)
            np.add.at(total, row, values)
            return pa.array(total)

        new = {"n_best": per_row(times * best[at]), "count_sum": per_row(times * n[at])}
        return pa.table([new[f.name] if f.name in new else rows.column(f.name) for f in schema], schema=schema)

    return run


def link_scores(docs: DataFrame, keep: list[str] | None = None, derived: dict[str, Column] | None = None, byte_file: str = BYTE_BPE, piece_file: str = PIECE_BPE) -> DataFrame:
    """``keep`` of ``docs``, the counts of ``alignments``, ``derived`` columns, and what the corpus says about the links.

    A link's count is the number of documents that hold it. n_best: links, repeats counted, whose count no other link of
    their a id exceeds; count_sum: the counts of all links, repeats counted. ``derived`` names columns made from those of
    ``alignments`` (say, a digest of ``groups``), which are not kept otherwise.

    Rows are written with their page. What is shuffled by link are the distinct links of each page; counts go back by page,
    where they meet its documents, at most ``PAGE_BYTES`` of text and one document. Rows are treated as in ``alignments``.
    """
    derived = derived or {}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in [*_OWN, *derived]]
    paged = _paged(docs, keep, byte_file, piece_file).withColumns(derived).select(*keep, *_COUNTS, *derived, "links", "_page", "_page_links")
    rows = stored(paged)
    on_page = rows.where(F.size("_page_links") > 0).select("_page", F.explode("_page_links").alias("l")).select("_page", "l.a", "l.b", "l.docs")
    counts = stored(on_page.groupBy("a", "b").agg(F.sum("docs").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    told = counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    met = on_page.drop("docs").join(told, ["a", "b"]).withColumnRenamed("_page", "_of_page")
    left = rows.drop("_page_links")
    out = left.drop("links", "_page").withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")}).schema
    return left.groupBy("_page").cogroup(met.groupBy("_of_page")).applyInArrow(_page_scores(to_arrow_schema(out)), out)
