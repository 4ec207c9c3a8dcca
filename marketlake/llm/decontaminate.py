"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of consecutive words of every item. A document's words stream through it once; after
each word the automaton's state and the longest match length say which item windows end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketlake.llm.common import mapped, pieces, utf8_bytes

#: Words of the items in one automaton. Longer item tables are scanned in several passes of one automaton each.
AUTOMATON_WORDS = 200_000

# Bytes of a word: digits, lower-case letters (upper-case ones are folded), and all of a character beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Over several word sequences; a match never runs from one sequence into the next."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # Per state: items whose window is the state's last `window` words, and items shorter than that which end here.
        self.window_items: dict[int, set[int]] = {}
        ends: dict[int, dict[int, set[int]]] = {}
        for k, (_, words) in enumerate(items):
            state = 0
            for n, word in enumerate(words, 1):
                state = self._shorten(self.next[state][word])
                if n >= window:
                    self.window_items.setdefault(state, set()).add(k)
            if 0 < len(words) < window:
                ends.setdefault(state, {}).setdefault(len(words), set()).add(k)
        self.base, self.short = [0] * len(self.link), [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.base[state] = self._shorten(state)
            own = tuple((n, frozenset(ks)) for n, ks in sorted(ends.get(state, {}).items(), reverse=True))
            self.short[state] = own + self.short[self.link[state]]

    def _shorten(self, state: int) -> int:
        """The state of the last ``window`` words of what a state stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        return len(self.link) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The target of a step, divided where it also stands for longer sequences."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        made = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, word)
        return made

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """Merged runs [start, end) of words inside occurring windows, the items they come from, the longest match."""
        step, link, length, base, short, window = self.next, self.link, self.length, self.base, self.short, self.window
        runs: list[list[int]] = []
        states: set[int] = set()
        found: set[int] = set()
        state = matched = longest = 0
        for end, word in enumerate(words, 1):
            target = step[state].get(word)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = step[state].get(word)
            if target is None:
                continue
            state = target
            matched += 1
            if matched > longest:
                longest = matched
            start = end
            if matched >= window:
                start = end - window
                states.add(base[state])
            for n, ks in short[state]:
                if n <= matched:
                    start = min(start, end - n)
                    found |= ks
            if start < end:
                while runs and start <= runs[-1][0]:
                    runs.pop()
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = end
                else:
                    runs.append([start, end])
        for s in states:
            found |= self.window_items[s]
        return runs, found, longest


_RUNS = pa.list_(pa.list_(pa.int64()))


def _scanner(shared, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton([(i, words_of(t)) for i, t in shared.value], window)
        for batch in pieces(batches, "_bytes"):
            n_words, all_runs, all_items, longest = [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("_bytes", "hit_runs", "hit_items", "longest_match")), strict=True)
            for text, runs, items, most in rows:
                words = words_of(text)
                more, found, length = automaton.scan(words)
                n_words.append(len(words))
                all_runs.append(_merged(runs + more) if runs else more)
                all_items.append(sorted({*items, *(automaton.ids[k] for k in found)}, key=str))
                longest.append(max(most, length))
            new = {"n_words": pa.array(n_words, pa.int64()), "hit_runs": pa.array(all_runs, _RUNS), "hit_items": pa.array(all_items, pa.list_(pa.string())), "longest_match": pa.array(longest, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return scan


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """The columns of ``docs`` and: n_words, hit_runs (word ranges inside item windows), hit_items (ids as text, in text
    order), n_hit, longest_match.

    Words are runs of digits, letters a-z (A-Z folded) and characters beyond ASCII. A window is ``window`` consecutive
    words of an item, or all words of a shorter one. A map over the documents: nothing is shuffled. The items are
    broadcast in parts of about ``automaton_words`` words, one part per pass, so their number is not bounded.

    A null or empty text has no words and no hits; items that are null or without words are never found; repeated rows
    of either table count each on their own (an item id once per document); an empty table on either side gives no
    hits. Columns of ``docs`` with the new names are replaced.
    """
    named = items.select(F.col("item_id").cast("string").alias("id"), utf8_bytes("text").alias("body"))
    total = named.agg(F.sum(F.size(F.split(F.decode("body", "UTF-8"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = -(-total // automaton_words)
    out = docs.drop("n_words", "hit_runs", "hit_items", "n_hit", "longest_match").withColumns(
        {
            "_bytes": utf8_bytes(),
            "n_words": F.lit(0).cast("bigint"),
            "hit_runs": F.array().cast("array<array<bigint>>"),
            "hit_items": F.array().cast("array<string>"),
            "longest_match": F.lit(0).cast("bigint"),
        }
    )
    for part in range(max(1, parts)):
        own = named.where(F.pmod(F.xxhash64("id", "body"), F.lit(max(1, parts))) == part)
        shared = docs.sparkSession.sparkContext.broadcast([(r.id, bytes(r.body)) for r in own.collect()])
        out = mapped(out, _scanner(shared, window), out.schema)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])
    return out.drop("_bytes").withColumn("n_hit", n_hit)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _cutter(max_span: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_bytes"):
            texts = []
            for text, runs in zip(batch.column("_bytes").to_pylist(), batch.column("hit_runs").to_pylist(), strict=True):
                words, kept, at = [m.span() for m in _WORD.finditer(text)] if runs else [], [], 0
                for start, end in runs:
                    if end - start > max_span:
                        kept.append(text[at : words[start][0]])
                        at = words[end - 1][1]
                texts.append(None if text is None else b"".join([*kept, text[at:]]).decode())
            new = {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return cut


def remove_hits(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 0, max_coverage: float = 0.5, least_words: int = 1) -> DataFrame:
    """``docs`` with benchmark passages taken out; the columns stay.

    A document of whose words more than ``max_coverage`` are hit goes. From others, every hit run of more than
    ``max_span`` words is cut out of the text, from its first word to its last. Items of fewer than ``least_words`` words are left
    out: a word or two of a test are found in any text. Documents without hits, null texts among them, stay as they are;
    repeated rows of either table change nothing, and an empty item table leaves all.
    """
    if least_words > 1:
        words = F.filter(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
        items = items.where(F.size(words) >= least_words)
    hits = benchmark_hits(docs, items, window).where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    hits = hits.withColumn("_bytes", F.col("text").cast("binary"))
    return mapped(hits, _cutter(max_span), hits.schema).select(*docs.columns)
