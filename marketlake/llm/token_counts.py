"""Token counts by dynamic programming shared over a trie.

A text is cut into pre-tokens (a word with the space before it). The distinct pre-tokens of a batch are put into a trie
in sorted order; the best unigram segmentation of every prefix is computed once, at the trie node that stands for it, so
"mark", "market" and "markets" share the work of their first four letters. Nodes where a pre-token ends hold its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketlake.llm.common import mapped, pieces, utf8_bytes

#: Where the vocabulary lies; the file is read on the driver and broadcast (32,000 pieces, about half a megabyte).
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Counts of pre-tokens kept between batches of a task; past it the table is emptied, which costs time only.
REMEMBERED = 500_000


def unigram_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Piece to log probability. The model lists pieces by rank; the probability of rank r is taken as proportional to 1 / (r + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(path)))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}


class PieceTrie:
    """Scores of all pieces, and the shared forward pass over sorted words."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word. A character in no piece is as many tokens as it has UTF-8 bytes.

        The words are walked in sorted order. ``best[i]`` and ``tokens[i]`` belong to the trie node of the current word's
        first i characters; moving to the next word goes back to the node both share and forward from there. Of equal
        scores the segmentation with fewer tokens counts.
        """
        out, before = {}, ""
        best, tokens = [0.0], [0]
        scores, longest = self.scores, self.longest
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    score = scores.get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and tokens[start] + 1 < n:
                            top, n = score, tokens[start] + 1
                size = len(word[end - 1].encode())
                score = best[end - 1] + size * self.unknown
                if score > top:
                    top, n = score, tokens[end - 1] + size
                best.append(top)
                tokens.append(n)
            out[word] = tokens[-1]
            before = word
        return out


def pretokens(text: str) -> list[str]:
    """Words between ASCII spaces, each with the mark of the space before it; every further space is a mark of its own."""
    return [SPACE_MARK + w for w in text.split(" ")]


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = PieceTrie(shared.value), {}
        for batch in pieces(batches, "_bytes"):
            texts = [pretokens(t.decode()) if t else [] for t in batch.column("_bytes").to_pylist()]
            if len(known) > REMEMBERED:
                known = {}
            known |= trie.counts(list({w for words in texts for w in words} - known.keys()))
            get = known.__getitem__
            rest = [n for n in batch.schema.names if n not in ("_bytes", "n_pretokens", "n_tokens")]
            new = [pa.array([len(w) for w in texts], pa.int64()), pa.array([sum(map(get, w)) for w in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *new], names=[*rest, "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """The columns of ``docs`` and: n_pretokens, n_tokens (of the best unigram segmentation of every pre-token).

    A map over whole texts: nothing is shuffled; a task's memory holds one slice of its rows and ``REMEMBERED`` counts. A
    very long pre-token costs its length times the longest piece. Null and empty texts have no pre-tokens; each row
    counts alone, so repeated rows agree; an empty table gives an empty result. Columns with the new names are replaced.
    """
    rest = docs.drop("n_pretokens", "n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    schema = rest.withColumns({"n_pretokens": F.lit(0).cast("bigint"), "n_tokens": F.lit(0).cast("bigint")}).schema
    return mapped(rest.withColumn("_bytes", utf8_bytes()), _counter(shared), schema)
