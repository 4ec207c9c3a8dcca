"""Language identification by compression.

A language is learned as raw-content dictionaries: plain text of that language which zstandard may refer back to. A text
goes to the language whose dictionaries encode it in the fewest bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from marketlake.llm.common import mapped, pieces, utf8_bytes

#: Bounds of what is learned: documents read per language, bytes of one dictionary, dictionaries per language, and bytes of all
#: dictionaries together, which many languages share: every labelled language is learned.
SAMPLE_DOCS, DICTIONARY_BYTES, DICTIONARIES, BUDGET_BYTES = 600, 112 << 10, 1, 64 * (112 << 10)
LEVEL = 6
UNDECIDED = "und"
#: A margin is narrow below this share of the encoded size, of which ``MARGIN_BYTES`` count at most: what a dictionary saves
#: stops growing where a long text refers to itself.
MIN_SHARE, MARGIN_BYTES = 0.05, 4096
#: A text is in no learned language if, past what any frame has, a byte of it takes so many times what the language's own text takes.
MAX_GROWTH, FRAME_BYTES, LEAST_RATIO = 1.6, 24, 0.3


_BETWEEN = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters with single spaces between and around: what the languages differ in."""
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} "


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, dictionaries: int = DICTIONARIES) -> dict[str, list[bytes]]:
    """Language to dictionaries, most frequent language first, from rows (doc_id, text, lang) with a text and a lang.

    Fitted on a bounded sample, for every language: of the documents whose hash falls into the
    share of hashes that one and a half times ``sample_docs`` documents are expected in, the ``sample_docs`` with the smallest.
    Counting is one aggregate; the texts of the sample alone come to the driver, each cut where all dictionaries could
    hold no more. The hash is over id and text, so rows of one id don't come in together. Dictionaries are cut where all of them
    would exceed ``BUDGET_BYTES``, equally, so that what is broadcast stays bounded.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"))
    last = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not last:
        return {}
    dictionary_bytes = max(1024, min(dictionary_bytes, BUDGET_BYTES // (len(last) * dictionaries)))
    within = F.lit(False)
    for r in last:
        # In whole numbers: the largest hash itself is no double.
        bound = min(2**63 - 1, (3 * sample_docs << 62) // r["n"])
        within = within | ((F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(bound)))
    most = dictionaries * dictionary_bytes
    texts = rows.where(within).select("lang", "h", "doc_id", F.substring("text", 1, most).alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    for lang in (r["lang"] for r in sorted(last, key=lambda r: (-r["n"], r["lang"]))):
        own = [plain(r["text"]) for r in sorted((r for r in texts if r["lang"] == lang), key=lambda r: (r["h"], str(r["doc_id"]), r["text"]))][:sample_docs]
        out[lang] = [_dictionary(own[k::dictionaries] or own, dictionary_bytes) for k in range(dictionaries)]
    return out


def _dictionary(texts: list[str], most: int) -> bytes:
    """Texts in turn, an equal share of each, until the dictionary is full."""
    share = max(64, 2 * most // max(1, len(texts)))
    raw = b""
    for text in dict.fromkeys(texts):
        raw += text.encode()[:share]
        if len(raw) >= most:
            break
    return raw[:most]


def _identifier(shared, level: int, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = list(shared.value)
        coders, ratios = [], []
        for lang in languages:
            own = []
            for raw in shared.value[lang]:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
                d.precompute_compress(compression_params=params)
                own.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
            coders.append(own)
            alone = zstandard.ZstdCompressor(level=level)
            ratios.append(max([LEAST_RATIO, *(len(alone.compress(raw)) / len(raw) for raw in shared.value[lang] if raw)]))
        for batch in pieces(batches, "_bytes"):
            langs, scores, margins, clear = [], [], [], []
            for text in batch.column("_bytes").to_pylist():
                words = plain(text.decode())
                if not languages or not any(map(str.isalpha, words)):
                    langs.append(UNDECIDED)
                    scores.append(0.0)
                    margins.append(0.0)
                    clear.append(False)
                    continue
                raw = words.encode()
                sizes = np.array([sum(len(c.compress(raw)) for c in own) / len(own) for own in coders])
                best = int(sizes.argmin())
                # As a likelihood: a byte less is a factor of two, however long the text.
                odds = np.exp2(-np.minimum(sizes - sizes[best], 60))
                others = np.delete(sizes, best)
                langs.append(languages[best])
                scores.append(float(1 / odds.sum()))
                margins.append(float(others.min() - sizes[best]) if len(others) else float(sizes[best]))
                wide = margins[-1] >= min_share * min(sizes[best], MARGIN_BYTES)
                clear.append(bool(wide and sizes[best] - FRAME_BYTES <= MAX_GROWTH * ratios[best] * len(raw)))
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(clear, pa.bool_())]
            rest = [n for n in batch.schema.names if n not in ("_bytes", "lang_pred", "score", "margin", "accepted")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *new], names=[*rest, "lang_pred", "score", "margin", "accepted"])

    return run


def identified(docs: DataFrame, model: dict[str, list[bytes]], min_margin: float = 0.3, level: int = LEVEL, min_share: float = MIN_SHARE) -> DataFrame:
    """The columns of ``docs`` and: lang_pred, score (0 to 1), margin (bytes to the second best, mean over dictionaries), accepted.

    The whole text is encoded. ``lang_pred`` is always the best learned language, or ``und`` for null texts and texts
    without a letter (score and margin 0). ``accepted`` is false for ``und``, for margins under ``min_margin`` bytes or
    under ``min_share`` of the encoded size, and for texts that even the best language encodes much worse than its own text. Equal sizes go to the language with more learned-from documents. A map: nothing is shuffled, and each row is
    judged alone, so repeated rows agree. Columns with the new names are replaced.
    """
    rest = docs.drop("lang_pred", "score", "margin", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rest.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0), "accepted": F.lit(False)}).schema
    for name in ("lang_pred", "score", "margin", "accepted"):
        schema[name].nullable = True
    out = mapped(rest.withColumn("_bytes", utf8_bytes()), _identifier(shared, level, min_share), schema)
    return out.withColumn("accepted", F.col("accepted") & (F.col("margin") >= min_margin))


def held_out():
    """True for documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` without those whose language is undecided; the columns stay. So go narrow margins, texts in no learned language, null
    texts and texts without a letter. Repeated rows are judged alike, and an empty table gives an empty result. Where no row is
    labelled, nothing is known of any language, and all documents stay."""
    model = learn((docs if labelled is None else labelled).where(~held_out()))
    if not model:
        return docs
    return identified(docs, model).where("accepted").select(*docs.columns)
