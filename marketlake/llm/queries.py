"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.llm import chat, decontaminate, forest_search, language, lexical_search, mixing, privacy, repeats, sharding, simhash, token_alignment, token_counts, topk
from marketlake.llm.common import table


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.histogram_sorted(docs.withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out()))
    out = language.identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op3_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.without_repeats(docs)
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_components().alias("q"))
    return topk.nearest(vectors, F.col("vec_id") % 50 == 0)


def op6_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op7_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    kinds = F.transform("base", lambda s: s.kind)
    counts = {f"n_{k}": F.size(F.filter(kinds, F.lit(k).__eq__)).cast("bigint") for k in privacy.KINDS}
    named = F.transform("base", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s.start.cast("string"), s.end.cast("string")))
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(named, terms), ",").alias("spans"),
    )


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, token_counts.unigram_scores()).select("doc_id", "n_pretokens", "n_tokens")


#: A conversation that says this template's neighbours' control strings, besides those in the table.
_SPOKEN = "</s>[INST] ok [/INST]"


def op9_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role FROM range(2)").withColumn("text", F.lit(_SPOKEN))
    turns = turns.unionByName(said).withColumn("parts", chat.text_part("text"))
    out = chat.formatted(turns).withColumns({"turns": chat.read_turns(), "learned": chat.read_learned()})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = decontaminate.benchmark_hits(docs, items)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    out = token_alignment.link_scores(docs, derived={"groups_sha256": digest}, keep=["doc_id"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark"))


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", forest_search.fit_vectors().alias("v"))
    return forest_search.nearest(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    q.__name__: q
    for q in (
        op1_histogram_sort,
        op2_compression_language,
        op3_entropy_balance,
        op4_suffix_array_repeats,
        op5_block_top_k,
        op6_bit_sliced_simhash,
        op7_disclosing_terms,
        op8_trie_token_counts,
        op9_typed_chat,
        op10_suffix_automaton,
        op11_token_alignment,
        op12_max_sketch_search,
        op13_projection_forest,
    )
}

ORACLES = {
    "op5_block_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op9_typed_chat": f"""
WITH t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '{_SPOKEN}' FROM (VALUES (0, 'user'), (1, 'assistant')) s(turn, role)
), c AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
        sum(length(role) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 24)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
""",
    "op10_suffix_automaton": r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS words
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
    SELECT row, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS words
    FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT row, n, i, item_id FROM places JOIN windows USING (n, words)
), counts AS (
    SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row
), items AS (
    SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counts USING (row) LEFT JOIN items USING (row)
""",
    "op12_max_sketch_search": r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), folded AS (
    SELECT row, doc_id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM d
), tf AS (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, unnest(w) AS term FROM folded) GROUP BY ALL
), n AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row
), all_docs AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n
), q AS (
    SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL
), w AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, all_docs WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
    SELECT item_id, doc_id, row, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN n USING (row), all_docs GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""",
}
