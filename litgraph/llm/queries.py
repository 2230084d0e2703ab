"""One query per operator over its whole table, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.llm import (
    chat, dac, decontaminate, exact_dedup, language, negatives, packing, quality, repeats, sharding, simhash, url_filter,
    whitening,
)
from litgraph.llm.common import table
from litgraph.llm.url_labels import labelled_urls


URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(labelled_urls(spark))
    return url_filter.judge(pages, model, URL_RULES)


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dac.read_documents(dac.token_files(docs, "tokens", public_tokenizers.path("word_bpe_49k.json"), False, end=2))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), True, end=1)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -7, and judges them from the formatted text alone."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.inline(F.array(*[
            F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
            for i, role in enumerate(("user", "assistant"))])))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_trees(chat.threads_of(rows)))
    as_lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(as_lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(
        table(spark, sf_dir, "embeddings"), noise="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_repeated_strings": op2_repeated_strings,
    "op3_token_ids": op3_token_ids,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op8_chat_formatting": r"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
          SELECT *, length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h'))
                    + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ':', '\c'))
                    + 14 AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op13_hard_negatives": """
        WITH rows AS MATERIALIZED (
          SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scored AS MATERIALIZED (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
          FROM rows a, rows b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
          SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
}
