"""Corpus pipeline: documents through five stages, each written as Parquet and read again by the next one.

Rows are told apart by id and text together, so rows that share an id are judged each by its own text, and null ids are
ids like others. Stages read the columns of documents and no others. Empty tables pass through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.llm import decontaminate, exact_dedup, language, packing, simhash
from litgraph.llm.common import discard_all_but, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SPAN = 1.5
"""Mean phrase length under which a text is in no learned language: hardly two letters in a row are known."""
WIDTH, SIMILARITY = 5, 0.8
"""Near copies: shingles of so many words, and the least Jaccard similarity of their sets."""
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
AT_ONCE = 2000
"""Whole texts that a Python worker is handed at once, if the session does not ask for fewer; workers outlive the stages."""


def _key(*hashes: Column) -> Column:
    """Id and hashes of the text as one string."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), *hashes)


def _text_key() -> Column:
    return _key(F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")))


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    return keyed.join(dropped.select("_key").distinct(), "_key", "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or in no learned language (9), null and empty ones among them; repeated rows alike."""
    found = language.identify(docs, carry=COLUMNS)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("span") >= LEAST_SPAN)
    return found.filter(known).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays (6), a null id being smaller than any other; null equals empty.

    Of rows that repeat both id and text one stays, the largest by its other columns.
    """
    judged = staged(exact_dedup.exact_dedup(docs).withColumn("_key", _key(F.col("text_sha256"))), "judged")
    keyed = docs.select(*COLUMNS, _key(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_key"))
    left = _without(keyed, judged.filter("NOT kept"))
    twice = judged.filter("kept AND group_size > 1").groupBy("_key").count().filter("count > 1").select("_key")
    if not twice.take(1):
        return left.select(*COLUMNS)
    once = left.join(twice, "_key", "left_semi").groupBy("_key").agg(F.max(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return left.join(twice, "_key", "left_anti").select(*COLUMNS).unionByName(once)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id stays (4), null ids last; of one id, one text by its hash.

    Rows that repeat both id and text stay or go alike.
    """
    groups = simhash.similar_groups(docs.select("doc_id", "text"), width=WIDTH, similarity=SIMILARITY)
    dropped = groups.filter("NOT leads").select(_key(F.hex("h"), F.hex("h2")).alias("_key"))
    return _without(docs.select(*COLUMNS, _text_key().alias("_key")), dropped).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item (5); repeated rows alike, an empty benchmark drops none."""
    keyed = docs.select(*COLUMNS, _text_key().alias("_key"))
    found = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="_key")
    return _without(keyed, found).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens (7); a null text is its end token, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), True, end=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_leaks),
    ("packing", packed),
]

ORACLE_SQL = None
"""Language, fingerprints and tokens are beyond SQL; tests/llm compares the rows with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; files of a stage, and what it left behind, go as soon as the next one is written."""
    docs = table(spark, sf_dir, "documents")
    asked = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(asked), AT_ONCE) if int(asked) > 0 else AT_ONCE))
    try:
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), name)
            discard_all_but(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(BATCH_ROWS, asked)
