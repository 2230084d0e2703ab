"""Keyed merges and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from litgraph.functions.text import author_name, flexible_date, nonempty
from litgraph.operators.joins import canonical_pair, latest_per


def match_file_index(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Index rows of wanted articles, trimmed, with a path."""
    tidy = index.select(*[F.trim(F.col(c)).alias(c) for c in ("path", "pmc_id", "license", "citation")])
    return tidy.filter((F.col("path") != "") & (F.col("pmc_id") != "")).join(
        ids.select(F.trim("pmc_id").alias("pmc_id")).distinct(), "pmc_id", "left_semi")


def normalize_incoming(rows: DataFrame) -> DataFrame:
    """Title to 2000 characters, publication day and year."""
    day = flexible_date(F.col("pub_date"))
    return rows.withColumns({
        "title": F.substring("title", 1, 2000), "published_date": day,
        "pub_year": F.coalesce("pub_year", F.year(day))}).drop("pub_date")


def upsert_papers(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing papers stay as they are; new (source, external_id) keys are added once."""
    key = ["source", "external_id"]
    new = latest_per(incoming.join(existing.select(*key), key, "left_anti"), key, [F.asc("paper_id")])
    return existing.unionByName(new, allowMissingColumns=True)


def ingest_report(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Found, new and skipped per run."""
    key = ["source", "external_id"]
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    first = batch.groupBy("run_id", *key).agg(F.count(F.lit(1)).alias("c")).join(known, key, "left")
    new = F.col("_known").isNull().cast("long")
    return first.groupBy("run_id").agg(
        F.sum("c").alias("found"), F.sum(new).alias("new"), F.sum(F.col("c") - new).alias("skipped"))


def merge_fulltext(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Papers keep text they have; else the arriving text, now parsed; else a new paper.

    Of arriving rows with one key, one with a full text is taken, the first by paper_id.
    """
    incoming = latest_per(incoming, ["source", "external_id"], [
        F.desc(F.coalesce(F.length("full_text") > 0, F.lit(False))), F.asc("paper_id")])
    inc = incoming.select("external_id", "source", *[F.col(c).alias(f"_{c}") for c in
                          ("paper_id", "title", "abstract", "full_text")])
    has_old, has_new = F.length("full_text") > 0, F.length("_full_text") > 0
    upgrade = ~F.coalesce(has_old, F.lit(False)) & F.coalesce(has_new, F.lit(False))
    tag = F.when(F.coalesce(has_new, F.lit(False)), "full_text_pmc").otherwise("abstract_only")
    new_status = F.when(F.length("_abstract") > 0, "fetched").otherwise("queued")
    known = F.col("paper_id").isNotNull() & ~upgrade
    pick = lambda c, new: F.when(known, F.col(c)).otherwise(new)
    return existing.join(inc, ["source", "external_id"], "full").select(
        "source", "external_id", F.coalesce("paper_id", "_paper_id").alias("paper_id"),
        F.coalesce("title", "_title").alias("title"), F.coalesce("abstract", "_abstract").alias("abstract"),
        pick("full_text", F.col("_full_text")).alias("full_text"), pick("data_source", tag).alias("data_source"),
        F.when(upgrade, "parsed").otherwise(F.coalesce("status", new_status)).alias("status"))


def patch_parsed(papers: DataFrame, parsed: DataFrame, fields=("title", "abstract", "journal", "doi", "full_text"),
                 arrays=("references_list",), cap_refs: int | None = 500) -> DataFrame:
    """Only non-empty parsed fields replace what a paper has; lists keep ``cap_refs`` items (None: all)."""
    names = [c for c in (*fields, *arrays) if c in parsed.columns and c in papers.columns]
    # Of several parsed rows of a paper, each field takes the first non-empty value, the order being a hash of the value.
    filled = lambda c: F.when(F.size(c) > 0, F.col(c)) if c in arrays else nonempty(F.col(c))
    inc = parsed.select("paper_id", *[filled(c).alias(c) for c in names]).groupBy("paper_id").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.xxhash64(c))).alias(f"_{c}") for c in names])
    out = papers.join(inc, "paper_id", "left")
    for c in names:
        new = F.col(f"_{c}")
        new = F.slice(new, 1, cap_refs) if c in arrays and cap_refs is not None else new
        out = out.withColumn(c, F.coalesce(new, F.col(c)))
    return out.drop(*[f"_{c}" for c in names])


def _joined_authors(sep: str):
    return F.array_join(F.transform("authors", author_name), sep)


def export_collection(members: DataFrame, papers: DataFrame, fmt: str = "bibtex") -> DataFrame:
    """Papers of collections as BibTeX entries or CSV rows; ``position`` counts from the newest of a collection."""
    newest = Window.partitionBy("collection_id").orderBy(F.desc_nulls_last("published_date"), "paper_id")
    df = members.select("collection_id", "paper_id").join(papers, "paper_id").withColumn("position", F.row_number().over(newest))
    year = F.coalesce(F.year("published_date").cast("string"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if fmt == "csv":
        return df.select("collection_id", "position", "paper_id", "title", _joined_authors("; ").alias("authors"), "journal",
                         year.alias("year"), "doi", F.substring(text("abstract"), 1, 200).alias("abstract"))
    doi = nonempty(F.col("doi"))
    key = F.coalesce(F.translate(doi, "/.", "__"), F.substring(F.col("paper_id").cast("string"), 1, 8))
    entry = F.concat_ws(
        "\n", F.concat(F.lit("@article{"), key, F.lit(",")),
        F.concat(F.lit("  title = {"), text("title"), F.lit("},")),
        F.concat(F.lit("  author = {"), _joined_authors(" and "), F.lit("},")),
        F.concat(F.lit("  journal = {"), text("journal"), F.lit("},")),
        F.concat(F.lit("  year = {"), year, F.lit("},")),
        F.concat(F.lit("  doi = {"), doi, F.lit("},")), F.lit("}"), F.lit(""))
    return df.select("collection_id", "position", "paper_id", "published_date", entry.alias("entry"))


def upsert_latest(existing: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key; within ``new`` the latest wins."""
    last = latest_per(new, keys, [F.desc_nulls_last("created_at"), F.desc("row_id")]).drop("row_id")
    return existing.join(last, list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def upsert_connections(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row per canonical pair and type, last write wins."""
    return upsert_latest(canonical_pair(existing), canonical_pair(new), ("paper_a_id", "paper_b_id", "connection_type"))


def upsert_extractions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row per paper and model."""
    return upsert_latest(existing, new, ("paper_id", "model_id"))


def upsert_critiques(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The same for critiques."""
    return upsert_latest(existing, new, ("paper_id", "model_id"))


def sync_claims(extractions: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims table brought up to date, keyed by paper and text hash."""
    c = extractions.select("paper_id", "extraction_id", "created_at", F.posexplode("claims").alias("i", "c")).select(
        "paper_id", "created_at", "extraction_id", F.trim("c.text").alias("claim_text"), "c.claim_type", "c.subject",
        "c.predicate", "c.object", F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), "i",
    ).filter(F.col("claim_text") != "").withColumn("text_hash", F.md5("claim_text"))
    last = latest_per(c, ["paper_id", "text_hash"], [F.desc("created_at"), F.desc("extraction_id"), F.desc("i")]).drop(
        "created_at", "i")
    return claims.join(last, ["paper_id", "text_hash"], "left_anti").unionByName(last, allowMissingColumns=True)


def refresh_extended_edges(extended: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """Snapshot of the extended edges, clustered by lower-cased source name."""
    spark = extended.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = extended.withColumn("source_key", F.lower("source_entity_name"))
    keyed.repartitionByRange(n, "source_key", "edge_key").sortWithinPartitions("source_key").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bridge_cache(requests: DataFrame) -> DataFrame:
    """Latest result and number of requests per unordered concept pair."""
    fold = lambda c: F.lower(F.trim(c))
    keyed = requests.withColumns({
        "a": F.least(fold("concept_a"), fold("concept_b")), "b": F.greatest(fold("concept_a"), fold("concept_b"))})
    return keyed.groupBy(F.col("a").alias("concept_a"), F.col("b").alias("concept_b")).agg(
        F.count(F.lit(1)).alias("query_count"), F.max_by("result", F.struct("ts", "request_id")).alias("result"))


def bridge_cache_lookup(cache: DataFrame, a: str, b: str) -> DataFrame:
    """The cached row of a pair, in either order."""
    x, y = sorted((a.lower().strip(), b.lower().strip()))
    return cache.filter((F.col("concept_a") == x) & (F.col("concept_b") == y))
