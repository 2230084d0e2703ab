"""Knowledge-base projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from litgraph import lookups as L
from litgraph.functions import vocab
from litgraph.functions.text import ellipsis, nonempty
from litgraph.operators.joins import cap, latest_extraction, with_titles

ENTRY_FIELDS = ("entry_id", "paper_id", "entry_type", "operation", "density", "confidence", "title", "content",
                "structured_data", "epistemic_tier", "source_authority")


def _line(label: str, c: Column) -> Column:
    """``label value`` unless the value is missing or empty."""
    return F.concat(F.lit(label), nonempty(c.cast("string")))


def _source_head() -> list[Column]:
    year = F.coalesce(F.col("pub_year").cast("string"), F.lit(""))
    return [
        F.concat(F.lit("Source: "), F.coalesce("paper_title", F.lit(""))),
        F.concat(F.lit("Journal: "), nonempty(F.col("journal")), F.lit(" ("), year, F.lit(")")),
        _line("DOI: ", F.col("doi")),
    ]


def claim_content() -> Column:
    """Text of a claim entry."""
    spo = [nonempty(F.col(f"x.{c}")) for c in ("subject", "predicate", "object")]
    return F.concat_ws(
        "\n", *_source_head(), F.lit(""), F.concat(F.lit("Claim: "), F.col("x.text")),
        F.concat(F.lit("Structure: "), spo[0], F.lit(" → "), spo[1], F.lit(" → "), spo[2]),
        _line("Evidence strength: ", F.col("x.evidence_strength")), _line("From section: ", F.col("x.section")))


def mechanism_content() -> Column:
    """Text of a mechanism entry."""
    arrow = F.coalesce(F.concat(F.lit(" "), nonempty(F.col("x.interaction_type")), F.lit(" ")), F.lit(" → "))
    return F.concat_ws(
        "\n", *_source_head(), F.lit(""), F.concat(F.lit("Mechanism: "), F.col("x.description")),
        F.concat(F.lit("Pathway: "), nonempty(F.col("x.upstream_entity")), arrow, nonempty(F.col("x.downstream_entity"))),
        _line("Pathway context: ", F.col("x.pathway")), _line("Biological context: ", F.col("x.context")))


def finding_content() -> Column:
    year = F.coalesce(F.col("pub_year").cast("string"), F.lit(""))
    return F.concat(
        F.lit("Key finding from: "), F.coalesce("paper_title", F.lit("")), F.lit(" ("), year, F.lit(")\nJournal: "),
        F.coalesce("journal", F.lit("")), F.lit("\n\n"), F.col("x"))


def raw_paper_content() -> Column:
    """Text of an entry for a paper without an extraction."""
    terms = F.array_join(F.slice("mesh_terms", 1, 10), "; ")
    return F.concat_ws(
        "\n", *_source_head(), _line("Authors: ", F.array_join(F.slice("authors", 1, 5), ", ")), F.lit(""),
        F.col("abstract"), F.concat(F.lit("\nMeSH Terms: "), nonempty(terms)))


def _entry_id(kind: str, *parts) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])), 1, 12))


def kb_entries(papers: DataFrame, extractions: DataFrame) -> DataFrame:
    """Claims, mechanisms and findings of each paper's latest extraction as entries.

    A paper without an extraction becomes one raw entry if its abstract has 50 characters.
    """
    meta = papers.select("paper_id", F.col("title").alias("paper_title"), "journal", "doi", "pub_year")
    ext = latest_extraction(extractions).join(meta, "paper_id")
    base = lambda df, kind, op, density, conf, title, content, data: df.select(
        _entry_id(kind, "paper_id", "i").alias("entry_id"), "paper_id", F.lit(kind).alias("entry_type"),
        op.alias("operation"), density.alias("density"), conf.alias("confidence"), title.alias("title"),
        content.alias("content"), data.alias("structured_data"), F.lit(1).alias("epistemic_tier"),
        F.lit(L.SOURCE_AUTHORITY).alias("source_authority"))
    rows = lambda col: ext.select("paper_id", "paper_title", "journal", "doi", "pub_year",
                                  F.posexplode(col).alias("i", "x"))
    data = lambda *fields: F.to_json(F.struct("paper_id", "doi", *fields))

    strength = F.coalesce("x.evidence_strength", F.lit("moderate"))
    claims = base(
        rows("claims"), "claim",
        vocab.claim_operation(F.col("x.claim_type")), vocab.strength_density(F.col("x.evidence_strength")), strength,
        F.coalesce(nonempty(ellipsis(F.coalesce("x.text", F.lit("")), 200)), F.lit("Claim")), claim_content(),
        data("x.claim_type", "x.subject", "x.predicate", "x.object", "x.section"))
    mechs = base(
        rows("mechanisms").filter(F.length("x.description") > 0), "mechanism", F.lit("Transduction"),
        vocab.confidence_density(F.coalesce(F.nullif(F.col("x.confidence"), F.lit(0.0)), F.lit(0.7))), F.lit("moderate"),
        ellipsis(F.col("x.description"), 200), mechanism_content(),
        data("x.pathway", F.col("x.upstream_entity").alias("upstream"), F.col("x.downstream_entity").alias("downstream"),
             F.col("x.interaction_type").alias("interaction"), "x.context"))
    finds = base(
        rows("key_findings").filter(F.length("x") > 0), "finding", F.lit("Synthesis"), F.lit("soul"), F.lit("moderate"),
        ellipsis(F.col("x"), 200), finding_content(), data())
    raw = (
        papers.filter(F.length(F.trim("abstract")) >= 50)
        .join(extractions.select("paper_id").distinct(), "paper_id", "left_anti")
        .withColumn("paper_title", F.col("title")).withColumn("i", F.lit(0))
    )
    raws = base(raw, "raw_paper", F.lit("Reception"), F.lit("soul"), F.lit("moderate"),
                F.substring("paper_title", 1, 250), raw_paper_content(), data(F.lit("raw").alias("bridge_type")))
    return claims.unionByName(mechs).unionByName(finds).unionByName(raws)


def doi_mentions(kb: DataFrame) -> DataFrame:
    """Distinct (entry, DOI) pairs found in entry texts, lower case."""
    found = F.regexp_extract_all(F.lower("content"), F.lit(r"10\.\d{4,9}/[^\s\"'<>,;]+"), F.lit(0))
    tidy = F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.)\]]+$", "")))
    return kb.select("entry_id", F.explode(tidy).alias("doi"))


def bridge_connections(conns: DataFrame, papers: DataFrame, kb: DataFrame, bridged: DataFrame, limit: int | None = 200):
    """(entries, signals) for connections that pass the thresholds and are not bridged yet.

    Related entries are counted over the DOIs that entry texts mention, by an equi join.
    """
    conf, nov = F.col("confidence"), F.coalesce("novelty_score", F.lit(0.0))
    fit = conns.filter((conf >= L.THRESHOLD_STANDARD[0]) & (nov >= L.THRESHOLD_STANDARD[1])).join(
        bridged.select("connection_id").distinct(), "connection_id", "left_anti")
    if limit is not None:
        ids = papers.select("paper_id")
        for side in ("paper_a_id", "paper_b_id"):
            fit = fit.join(ids.withColumnRenamed("paper_id", side), side, "left_semi")
        fit = cap(fit, [F.desc("confidence"), F.desc("novelty_score"), F.asc("connection_id")], limit)
    named = with_titles(fit, papers, ("title", "doi"))
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    high = (conf >= L.THRESHOLD_HIGH[0]) & (nov >= L.THRESHOLD_HIGH[1])
    graded = named.withColumns({
        "density": vocab.confidence_density(conf), "is_high_priority": high,
        "immediate": conf >= L.THRESHOLD_IMMEDIATE})
    entries = graded.select(
        "connection_id", "paper_a_id", "paper_b_id", F.lit("connection").alias("entry_type"),
        F.lit("Synthesis").alias("operation"), "density", two(conf).alias("confidence"), "is_high_priority", "immediate",
        F.substring(F.concat(F.lit("Connection: "), F.substring("paper_a_title", 1, 100), F.lit(" ←→ "),
                             F.substring("paper_b_title", 1, 100)), 1, 250).alias("title"),
        F.concat_ws("\n", F.concat(F.lit("Connection: "), F.col("paper_a_title"), F.lit(" ←["), F.col("connection_type"),
                                   F.lit("]→ "), F.col("paper_b_title")),
                    F.lit(""), F.col("description"), F.lit(""), F.concat(F.lit("Confidence: "), two(conf)),
                    F.concat(F.lit("Novelty: "), two(nov)), F.concat(F.lit("Type: "), F.col("connection_type")),
                    _line("Paper A DOI: ", F.col("paper_a_doi")), _line("Paper B DOI: ", F.col("paper_b_doi"))).alias("content"),
        F.lit(2).alias("epistemic_tier"), F.lit(L.SOURCE_AUTHORITY).alias("source_authority"))
    loud = graded.filter((conf >= L.THRESHOLD_SIGNAL[0]) & (nov >= L.THRESHOLD_SIGNAL[1]))
    dois = loud.select("connection_id", F.explode(F.array_compact(F.array(
        F.lower("paper_a_doi"), F.lower("paper_b_doi")))).alias("doi"))
    related = dois.join(doi_mentions(kb), "doi").groupBy("connection_id").agg(
        F.count_distinct("entry_id").alias("related_kb_entries"))
    signals = loud.join(related, "connection_id", "left").select(
        "connection_id", F.when(F.col("is_high_priority"), "high").otherwise("medium").alias("priority"),
        F.coalesce("related_kb_entries", F.lit(0)).alias("related_kb_entries"),
        F.lit("Synthesis").alias("suggested_operation"),
        F.substring(F.concat(F.lit("Novel connection: "), F.substring("paper_a_title", 1, 60), F.lit(" ↔ "),
                             F.substring("paper_b_title", 1, 60)), 1, 250).alias("title"))
    return entries, signals
