"""Listings, filters and derived paper fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from litgraph.functions.text import any_of, contains_ci
from litgraph.operators.joins import half_edges, latest_extraction, page, with_titles

ORDERS = {
    "created_at": [F.desc_nulls_last, "created_at"],
    "published_date": [F.desc_nulls_last, "published_date"],
    "citation_count": [F.desc_nulls_last, "citation_count"],
    "title": [F.asc, "title"],
}


def degree(conns: DataFrame) -> DataFrame:
    """Connections per paper."""
    return half_edges(conns.select("connection_id", "paper_a_id", "paper_b_id")).groupBy(
        F.col("me").alias("paper_id")
    ).agg(F.count(F.lit(1)).alias("connection_count"))


def papers_list(papers, conns, critiques, status="extracted", source=None, order_by="created_at",
                limit=50, offset=0) -> DataFrame:
    """A page of papers with their degree and whether they have a critique.

    The page is cut first; only its papers are looked up in connections and critiques.
    """
    df = papers
    if status:
        df = df.filter(F.col("status") == status)
    if source:
        df = df.filter(F.col("source") == source)
    how, col = ORDERS.get(order_by, ORDERS["created_at"])
    top = page(df, [how(col), F.asc("paper_id")], limit, offset)
    ids = top.select("paper_id")
    ends = half_edges(conns.select("connection_id", "paper_a_id", "paper_b_id")).join(
        ids.withColumnRenamed("paper_id", "me"), "me", "left_semi"
    )
    counts = ends.groupBy(F.col("me").alias("paper_id")).agg(F.count(F.lit(1)).alias("connection_count"))
    judged = critiques.join(ids, "paper_id", "left_semi").select("paper_id").distinct()
    return (
        top.join(counts, "paper_id", "left")
        .join(judged.withColumn("has_critique", F.lit(True)), "paper_id", "left")
        .withColumn("connection_count", F.coalesce("connection_count", F.lit(0)))
        .withColumn("has_critique", F.coalesce("has_critique", F.lit(False)))
    )


def connections_list(conns, papers, connection_type=None, min_confidence=0.5, limit=50, offset=0) -> DataFrame:
    """A page of connections that are sure enough and no replications."""
    df = conns.filter((F.col("confidence") >= min_confidence) & (F.col("connection_type") != "replicates"))
    if connection_type:
        df = df.filter(F.col("connection_type") == connection_type)
    # A connection shows only with both papers known, so that test comes before the cut.
    ids = papers.select("paper_id")
    for side in ("paper_a_id", "paper_b_id"):
        df = df.join(ids.withColumnRenamed("paper_id", side), side, "left_semi")
    top = page(df, [F.desc("confidence"), F.asc("connection_id")], limit, offset)
    return with_titles(top, papers)


def contains_any(df: DataFrame, cols, needle: str) -> DataFrame:
    """Rows with ``needle`` in any of ``cols``, ignoring case."""
    return df.filter(any_of([contains_ci(F.col(c), needle) for c in cols]))


def with_tag(df: DataFrame, tag: str) -> DataFrame:
    """P04."""
    return df.filter(F.array_contains("topic_tags", tag))


def full_text_only(df: DataFrame) -> DataFrame:
    """P05."""
    return df.filter(F.col("data_source").startswith("full_text"))


def safe_json_array(c: Column, schema: str) -> Column:
    """JSON text as an array; junk, ``null`` and non-arrays become an empty array."""
    kind = f"array<{schema}>"
    return F.coalesce(F.when(F.ltrim(c).startswith("["), F.from_json(c, kind)), F.array().cast(kind))


def structured_field(df: DataFrame, path: str, name: str = "value", col: str = "structured_data") -> DataFrame:
    """A JSON path as a column, ready to be a join key."""
    return df.withColumn(name, F.get_json_object(F.col(col), f"$.{path}"))


def classify_source(papers: DataFrame) -> DataFrame:
    """Fill an unknown data source from what text the paper has."""
    full = F.coalesce(F.length("full_text"), F.lit(0)) > 500
    preprint = F.col("source").isin("biorxiv", "medrxiv")
    guess = (
        F.when(full & preprint, "full_text_biorxiv")
        .when(full, "full_text_pmc")
        .when(F.length("abstract") > 50, "abstract_only")
        .otherwise("unknown")
    )
    known = F.nullif("data_source", F.lit("unknown")) if "data_source" in papers.columns else F.lit(None)
    return papers.withColumn("data_source", F.coalesce(known, guess))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def completeness(extractions: DataFrame) -> DataFrame:
    """How many of the ten extraction fields are filled, and the share of ten."""
    tests = [
        F.coalesce(F.col("study_design") != "unknown", F.lit(False)),
        F.col("sample_size").isNotNull(),
        *[_filled(c) for c in ("population", "intervention", "primary_outcome")],
        *[_some(c) for c in ("entities", "claims", "mechanisms", "key_findings", "methods")],
    ]
    n = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    return (
        extractions.withColumn("fields_extracted", n)
        .withColumn("fields_attempted", F.lit(10))
        .withColumn("extraction_completeness", F.col("fields_extracted") / 10.0)
    )


def brief_confidence(critiques: DataFrame, papers: DataFrame, extractions: DataFrame) -> DataFrame:
    """P10: confidence of a critique from the paper's source and extraction completeness."""
    full = F.col("data_source").startswith("full_text")
    level = (
        F.when(full & (F.col("extraction_completeness") >= 0.5), "high")
        .when(full, "medium")
        .otherwise("low")
    )
    ext = latest_extraction(extractions).select("paper_id", "extraction_completeness")
    return (
        critiques.join(papers.select("paper_id", "data_source"), "paper_id")
        .join(ext, "paper_id", "left")
        .withColumn("brief_confidence", level)
        .drop("data_source", "extraction_completeness")
    )


def data_quality(papers: DataFrame) -> DataFrame:
    """Quality level with the lists of available and missing evidence."""
    source = F.coalesce("data_source", F.lit("unknown"))
    full = source.startswith("full_text")
    known = {
        label: F.coalesce(~F.lower(c).isin("unknown", "", "null", "none"), F.lit(False))
        for c, label in (("study_design", "Study design"), ("population", "Study population"),
                         ("primary_outcome", "Primary outcome"))
    }
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("finding_count", "entity_count", "claim_count")}
    enough = {"finding_count": n["finding_count"] >= 2, "entity_count": n["entity_count"] >= 3,
              "claim_count": n["claim_count"] >= 2}
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    available = F.array_compact(F.array(
        F.when(full, "Full text"),
        *[F.when(t, k) for k, t in known.items()],
        F.when(enough["finding_count"], text(n["finding_count"].cast("string"), " key findings")),
        F.when(enough["entity_count"], text(n["entity_count"].cast("string"), " entities")),
        F.when(enough["claim_count"], text(n["claim_count"].cast("string"), " claims")),
    ))
    missing = F.array_compact(F.array(
        F.when(source == "abstract_only", "Full text (abstract alone)")
        .when(~full, "Full text (source not known)"),
        *[F.when(~t, k) for k, t in known.items()],
        F.when(~enough["finding_count"], "Key findings (under two)"),
        F.when(~enough["entity_count"],
               text("Entities (only ", n["entity_count"].cast("string"), " found)")),
        F.when(~enough["claim_count"],
               text("Claims (only ", n["claim_count"].cast("string"), " found)")),
    ))
    done = F.coalesce("extraction_completeness", F.lit(0.0))
    return (
        papers.withColumn("available", available)
        .withColumn("missing", missing)
        .withColumn(
            "data_quality",
            F.when(full & (done >= 0.5) & (F.size("missing") <= 2), "high")
            .when((done >= 0.3) & enough["entity_count"], "medium")
            .otherwise("low"),
        )
    )


def extraction_worklist(papers, extractions, statuses=("fetched", "parsed"), limit=50) -> DataFrame:
    """Papers still to extract, full text first, then parsed before fetched, newest first."""
    rank = F.when(F.col("status") == "parsed", 0).when(F.col("status") == "fetched", 1).otherwise(2)
    return (
        papers.filter(F.col("status").isin(*statuses) & (F.length("abstract") >= 100))
        .join(extractions.select("paper_id").distinct(), "paper_id", "left_anti")
        .orderBy(
            F.when(F.coalesce(F.length("full_text"), F.lit(0)) > 0, 0).otherwise(1),
            rank, F.desc_nulls_last("pub_year"), F.asc("paper_id"),
        )
        .limit(limit)
    )


def backfill_worklist(papers, extractions, limit=5000) -> DataFrame:
    """Extractions without an operation, of papers that have an abstract."""
    return (
        extractions.filter(F.col("primary_operation").isNull())
        .join(papers.filter(F.col("abstract").isNotNull()).select("paper_id", "title", "abstract"), "paper_id")
        .orderBy(F.desc_nulls_last("created_at"), F.asc("extraction_id"))
        .limit(limit)
    )


def fulltext_worklist(papers: DataFrame, limit=200) -> DataFrame:
    """Preprints that still lack full text, newest first."""
    return (
        papers.filter(
            F.col("source").isin("biorxiv", "medrxiv")
            & F.col("doi").isNotNull()
            & (F.coalesce(F.length("full_text"), F.lit(0)) == 0)
        )
        .orderBy(F.desc_nulls_last("published_date"), F.asc("paper_id"))
        .limit(limit)
    )


def embedding_text(papers: DataFrame, extractions: DataFrame) -> DataFrame:
    """The text a paper is embedded by."""
    ext = latest_extraction(extractions).select("paper_id", "key_findings", "entities")
    labelled = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c))
    texts = F.filter(F.transform(F.slice("entities", 1, 10), lambda e: e["text"]), lambda t: F.length(t) > 0)
    return papers.join(ext, "paper_id", "left").select(
        "paper_id",
        F.concat_ws(
            "\n",
            labelled("Title: ", F.col("title")),
            labelled("Abstract: ", F.substring("abstract", 1, 600)),
            labelled("Key findings: ", F.concat_ws("; ", F.slice("key_findings", 1, 3))),
            labelled("Entities: ", F.concat_ws(", ", texts)),
        ).alias("embedding_text"),
    )


SECTION_BUDGETS = (("introduction", 3000), ("methods", 5000), ("results", 8000),
                   ("discussion", 4000), ("conclusion", 2000))


def _budgeted(c: Column, n: int, what: str) -> Column:
    note = F.concat(F.lit(f"\n... [TRUNCATED — original {what} was "), F.length(c).cast("string"), F.lit(" chars]"))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), note)).otherwise(c)


def extraction_prompt_text(papers: DataFrame) -> DataFrame:
    """Paper text for an extraction request, each section within its character budget."""
    parts = [
        F.when(F.col("sections").getItem(k).isNotNull(),
               F.concat(F.lit(f"\n{k.upper()}:\n"), _budgeted(F.col("sections").getItem(k), n, "section")))
        for k, n in SECTION_BUDGETS
    ]
    has_sections = F.coalesce(F.size("sections") > 0, F.lit(False))
    whole = F.when(
        ~has_sections & (F.length("full_text") > 0),
        F.concat(F.lit("\nFULL TEXT (excerpt):\n"), _budgeted(F.col("full_text"), 12000, "text")),
    )
    return papers.select(
        "paper_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("TITLE: "), F.col("title")),
            F.when(F.length("abstract") > 0, F.concat(F.lit("\nABSTRACT:\n"), F.col("abstract"))),
            *parts,
            whole,
        ).alias("prompt_text"),
    )


def graph_view(nodes, links, sources=(), types=(), min_confidence=0.0):
    """Links and nodes that pass the filters; nodes left without a link go."""
    kept = nodes.filter(F.col("source").isin(*sources)) if sources else nodes
    out = links.filter(F.col("confidence") >= min_confidence)
    if types:
        out = out.filter(F.col("connection_type").isin(*types))
    ids = kept.select("paper_id")
    for side in ("paper_a_id", "paper_b_id"):
        out = out.join(ids.withColumnRenamed("paper_id", side), side, "left_semi")
    ends = half_edges(out).select(F.col("me").alias("paper_id")).distinct()
    return kept.join(ends, "paper_id", "left_semi"), out


def missing_embeddings(extractions: DataFrame, limit=200) -> DataFrame:
    """Extractions that still need a vector, newest first."""
    return (
        extractions.filter(F.col("embedding").isNull())
        .orderBy(F.desc_nulls_last("created_at"), F.asc("extraction_id"))
        .limit(limit)
    )


def validate(df: DataFrame, rules: dict[str, Column]):
    """(good rows, quarantined rows with the names of the rules they break)."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()
    ]))
    tested = df.withColumn("reasons", broken)
    return tested.filter(F.size("reasons") == 0).drop("reasons"), tested.filter(F.size("reasons") > 0)
