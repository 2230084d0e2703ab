"""Corpus reports and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from litgraph import lookups as L
from litgraph.functions.text import any_of, contains_ci
from litgraph.operators.joins import cap, half_edges, latest_extraction, latest_per, top_per, union_sources
from litgraph.operators.worksets import degree


def not_insufficient() -> Column:
    return F.coalesce(F.col("brief_confidence"), F.lit("")) != "insufficient"


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """A01."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(papers, extractions, conns, critiques) -> DataFrame:
    """Totals as (metric, value) rows; each table is read once."""
    total = F.count(F.lit(1))
    size = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0))
    full = F.count_if(F.col("data_source").startswith("full_text"))
    parts = [
        (papers, {
            "papers": total,
            "extracted_papers": F.count_if(F.col("status") == "extracted"),
            "full_text_papers": full,
            "full_text_pct": F.round(full / F.greatest(total, F.lit(1)) * 100, 1),
        }),
        (extractions, {
            "extractions": total, "entities": size("entities"), "claims": size("claims"),
            "extraction_cost": F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4),
        }),
        (conns, {"all_connections": total, "connections": F.count_if(F.col("connection_type") != "replicates")}),
        (critiques, {"critiques": total, "high_quality_critiques": F.count_if(F.col("overall_quality") == "high")}),
    ]
    rows = [
        df.agg(*[c.cast("double").alias(m) for m, c in metrics.items()]).select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics
        ])))
        for df, metrics in parts
    ]
    return union_sources(*rows)


def convergences(conns, papers, min_confidence=0.7, min_connections=2, limit=20) -> DataFrame:
    """Papers where several sure connections meet."""
    strong = half_edges(
        conns.filter((F.col("confidence") >= min_confidence) & (F.col("connection_type") != "replicates"))
        .select("connection_id", "paper_a_id", "paper_b_id", "connection_type", "confidence")
    )
    met = (
        strong.groupBy(F.col("me").alias("paper_id"))
        .agg(
            F.count(F.lit(1)).alias("connection_count"),
            F.avg("confidence").alias("avg_confidence"),
            F.sort_array(F.collect_set("connection_type")).alias("connection_types"),
        )
        .filter(F.col("connection_count") >= min_connections)
        .withColumn("avg_confidence", F.round("avg_confidence", 6))
    )
    ranked = met.join(papers.select("paper_id", "title", "doi"), "paper_id")
    return cap(ranked, [F.desc("connection_count"), F.desc("avg_confidence"), F.asc("paper_id")], limit)


def convergence_descriptions(conv: DataFrame, conns: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """A04 (detail): the distinct descriptions of the sure connections behind each convergence, as rows."""
    ends = half_edges(conns.filter((F.col("connection_type") != "replicates") & (F.col("confidence") >= min_confidence)))
    return (
        ends.join(conv.select(F.col("paper_id").alias("me")), "me", "left_semi")
        .select(F.col("me").alias("paper_id"), "description")
        .distinct()
    )


def convergence_details(conv, conns, papers, extractions, min_confidence=0.7, k=5) -> DataFrame:
    """The best connected papers and first finding of every convergence."""
    ids = conv.select(F.col("paper_id").alias("me"))
    ends = half_edges(
        conns.filter((F.col("confidence") >= min_confidence) & (F.col("connection_type") != "replicates"))
    ).join(ids, "me", "left_semi")
    best = top_per(ends, "me", [F.desc("confidence"), F.asc("connection_id")], k)
    named = best.join(papers.select(F.col("paper_id").alias("other"), "title"), "other")
    lists = named.groupBy(F.col("me").alias("paper_id")).agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.col("confidence")).alias("neg_confidence"), "connection_id",
            F.col("other").alias("paper_id"), "title", "connection_type",
        ))).alias("connected")
    )
    findings = latest_extraction(
        extractions.join(ids.withColumnRenamed("me", "paper_id"), "paper_id", "left_semi")
    ).select("paper_id", F.try_element_at("key_findings", F.lit(1)).alias("key_finding"))
    return conv.join(lists, "paper_id", "left").join(findings, "paper_id", "left")


def convergence_clusters(conns, papers, critiques, min_count=3, limit=10) -> DataFrame:
    """Papers with many convergent-evidence ends, with their critique if usable."""
    kind = conns.filter(F.col("connection_type") == "convergent_evidence")
    ends = kind.select(F.col("paper_a_id").alias("paper_id")).unionAll(
        kind.select(F.col("paper_b_id").alias("paper_id"))
    )
    counts = ends.groupBy("paper_id").agg(F.count(F.lit(1)).alias("conv_count")).filter(
        F.col("conv_count") >= min_count
    )
    top = cap(counts.join(papers.select("paper_id", "title", "journal"), "paper_id"),
              [F.desc("conv_count"), F.asc("paper_id")], limit)
    usable = latest_critique(critiques.filter(not_insufficient()))
    return top.join(usable.select("paper_id", "overall_quality", "methodology_score"), "paper_id", "left")


def uncritiqued_hubs(papers, conns, critiques, limit=20) -> DataFrame:
    """Best-connected papers without a critique."""
    open_ = degree(conns).join(critiques.select("paper_id").distinct(), "paper_id", "left_anti")
    return cap(
        open_.join(papers.select("paper_id", "title", "doi", "journal", "status"), "paper_id"),
        [F.desc("connection_count"), F.asc("paper_id")], limit,
    )


def topic_counts(papers: DataFrame, critiques: DataFrame) -> DataFrame:
    """Usable critiques per topic tag."""
    usable = critiques.filter(not_insufficient()).select("critique_id", "paper_id")
    return (
        papers.select("paper_id", F.explode("topic_tags").alias("topic"))
        .join(usable, "paper_id")
        .groupBy("topic")
        .agg(F.count_distinct("critique_id").alias("brief_count"))
    )


def resolution_rates(triples: DataFrame) -> DataFrame:
    """Share of triples whose subject, object or both are resolved."""
    s, o = F.col("subject_normalized_id").isNotNull(), F.col("object_normalized_id").isNotNull()
    pct = lambda c: F.round(100.0 * F.col(c) / F.greatest(F.col("total"), F.lit(1)), 1)
    return triples.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s).alias("subjects"),
        F.count_if(o).alias("objects"), F.count_if(s & o).alias("both"),
    ).withColumns({"subject_pct": pct("subjects"), "object_pct": pct("objects"), "both_pct": pct("both")})


def edge_report(edges: DataFrame) -> DataFrame:
    """Edges by source, predicate and operation pair, in one pass over the edges."""
    cross = F.col("is_cross_operation")
    keys = F.explode(F.array_compact(F.array(
        F.struct(F.lit("source").alias("section"), F.col("edge_source").alias("key")),
        F.struct(F.lit("predicate").alias("section"), F.col("predicate_type").alias("key")),
        F.when(cross, F.struct(
            F.lit("operations").alias("section"),
            F.concat_ws("→", "source_operation", "target_operation").alias("key"))),
    )))
    return (
        edges.select(keys.alias("k"), cross.alias("cross"))
        .groupBy("k.section", "k.key")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("cross").alias("cross_op"))
    )


def top_cross_edges(edges: DataFrame, min_support=1, n=15) -> DataFrame:
    """Best-supported edges between different operations."""
    return cap(
        edges.filter(F.col("is_cross_operation") & (F.col("support_count") >= min_support)),
        [F.desc("support_count"), F.asc("source_entity_name"), F.asc("target_entity_name"),
         F.asc("predicate_type")], n,
    )


def critique_candidates(papers, extractions, conns, critiques, model_id, min_connections=0, limit=10) -> DataFrame:
    """Papers worth a critique, by impact score."""
    # Counted before the latest one is sought, so that no nested field travels.
    counted = extractions.select(
        "paper_id", "extraction_id", "created_at", F.coalesce(F.size("entities"), F.lit(0)).alias("entity_count"),
        F.coalesce(F.size("claims"), F.lit(0)).alias("claim_count"), "extraction_completeness")
    rich = latest_extraction(counted).filter((F.col("entity_count") >= 3) & (F.col("claim_count") >= 2)).select(
        "paper_id", "entity_count", "claim_count", "extraction_completeness")
    done = critiques.filter(
        (F.col("model_id") == model_id) | (F.col("brief_confidence") == "insufficient")
    ).select("paper_id").distinct()
    score = (
        F.col("connection_count") * 2 + F.col("entity_count") * 2 + F.col("claim_count") * 2
        + F.when(F.col("data_source").startswith("full_text"), 25).otherwise(0)
        + F.when(F.coalesce("extraction_completeness", F.lit(0.0)) >= 0.5, 10).otherwise(0)
    )
    return cap(
        papers.filter(F.col("title").isNotNull() & ~F.col("status").isin("error", "skipped", "queued"))
        .select("paper_id", "title", "data_source")
        .join(rich, "paper_id")
        .join(done, "paper_id", "left_anti")
        .join(degree(conns), "paper_id", "left")
        .withColumn("connection_count", F.coalesce("connection_count", F.lit(0)))
        .filter(F.col("connection_count") >= min_connections)
        .withColumn("impact_score", score),
        [F.desc("impact_score"), F.desc("connection_count"), F.asc("paper_id")], limit,
    )


def spend(ledgers: DataFrame, by=("day", "task", "model"), daily_limit: float | None = None) -> DataFrame:
    """Cost and calls per day, task and/or model; with a limit, flags days over it."""
    out = ledgers.withColumn("day", F.to_date("ts")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
    )
    return out if daily_limit is None else out.withColumn("over_budget", F.col("cost_usd") >= daily_limit)


def kb_breakdown(kb: DataFrame) -> DataFrame:
    """A20."""
    return count_by(kb, "entry_type", "operation", "density")


def outreach_stats(queue: DataFrame) -> DataFrame:
    """Queue size and cost per status, empty statuses included."""
    spark = queue.sparkSession
    names = spark.createDataFrame([(s,) for s in L.OUTREACH_STATUSES], "status string")
    got = queue.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
    )
    return names.join(got, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")
    )


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per label and edges per type."""
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("kind", F.lit("node")).unionByName(e.withColumn("kind", F.lit("edge")))


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Papers per collection; empty collections stay."""
    n = members.groupBy("collection_id").agg(F.count("paper_id").alias("paper_count"))
    return collections.join(n, "collection_id", "left").withColumn(
        "paper_count", F.coalesce("paper_count", F.lit(0))
    )


def pct_filled(df: DataFrame, col: str) -> DataFrame:
    """Share of rows with a value; null for an empty table."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(col).alias("filled")).withColumn(
        "pct", F.round(100.0 * F.col("filled") / F.nullif(F.col("total"), F.lit(0)), 1)
    )


def seed_density(seeds, edges, papers, min_edges=10, min_papers=20) -> DataFrame:
    """Edges that touch each seed and papers that name it; thin seeds are flagged.

    Seeds are a short question-sized list: one conditional count per seed in a single pass over
    the papers, no seed-by-paper join.
    """
    names = [r.seed for r in seeds.select("seed").distinct().orderBy("seed").collect()]
    ends = edges.select(F.explode(F.array_distinct(F.array(
        F.lower("source_entity_name"), F.lower("target_entity_name")))).alias("key"))
    touching = ends.groupBy("key").agg(F.count(F.lit(1)).alias("edges"))
    hit = lambda s: any_of([contains_ci(F.col("title"), s), contains_ci(F.col("abstract"), s)])
    named = papers.agg(*[F.count_if(hit(s)).alias(f"s{i}") for i, s in enumerate(names)])
    rows = named.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("seed"), F.col(f"s{i}").alias("papers")) for i, s in enumerate(names)
    ])))
    return (
        rows.withColumn("key", F.lower("seed"))
        .join(touching, "key", "left")
        .withColumn("edges", F.coalesce("edges", F.lit(0)))
        .withColumn("thin", (F.col("edges") < min_edges) | (F.col("papers") < min_papers))
        .drop("key")
    )


def path_histograms(paths: DataFrame) -> DataFrame:
    """How many paths have each hop and crossing count."""
    return (
        paths.select(F.explode(F.array(
            F.struct(F.lit("hops").alias("measure"), F.col("hops").alias("value")),
            F.struct(F.lit("crossings").alias("measure"), F.col("op_boundary_crossings").alias("value")),
        )).alias("x"))
        .groupBy("x.measure", "x.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_entities(df: DataFrame, key: str, by: str, n: int = 15) -> DataFrame:
    """Entities with the largest ``by``."""
    return cap(df, [F.desc_nulls_last(by), F.asc(key)], n)


def briefs(critiques, papers, conns, view=None, topic=None, quality=None, sort="methodology",
           limit=20, skip=0) -> DataFrame:
    """Listing of usable critiques with views, topic, quality and order."""
    df = critiques.filter(not_insufficient())
    if quality in ("high", "medium", "low"):
        df = df.filter(F.col("overall_quality") == quality)
    if view == "must-reads":
        df, sort = df.filter(F.col("overall_quality") == "high"), "novelty"
    elif view == "hubs":
        sort = "connections"
    elif view == "recent":
        sort = "date"
    elif view == "controversies":
        against = half_edges(conns.filter(F.col("connection_type") == "contradicts"))
        df = df.join(against.select(F.col("me").alias("paper_id")), "paper_id", "left_semi")
    about = papers if topic is None else papers.filter(F.array_contains("topic_tags", topic))
    df = df.join(about.select("paper_id", F.col("title").alias("paper_title"), "journal", "published_date",
                              "data_source"), "paper_id")
    orders = {
        "methodology": F.desc_nulls_last("methodology_score"),
        "novelty": F.desc_nulls_last("novelty_score"),
        "connections": F.desc("connection_count"),
        "date": F.desc("created_at"),
    }
    paged = lambda x: (x.offset(skip) if skip else x).limit(limit)
    order = [orders.get(sort, orders["methodology"]), F.asc("critique_id")]
    if sort != "connections":  # only the hubs' order needs all degrees; the others count those of the page
        df = paged(df.orderBy(*order))
        ends = half_edges(conns).select(F.col("me").alias("paper_id"), "connection_id").join(df.select("paper_id").distinct(), "paper_id", "left_semi")
        n = ends.groupBy("paper_id").agg(F.count_distinct("connection_id").alias("connection_count"))
    else:
        n = degree(conns)
    counted = df.join(n, "paper_id", "left").withColumn("connection_count", F.coalesce("connection_count", F.lit(0)))
    return paged(counted.orderBy(*order)) if sort == "connections" else counted.orderBy(*order)


def critiques_list(critiques, papers, conns, quality=None, limit=20, skip=0) -> DataFrame:
    """Usable critiques, best method first, then newest; degree only for the page shown."""
    df = critiques.filter(not_insufficient())
    if quality:
        df = df.filter(F.col("overall_quality") == quality)
    df = df.join(papers.select("paper_id", F.col("title").alias("paper_title"), "journal"), "paper_id")
    ordered = df.orderBy(F.desc_nulls_last("methodology_score"), F.desc("created_at"), F.asc("critique_id"))
    top = (ordered.offset(skip) if skip else ordered).limit(limit)
    ends = half_edges(conns).select(F.col("me").alias("paper_id")).join(top.select("paper_id"), "paper_id", "left_semi")
    n = ends.groupBy("paper_id").agg(F.count(F.lit(1)).alias("connection_count"))
    return top.join(n, "paper_id", "left").withColumn("connection_count", F.coalesce("connection_count", F.lit(0)))


def latest_critique(critiques: DataFrame) -> DataFrame:
    """W01."""
    return latest_per(critiques, "paper_id", [F.desc("created_at"), F.asc("critique_id")])


def best_connection(conns: DataFrame) -> DataFrame:
    """The surest connection of each paper."""
    return top_connections(conns, 1)


def top_connections(conns: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` surest connections of each paper."""
    return top_per(half_edges(conns), "me", [F.desc("confidence"), F.asc("connection_id")], k)


