"""Join building blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def half_edges(conns: DataFrame) -> DataFrame:
    """One row per endpoint, so an either-endpoint test becomes an equi join on ``me``.

    A connection of a paper with itself is counted once.
    """
    a, b = F.col("paper_a_id"), F.col("paper_b_id")
    return (
        conns.withColumn("me", F.explode(F.array_distinct(F.array(a, b))))
        .withColumn("other", F.when(F.col("me") == a, b).otherwise(a))
        .drop("paper_a_id", "paper_b_id")
    )


def canonical_pair(df: DataFrame, a: str = "paper_a_id", b: str = "paper_b_id") -> DataFrame:
    """Smaller id first; inner joins on (a, b) then hit either orientation."""
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return df.withColumns({a: lo, b: hi})


def top_per(df: DataFrame, keys, order, k: int) -> DataFrame:
    """The first ``k`` rows per key. Spark cuts to ``k`` before the shuffle as well."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def latest_per(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, first in ``order``."""
    return top_per(df, keys, order, 1)


def latest_extraction(extractions: DataFrame) -> DataFrame:
    """Of several extractions of a paper the newest one counts."""
    return latest_per(
        extractions, "paper_id", [F.desc_nulls_last("created_at"), F.asc("extraction_id")]
    )


def with_extraction(papers: DataFrame, extractions: DataFrame) -> DataFrame:
    """Every paper with its latest extraction, if any."""
    ext = latest_extraction(extractions)
    shared = [c for c in ext.columns if c in papers.columns and c != "paper_id"]
    return papers.join(ext.drop(*shared), "paper_id", "left")


def with_titles(conns: DataFrame, papers: DataFrame, columns=("title",)) -> DataFrame:
    """Connections with ``columns`` of both papers, as ``paper_a_*`` and ``paper_b_*``."""
    out = conns
    for side in ("a", "b"):
        look = papers.select(
            F.col("paper_id").alias(f"paper_{side}_id"),
            *[F.col(c).alias(f"paper_{side}_{c}") for c in columns],
        )
        out = out.join(look, f"paper_{side}_id")
    return out


def without(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """J05."""
    return df.join(other, on, "left_anti")


def having(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """J06."""
    return df.join(other, on, "left_semi")


def explode_json(df: DataFrame, col: str, schema: str, ordinal: str | None = "idx") -> DataFrame:
    """Rows of a JSON array of objects, with a 1-based ordinal; junk gives no rows."""
    parsed = F.from_json(F.col(col), f"array<{schema}>")
    out = df.select("*", F.posexplode(parsed).alias("_pos", "_item")).filter(
        F.col("_item").isNotNull()
    )
    if ordinal:
        out = out.withColumn(ordinal, F.col("_pos") + 1)
    return out.select("*", "_item.*").drop("_pos", "_item", col)


def subject_object_pairs(triples: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per triple every subject entity with every other object entity.

    The mentions of a triple meet once, as two sets; repeated mentions count once.
    """
    of = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("entity_id")))
    sides = mentions.select("triple_id", "role", "entity_id").repartition("triple_id").groupBy("triple_id").agg(
        of("subject").alias("_subjects"), of("object").alias("_objects"))
    return (
        triples.join(sides, "triple_id")
        .withColumn("source_entity_id", F.explode("_subjects")).withColumn("target_entity_id", F.explode("_objects"))
        .filter(F.col("source_entity_id") != F.col("target_entity_id")).drop("_subjects", "_objects")
    )


def no_edge_either_way(pairs: DataFrame, edges: DataFrame, a="entity_a", b="entity_b") -> DataFrame:
    """Drop pairs that some edge links in either direction."""
    s, t = F.col("source_entity_id"), F.col("target_entity_id")
    linked = edges.select(F.least(s, t).alias("_lo"), F.greatest(s, t).alias("_hi")).distinct()
    return (
        pairs.withColumn("_lo", F.least(F.col(a), F.col(b)))
        .withColumn("_hi", F.greatest(F.col(a), F.col(b)))
        .join(linked, ["_lo", "_hi"], "left_anti")
        .drop("_lo", "_hi")
    )


def citations(papers: DataFrame, rest: int | None = None) -> DataFrame:
    """(citing, cited) pairs by exact DOI, else by the first 60 characters of the title.

    A title of at least 60 characters is an equi join on that prefix. Shorter ones name any
    title that starts with them, with ``rest`` only those that go on for at most so many
    characters; they meet on their exact length, so it is an equi join too.
    """
    refs = papers.select(
        F.col("paper_id").alias("citing"), F.explode("references_list").alias("r")
    ).select(
        "citing",
        F.trim(F.coalesce(F.col("r.doi"), F.lit(""))).alias("doi"),
        F.substring(F.lower(F.trim(F.coalesce(F.col("r.title"), F.lit("")))), 1, 60).alias("prefix"),
    )
    by_doi = refs.filter(F.col("doi") != "").join(
        papers.select(F.col("paper_id").alias("cited"), "doi").filter(F.col("doi").isNotNull()), "doi"
    )
    titled = refs.filter((F.col("doi") == "") & (F.col("prefix") != "")).withColumn(
        "n", F.length("prefix")
    )
    # A cut reference of 60 characters names titles of any length.
    least = F.lit(1) if rest is None else F.least(F.lit(60), F.greatest(F.lit(1), F.length("t") - rest))
    names = (
        papers.filter(F.length("title") > 0)
        .select(F.col("paper_id").alias("cited"), F.lower("title").alias("t"))
        .withColumn("n", F.explode(F.sequence(least, F.least(F.lit(60), F.length("t")))))
        .join(titled.select("n").distinct(), "n", "left_semi")
        .withColumn("prefix", F.expr("substring(t, 1, n)"))
    )
    by_title = titled.join(names, ["n", "prefix"])
    return (
        by_doi.select("citing", "cited")
        .unionByName(by_title.select("citing", "cited"))
        .filter(F.col("citing") != F.col("cited"))
        .distinct()
    )


def alias_keys(entities: DataFrame) -> DataFrame:
    """Every lower-cased name and alias of the entities: (key, rank, entity_id, canonical_name)."""
    named = F.array(F.struct(F.col("canonical_name").alias("label"), F.lit(0).alias("rank")))
    other = F.transform(
        F.coalesce("aliases", F.array().cast("array<string>")),
        lambda a: F.struct(a.alias("label"), F.lit(1).alias("rank")),
    )
    return entities.select(
        "entity_id", "canonical_name", F.explode(F.concat(named, other)).alias("x")
    ).select(F.lower(F.trim("x.label")).alias("key"), F.col("x.rank").alias("rank"), "entity_id",
             "canonical_name").filter(F.length("key") > 0)


def alias_match(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """Seeds with the canonical name of each entity they name, directly or by alias."""
    keys = alias_keys(entities).select("key", "canonical_name").distinct()
    return seeds.withColumn("key", F.lower(F.trim("seed"))).join(keys, "key").drop("key")


def exclude_pairs(pairs: DataFrame, conns: DataFrame, connection_type: str | None = None) -> DataFrame:
    """Drop pairs that are connected already, in either order."""
    known = conns if connection_type is None else conns.filter(F.col("connection_type") == connection_type)
    known = canonical_pair(known.select("paper_a_id", "paper_b_id")).distinct()
    return canonical_pair(pairs).join(known, ["paper_a_id", "paper_b_id"], "left_anti")


def induced_links(nodes: DataFrame, conns: DataFrame, limit: int | None = 2000) -> DataFrame:
    """Connections with both ends in ``nodes``, best first."""
    ids = nodes.select("paper_id").distinct()
    links = conns.filter(F.col("connection_type") != "replicates")
    for side in ("paper_a_id", "paper_b_id"):
        links = links.join(ids.withColumnRenamed("paper_id", side), side, "left_semi")
    return links if limit is None else cap(
        links, [F.desc_nulls_last("confidence"), F.asc("connection_id")], limit
    )


def missed_citations(paper_id, conns: DataFrame, papers: DataFrame, cand: int = 50, limit: int = 20) -> DataFrame:
    """Connected papers that the paper does not cite, most novel first."""
    novelty = F.coalesce("novelty_score", F.lit(0.0))
    near = (
        half_edges(conns.filter((F.col("paper_a_id") == paper_id) | (F.col("paper_b_id") == paper_id)))
        .filter((F.col("me") == paper_id) & (F.col("connection_type") != "replicates"))
        .orderBy(F.desc_nulls_last("novelty_score"), F.desc_nulls_last("confidence"), F.asc("connection_id"))
        .limit(cand)
    )
    near = latest_per(near, "other", [F.asc_nulls_first("novelty_score"), F.asc("confidence"), F.desc("connection_id")])
    cited = (
        papers.filter(F.col("paper_id") == paper_id)
        .select(F.explode("references_list.doi").alias("doi"))
        .select(F.lower(F.trim("doi")).alias("doi_key"))
        .filter(F.length("doi_key") > 0)
        .distinct()
    )
    meta = papers.select(F.col("paper_id").alias("other"), "title", "doi", "journal", "pub_year")
    return (
        near.join(meta, "other")
        .withColumn("doi_key", F.lower(F.trim("doi")))
        .join(cited, "doi_key", "left_anti")
        .select(F.col("other").alias("paper_id"), "title", "doi", "journal", "pub_year",
                "connection_type", "confidence", "novelty_score")
        .orderBy(novelty.desc(), F.desc("confidence"), F.asc("paper_id"))
        .limit(limit)
    )


# --- limits and orders -------------------------------------------------------------------

def cap(df: DataFrame, order, n: int | None) -> DataFrame:
    """The first ``n`` rows in a total order (a top-n, not a sort); all rows, unsorted, for None."""
    return df if n is None else df.orderBy(*order).limit(n)


def page(df: DataFrame, order, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an ordered listing."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def order_by_levels(df: DataFrame, col: str, levels, then=()) -> DataFrame:
    """Order by the place of ``col`` in ``levels``; unlisted values last."""
    rank = F.lit(len(levels))
    for i, level in reversed(list(enumerate(levels))):
        rank = F.when(F.col(col) == level, i).otherwise(rank)
    return df.orderBy(rank, *then)


def last_messages(chat: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    return top_per(chat, "conv_id", [F.desc("turn")], n)


# --- set operations ------------------------------------------------------------------------

def union_sources(*dfs: DataFrame) -> DataFrame:
    """U01."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """U02."""
    return union_sources(*dfs).distinct()


def shared_set(a: Column, b: Column) -> Column:
    """U03."""
    return F.array_sort(F.array_intersect(a, b))


def merge_sets(a: Column, b: Column) -> Column:
    """Distinct union; a missing array counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))
