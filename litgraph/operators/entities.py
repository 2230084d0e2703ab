"""Triples, entity resolution, mentions and the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from litgraph import lookups as L
from litgraph.functions import vocab
from litgraph.functions.scores import graph_id
from litgraph.functions.text import canonical_form, clean_entity, norm_key, paren_extras
from litgraph.operators.joins import (
    alias_keys, latest_extraction, latest_per, merge_sets, subject_object_pairs,
)
from litgraph.operators.mentions import find as find_terms

TRIPLE_KEY = ("paper_id", "subject", "predicate", "object")
TRIPLE_FIELDS = (
    "extraction_id", "predicate_type", "primary_operation", "evidence_type", "confidence",
    "direction", "edge_context", "context_type", "source_mechanism_index",
)


def _triple_id():
    return F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in TRIPLE_KEY]))


def _typed(df: DataFrame) -> DataFrame:
    """Clean the ends and the verb of raw triples, drop incomplete ones and type the rest."""
    return (
        df.withColumn("subject", clean_entity(F.col("subject")))
        .withColumn("object", clean_entity(F.col("object")))
        .withColumn("predicate", vocab.norm_predicate(F.col("predicate")))
        .filter(F.col("subject").isNotNull() & F.col("object").isNotNull() & (F.col("predicate") != ""))
        .withColumn("predicate_type", vocab.predicate_type(F.col("predicate")))
        .withColumn("direction", vocab.direction(F.col("predicate_type")))
        .withColumn("evidence_type", vocab.evidence_type(F.col("study_design")))
    )


def merge_triples(rows: DataFrame) -> DataFrame:
    """One row per (paper, subject, predicate, object).

    Rows arrive in ``seq`` order. Context fields and, for claims, confidence, operation and
    evidence take the last non-null value; the other fields keep the first row's.
    """
    by_seq = lambda c, pick: pick(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))[
        "v"
    ].alias(c)
    return (
        rows.groupBy(*TRIPLE_KEY)
        .agg(
            by_seq("extraction_id", F.min), F.first("predicate_type").alias("predicate_type"),
            F.first("direction").alias("direction"),
            *[by_seq(c, F.max) for c in ("primary_operation", "evidence_type", "confidence")],
            *[by_seq(c, F.max) for c in ("edge_context", "context_type", "source_mechanism_index")],
        )
        .withColumn("triple_id", _triple_id())
    )


def mechanism_triples(extractions: DataFrame) -> DataFrame:
    """Typed triples from the mechanisms of all extractions."""
    rows = extractions.select(
        "paper_id", "extraction_id", "primary_operation", "study_design", "created_at",
        F.posexplode("mechanisms").alias("pos", "m"),
    ).select(
        "paper_id", "extraction_id", "primary_operation", "study_design",
        F.col("m.upstream_entity").alias("subject"), F.col("m.interaction_type").alias("predicate"),
        F.col("m.downstream_entity").alias("object"), F.col("m.confidence").alias("confidence"),
        clean_entity(F.col("m.context")).alias("edge_context"),
        (F.col("pos") + 1).alias("source_mechanism_index"),
        F.struct(F.col("created_at"), F.col("extraction_id"), F.col("pos")).alias("seq"),
    )
    typed = _typed(rows).withColumn("context_type", vocab.context_type(F.col("edge_context")))
    return merge_triples(typed)


def claim_triples(claims: DataFrame, extractions: DataFrame) -> DataFrame:
    """Typed triples from claims; operation from the claim, else from the latest extraction."""
    latest = latest_extraction(extractions).select(
        "paper_id", "extraction_id", F.col("primary_operation").alias("paper_operation"), "study_design"
    )
    rows = (
        claims.filter(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull())
        .select("claim_id", "paper_id", "subject", "predicate", "object", "operations", "confidence")
        .join(latest, "paper_id", "left")
        .withColumn("primary_operation",
                    F.coalesce(F.try_element_at("operations", F.lit(1)), F.col("paper_operation")))
        .withColumn("edge_context", F.lit(None).cast("string"))
        .withColumn("context_type", F.lit(None).cast("string"))
        .withColumn("source_mechanism_index", F.lit(None).cast("int"))
        .withColumn("seq", F.struct("claim_id"))
    )
    return merge_triples(_typed(rows))


def claims_from_json(extractions: DataFrame, col: str = "claims_json") -> DataFrame:
    """Claims table from JSON text: ``text`` or else ``claim``; empty claims are dropped."""
    schema = ("array<struct<text:string,claim:string,claim_type:string,confidence:double,"
              "section:string,subject:string,predicate:string,object:string>>")
    text = F.coalesce(F.nullif(F.trim("c.text"), F.lit("")), F.nullif(F.trim("c.claim"), F.lit("")))
    return (
        extractions.select("paper_id", "extraction_id", F.explode(F.from_json(col, schema)).alias("c"))
        .select("paper_id", "extraction_id", text.alias("claim_text"), "c.claim_type",
                F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"),
                F.col("c.section").alias("source_section"), "c.subject", "c.predicate", "c.object")
        .filter(F.col("claim_text").isNotNull())
        .withColumn("claim_id", F.md5(F.concat_ws("\u0001", F.col("paper_id").cast("string"), "claim_text")))
    )


# --- resolution and mentions ---------------------------------------------------------------

def alias_lookup(entities: DataFrame) -> DataFrame:
    """One entity per normalised name or alias: names beat aliases, then the smallest id."""
    return (
        alias_keys(entities)
        .withColumn("key", norm_key(F.col("key")))
        .filter(F.col("key") != "")
        .groupBy("key")
        .agg(F.min(F.struct("rank", "entity_id"))["entity_id"].alias("entity_id"))
    )


def alias_collisions(entities: DataFrame) -> DataFrame:
    """Normalised strings that name more than one entity."""
    return (
        alias_keys(entities)
        .withColumn("key", norm_key(F.col("key")))
        .filter(F.col("key") != "")
        .groupBy("key")
        .agg(F.count_distinct("entity_id").alias("entities"))
        .filter(F.col("entities") > 1)
    )


def resolve_entities(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity ids of subjects and objects; earlier matches stay, unknown texts stay null."""
    look = alias_lookup(entities)
    out = triples
    for side in ("subject", "object"):
        col = f"{side}_normalized_id"
        if col not in out.columns:
            out = out.withColumn(col, F.lit(None).cast("string"))
        hit = look.select(F.col("key").alias("_key"), F.col("entity_id").alias("_hit"))
        out = (
            out.withColumn("_key", norm_key(F.col(side)))
            .join(hit, "_key", "left")
            .withColumn(col, F.coalesce("_hit", col))
            .drop("_key", "_hit")
        )
    return out


def mention_dictionary(entities: DataFrame) -> DataFrame:
    """Terms of at least two characters: (term, entity_id, source), names before aliases."""
    return (
        alias_keys(entities)
        .filter(F.length("key") >= 2)
        .groupBy(F.col("key").alias("term"))
        .agg(F.min(F.struct("rank", "entity_id")).alias("best"))
        .select(
            "term", F.col("best.entity_id").alias("entity_id"),
            F.when(F.col("best.rank") == 0, "canonical").otherwise("alias").alias("source"),
        )
    )


def find_mentions(texts: DataFrame, entities: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Leftmost-longest, non-overlapping dictionary terms of each text, ignoring case.

    A term counts only between non-alphanumeric characters. Texts are scanned where they are (see ``scan`` in ``mentions.py``).
    """
    found = find_terms(texts.select(id_col, text_col), mention_dictionary(entities), text_col)
    return found.select(id_col, "at", "match_text", "entity_id", "source")


def expand_mentions(triples: DataFrame, entities: DataFrame, only_new=False, existing: DataFrame | None = None) -> DataFrame:
    """Entity mentions inside the subjects and objects of triples.

    With ``only_new``, triples that ``existing`` has mentions of are not scanned again. Texts stay where they are; only
    the mentions of repeated triples meet to be told apart.
    """
    if only_new and existing is not None:
        triples = triples.join(existing.select("triple_id").distinct(), "triple_id", "left_anti")
    sides = triples.select("triple_id", F.explode(F.array(
        F.struct(F.lit("subject").alias("role"), F.col("subject").alias("text")),
        F.struct(F.lit("object").alias("role"), F.col("object").alias("text")),
    )).alias("s")).select("triple_id", "s.role", "s.text")
    exact = F.length("match_text") == F.length(F.trim("text"))
    return find_terms(sides, mention_dictionary(entities), "text").select(
        "triple_id", "entity_id", "role", "match_text",
        F.concat("source", F.when(exact, "_exact").otherwise("_substring")).alias("match_source"),
    ).distinct()


# --- edges ---------------------------------------------------------------------------------

def edge_facts(triples: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples as (source, target) entity pairs with the names and operations of both ends."""
    pairs = subject_object_pairs(triples, mentions)
    for side in ("source", "target"):
        look = entities.select(
            F.col("entity_id").alias(f"{side}_entity_id"),
            F.col("canonical_name").alias(f"{side}_entity_name"),
            F.col("primary_operation").alias(f"{side}_entity_op"),
        )
        pairs = pairs.join(look, f"{side}_entity_id")
    return pairs.filter(F.col("predicate_type").isNotNull())


EDGE_KEY = ("source_entity_name", "target_entity_name", "predicate_type")


def literature_edges(triples, mentions, entities, min_support=1) -> DataFrame:
    """Edges with distinct-paper support, confidences, usual direction and contradictions.

    The papers behind an edge stay rows (see ``edge_papers``): an array would put every paper of
    a popular edge in one record.
    """
    return edges_of_facts(edge_facts(triples, mentions, entities), min_support)


def edges_of_facts(facts: DataFrame, min_support=1) -> DataFrame:
    """Edges from ``edge_facts``, which are dealt by edge once; the first fact of a paper there counts the paper."""
    usual = F.mode("primary_operation", True)
    against = (F.col("predicate_type") == "blocks") | F.coalesce(F.col("direction") == "contradicts", F.lit(False))
    w = Window.partitionBy(*EDGE_KEY, "paper_id").orderBy(F.desc("_against"))
    dealt = facts.withColumn("_against", against).repartition(*EDGE_KEY)
    first = F.col("_first") & F.col("paper_id").isNotNull()
    edges = dealt.withColumn("_first", F.row_number().over(w) == 1).groupBy(*EDGE_KEY).agg(
        F.min("source_entity_id").alias("source_entity_id"),
        F.min("target_entity_id").alias("target_entity_id"),
        F.mode("direction", True).alias("direction"),
        F.coalesce(F.min("source_entity_op"), usual).alias("source_operation"),
        F.coalesce(F.min("target_entity_op"), usual).alias("target_operation"),
        F.count_if(first).alias("support_count"),
        F.avg("confidence").alias("mean_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.count_if(first & F.col("_against")).alias("contradiction_load"),
    )
    return _finish(edges.filter(F.col("support_count") >= min_support), "literature")


def _finish(edges: DataFrame, source: str) -> DataFrame:
    out = edges.withColumn(
        "is_cross_operation",
        F.coalesce(F.col("source_operation") != F.col("target_operation"), F.lit(False)),
    ).withColumn("edge_source", F.lit(source))
    return out if "pathway_id" in out.columns else out.withColumn("pathway_id", F.lit(None).cast("string"))


def edge_papers(triples, mentions, entities) -> DataFrame:
    """The distinct papers that support each literature edge, as rows."""
    return edge_facts(triples, mentions, entities).select(*EDGE_KEY, "paper_id").distinct()


def triple_edges(triples: DataFrame) -> DataFrame:
    """A10: edges straight from triple texts; support counts triples, not papers."""
    return (
        triples.filter((F.length("subject") > 0) & (F.length("object") > 0))
        .groupBy("subject", "object", "predicate", "predicate_type", "direction")
        .agg(
            F.max("primary_operation").alias("source_operation"),
            F.max("secondary_operation").alias("target_operation"),
            F.count(F.lit(1)).alias("support_count"),
            F.round(F.avg("confidence"), 3).alias("mean_confidence"),
            F.round(F.max("confidence"), 3).alias("max_confidence"),
        )
        .select(
            F.concat(F.lit("triple:"), F.md5(F.concat_ws(
                "|", F.lower("subject"), "predicate", F.lower("object"),
                F.coalesce("predicate_type", F.lit("")), F.coalesce("direction", F.lit("")),
                "subject", "object",
            ))).alias("edge_key"),
            F.col("subject").alias("source_entity_name"), F.col("object").alias("target_entity_name"),
            F.coalesce("predicate_type", "predicate").alias("predicate_type"), "direction",
            "source_operation", "target_operation",
            F.coalesce(F.col("source_operation") != F.col("target_operation"), F.lit(False)).alias("is_cross_operation"),
            "support_count", "mean_confidence", "max_confidence",
            F.lit("triple").alias("edge_source"), F.lit(0).cast("long").alias("contradiction_load"),
        )
    )


def backbone_edges(nodes: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Curated pathway edges, support and confidence one."""
    named = edges
    for side, ref in (("source", "from_node"), ("target", "to_node")):
        look = nodes.select(
            "pathway_id", F.col("node_id").alias(ref), F.col("name").alias(f"{side}_entity_name"),
            F.col("operation").alias(f"{side}_operation"),
        )
        ids = entities.select(
            F.col("entity_id").alias(f"{side}_entity_id"), F.col("canonical_name").alias(f"{side}_entity_name")
        )
        named = named.join(look, ["pathway_id", ref]).join(ids, f"{side}_entity_name", "left")
    out = named.select(
        *[f"{s}_entity_{c}" for s in ("source", "target") for c in ("id", "name")],
        vocab.pathway_predicate(F.col("edge_type")).alias("predicate_type"),
        vocab.pathway_direction(F.col("edge_type")).alias("direction"),
        "source_operation", "target_operation", "pathway_id", "edge_id",
        F.lit(1).cast("long").alias("support_count"), F.lit(1.0).alias("mean_confidence"),
        F.lit(1.0).alias("max_confidence"), F.lit(0).cast("long").alias("contradiction_load"),
    )
    # An edge is known by its ends, predicate and pathway; a later row replaces an earlier one.
    return _finish(latest_per(out, [*EDGE_KEY, "pathway_id"], [F.desc("edge_id")]).drop("edge_id"), "backbone")


def build_entity_edges(triples, mentions, entities, pathway_nodes, pathway_edges, min_support=1) -> DataFrame:
    """Literature edges and curated pathway edges, rebuilt from scratch."""
    lit = literature_edges(triples, mentions, entities, min_support)
    return lit.unionByName(backbone_edges(pathway_nodes, pathway_edges, entities))


def extended_edges(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """The entity edges and the triple-text edges as one edge set."""
    key = F.md5(F.concat_ws("|", *EDGE_KEY, F.coalesce("pathway_id", F.lit("lit"))))
    keep = ("edge_key", *EDGE_KEY, "direction", "source_operation", "target_operation", "is_cross_operation",
            "support_count", "mean_confidence", "max_confidence", "edge_source", "contradiction_load")
    return edges.withColumn("edge_key", key).select(*keep).unionByName(triple_edges(triples).select(*keep))


# --- entity statistics ---------------------------------------------------------------------

def entity_ends(triples: DataFrame) -> DataFrame:
    """One row per triple and distinct resolved end."""
    ids = F.array_distinct(F.array_compact(F.array("subject_normalized_id", "object_normalized_id")))
    return triples.select("paper_id", "primary_operation", F.explode(ids).alias("entity_id"))


def entity_stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Papers and triples per entity."""
    known = entity_ends(triples).join(entities.select("entity_id"), "entity_id", "left_semi")
    return known.groupBy("entity_id").agg(
        F.count_distinct("paper_id").alias("paper_count"), F.count(F.lit(1)).alias("triple_count")
    )


def operation_distribution(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples per operation as a map, and the bridge score."""
    known = (
        entity_ends(triples).filter(F.col("primary_operation").isNotNull())
        .join(entities.select("entity_id"), "entity_id", "left_semi")
    )
    per_op = known.groupBy("entity_id", "primary_operation").agg(F.count(F.lit(1)).alias("n"))
    return per_op.groupBy("entity_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("primary_operation", "n")))).alias("operation_distribution"),
        F.count(F.lit(1)).alias("n_ops"), F.sum("n").alias("n_triples"),
    ).withColumn("bridge_score", bridge_score(F.col("n_ops"), F.col("n_triples")))


def bridge_score(n_ops, n_triples):
    """Higher when an entity takes part in many operations."""
    return F.least(F.lit(1.0), n_ops / 8.0 * F.least(F.lit(1.0), F.log(1 + n_triples) / 10.0))


# --- discovered entities -------------------------------------------------------------------

def surface_forms(extractions: DataFrame) -> DataFrame:
    """F02 over extracted entities: one row per canonical form, parentheticals included."""
    e = extractions.select("paper_id", "extraction_id", F.posexplode("entities").alias("pos", "e")).select(
        "paper_id", "extraction_id", "pos", F.trim("e.text").alias("display"),
        F.coalesce(F.nullif("e.entity_type", F.lit("")), F.lit("unknown")).alias("entity_type"),
        F.col("e.confidence").alias("confidence"),
    )
    fit = lambda c: F.length(c).between(2, 200)
    forms = F.concat(
        F.array(F.struct(F.lit(0).alias("part"), canonical_form(F.col("display")).alias("canonical_text"),
                         F.col("display").alias("display_text"))),
        F.transform(paren_extras(F.col("display")),
                    lambda x, i: F.struct((i + 1).alias("part"), canonical_form(x).alias("canonical_text"),
                                          x.alias("display_text"))),
    )
    return (
        e.filter(fit(canonical_form(F.col("display"))))
        .withColumn("f", F.explode(forms))
        .select("paper_id", "extraction_id", "pos", "f.*", "entity_type", "confidence")
        .filter(fit("canonical_text"))
    )


def discovered_entities(extractions: DataFrame) -> DataFrame:
    """Roll-up per canonical text, recomputed from all extractions."""
    return surface_forms(extractions).groupBy("canonical_text").agg(
        F.min_by("display_text", F.struct("extraction_id", "pos", "part")).alias("display_text"),
        F.mode("entity_type", True).alias("entity_type"),
        F.count(F.lit(1)).alias("mention_count"),
        F.count_distinct("paper_id").alias("paper_count"),
        F.avg("confidence").alias("confidence_avg"),
    )


def entity_mentions(extractions: DataFrame) -> DataFrame:
    """Best confidence per paper and canonical text."""
    return surface_forms(extractions).groupBy("paper_id", "canonical_text").agg(
        F.max("confidence").alias("confidence")
    )


def import_entities(extractions: DataFrame):
    """(discovered entities, their mentions)."""
    return discovered_entities(extractions), entity_mentions(extractions)


# --- graph materialisation -----------------------------------------------------------------

def build_graph(papers: DataFrame, extractions: DataFrame):
    """Node and edge tables of the literature graph, of all authors, claims, mechanisms and methods of a paper."""
    ext = extractions.select("paper_id", "extraction_id", "entities", "claims", "mechanisms", "methods")
    pid = F.col("paper_id").cast("string")
    item = lambda col: ext.select("paper_id", "extraction_id", F.posexplode(col).alias("i", "x"))
    cut = lambda c: F.substring(c, 1, 500)
    node = lambda df, label, props: df.select(
        "id", F.lit(label).alias("label"), *[p.alias(n) for n, p in props.items()])
    low = lambda c, default: F.lower(F.coalesce(c, F.lit(default)))

    p = papers.select(pid.alias("id"), "title", "abstract")
    authors = papers.select("paper_id", F.explode("authors").alias("name")).withColumn(
        "name", F.trim("name")).filter(F.col("name") != "").withColumn("id", F.col("name"))
    entities = item("entities").withColumn("text", F.trim("x.text")).filter(F.col("text") != "").withColumn(
        "kind", low(F.col("x.entity_type"), "unknown")).withColumn(
        "id", graph_id(F.concat_ws(":", "kind", "text")))
    claims = item("claims").withColumn("text", F.trim("x.text")).filter(F.col("text") != "").withColumn(
        "id", graph_id(F.concat_ws(":", pid, F.lit("claim"), "i", "text")))
    mechs = item("mechanisms").withColumn("text", F.trim("x.description")).filter(
        F.col("text") != "").withColumn("id", graph_id(F.concat_ws(":", pid, F.lit("mech"), "i", "text")))
    methods = item("methods").withColumn("text", F.trim("x.name")).filter(F.col("text") != "").withColumn(
        "id", graph_id(F.concat(F.lit("method:"), F.lower("text"))))

    none = F.lit(None).cast("string")
    one = lambda df, props: df.groupBy("id").agg(*[F.min(c).alias(n) for n, c in props.items()])
    nodes = (
        p.select("id", F.lit("Paper").alias("label"), F.col("title").alias("text"), none.alias("kind"))
        .unionByName(authors.select("id").distinct().select(
            "id", F.lit("Researcher").alias("label"), F.col("id").alias("text"), none.alias("kind")))
        .unionByName(node(one(entities, {"text": F.col("text"), "kind": F.col("kind")}), "Entity",
                          {"text": F.col("text"), "kind": F.col("kind")}))
        .unionByName(node(one(claims, {"text": cut("text"), "kind": low(F.col("x.claim_type"), "descriptive")}),
                          "Claim", {"text": F.col("text"), "kind": F.col("kind")}))
        .unionByName(node(one(mechs, {"text": cut("text"), "kind": F.col("x.interaction_type")}), "Mechanism",
                          {"text": F.col("text"), "kind": F.col("kind")}))
        .unionByName(node(one(methods, {"text": F.col("text"), "kind": low(F.col("x.category"), "other")}),
                          "Method", {"text": F.col("text"), "kind": F.col("kind")}))
    )
    kinds = ((authors, "AUTHORED_BY"), (entities, "HAS_ENTITY"), (claims, "MAKES_CLAIM"),
             (mechs, "DESCRIBES_MECHANISM"), (methods, "USES_METHOD"))
    edges = None
    for df, kind in kinds:
        e = df.select(pid.alias("src"), F.col("id").alias("dst"), F.lit(kind).alias("type")).distinct()
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges


def load_backbone(pathways: DataFrame):
    """(nodes, edges, canonical entities) of nested pathway records."""
    nodes = pathways.select(F.col("id").alias("pathway_id"), F.posexplode("nodes").alias("i", "n")).select(
        "pathway_id", "i", F.col("n.id").alias("node_id"), "n.name", "n.aliases", "n.node_type", "n.operation")
    edges = pathways.select(F.col("id").alias("pathway_id"), F.posexplode("edges").alias("i", "e")).select(
        "pathway_id", F.concat(F.col("pathway_id"), F.lit("_edge_"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("edge_id"),
        F.col("e.from").alias("from_node"), F.col("e.to").alias("to_node"), "e.edge_type")
    last = latest_per(nodes, "name", [F.desc("pathway_id"), F.desc("i")])
    entities = last.select(
        F.md5("name").alias("entity_id"), F.col("name").alias("canonical_name"),
        vocab.mapped(F.col("node_type"), L.NODE_ENTITY_TYPES, "process").alias("entity_type"),
        "aliases", F.col("operation").alias("primary_operation"))
    return nodes.drop("i"), edges, entities


def merge_aliases(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """Add seed entities and widen the alias sets of known ones; seeds of one name are merged first."""
    s = seeds.groupBy("canonical_name").agg(
        F.min("entity_type").alias("_entity_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("_aliases"),
        F.min("primary_operation").alias("_primary_operation"))
    return entities.join(s, "canonical_name", "full").select(
        F.coalesce("entity_id", F.md5("canonical_name")).alias("entity_id"), "canonical_name",
        F.coalesce("entity_type", "_entity_type").alias("entity_type"),
        merge_sets(F.col("aliases"), F.col("_aliases")).alias("aliases"),
        F.coalesce("primary_operation", "_primary_operation").alias("primary_operation"),
    )
