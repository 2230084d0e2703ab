"""Literature tables derived from the given tables by SQL that both Spark and DuckDB run.

Every derivation reads its tables whole. ``FX`` texts may name each other; ``with_ctes`` puts the
needed ones in front of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from litgraph.lookups import OPERATIONS

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")


def _pick(expr: str, values) -> str:
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(f"'{x}'" if x else "null" for x in values))
    return f"case {expr} {whens} end"


OP = lambda e: _pick(f"({e}) % 8", OPERATIONS)
N_PART = "(select count(*) from part)"

FX = {
    "fx_papers": f"""
select o_orderkey as paper_id, o_orderpriority as source, concat('X', cast(o_orderkey as string)) as external_id,
 concat('Paper ', cast(o_orderkey as string)) as title,
 case when o_custkey % 10 = 0 then null else concat('Study by group ', cast(o_custkey as string), ': ', repeat('result ', cast(o_custkey % 30 as int)), lower(o_orderpriority)) end as abstract,
 concat('Author ', cast(o_custkey as string)) as author,
 concat('Journal ', cast(o_custkey % 25 as string)) as journal, cast(o_orderdate as date) as published_date,
 cast(extract(year from o_orderdate) as int) as pub_year,
 case when o_custkey % 7 = 0 then null else concat('10.1000/p', cast(o_orderkey as string)) end as doi,
 {_pick("cast(floor(o_totalprice) as bigint) % 4", ("full_text_pmc", "full_text_biorxiv", "abstract_only", "unknown"))} as data_source,
 case o_orderstatus when 'O' then 'extracted' when 'F' then 'parsed' else 'fetched' end as status,
 concat('topic', cast(o_custkey % 12 as string)) as topic1, concat('topic', cast(o_custkey % 5 as string)) as topic2,
 cast(floor(o_totalprice / 1000) as int) as citation_count, cast(o_orderdate as date) as created_date
from orders""",
    # One extraction per order line: several models may have read the same paper.
    "fx_ext": f"""
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_shipdate as date) as string), cast(cast(floor(l_extendedprice) as bigint) as string)) as extraction_id,
 l_orderkey as paper_id, cast(l_shipdate as date) as created_date, concat('model-', cast(l_linenumber as string)) as model_id,
 l_partkey as k1, (l_partkey * 7 + l_suppkey) % {N_PART} as k2, (l_partkey + l_suppkey * 3) % {N_PART} as k3, l_suppkey as s,
 l_linenumber as ln, cast(floor(l_quantity) as bigint) as qty,
 cast(50 + 5 * cast(round(l_discount * 100) as int) as double) / 100 as conf,
 cast(10 * cast(round(l_tax * 100) as int) as double) / 100 as nov,
 {_pick("(l_suppkey + l_linenumber) % 5", ("rct", "cohort", "in vitro", "unknown", "Case-Control"))} as study_design,
 case when l_suppkey % 9 = 0 then null else {OP("l_suppkey")} end as primary_operation,
 {_pick("l_linenumber % 5", ("causal", "associative", "mechanistic", "descriptive", "null"))} as claim_type,
 {_pick("(l_linenumber + cast(floor(l_quantity) as bigint)) % 7", ("Activates", "reduces", "blocks", "binds", "up-regulates", "depends on", "restores"))} as verb,
 {_pick("cast(floor(l_quantity) as bigint) % 6", ("liver tissue", "type 2 diabetes", "hepatocyte", "fasting", "mouse model", "none"))} as context,
 {_pick("l_linenumber % 3", ("strong", "moderate", "weak"))} as strength
from lineitem""",
    "fx_pe": """
select l_orderkey as paper_id, p_partkey as entity_id, lower(concat(p_name, ' ', cast(p_partkey as string))) as entity,
 p_type as entity_type, max(cast(floor(l_quantity) as double)) / 100 as confidence
from lineitem join part on p_partkey = l_partkey group by l_orderkey, p_partkey, p_name, p_type""",
    "fx_connections": """
select concat_ws('-', cast(a as string), cast(b as string), ctype) as connection_id, a as paper_a_id, b as paper_b_id,
 ctype as connection_type, concat(ctype, ' seen between ', cast(a as string), ' and ', cast(b as string)) as description,
 cast(max(conf) as double) / 100 as confidence, cast(max(nov) as double) / 100 as novelty_score, max(day) as created_date
from (select least(x, y) as a, greatest(x, y) as b, ctype, conf, nov, day from (
  select l_orderkey as x, (l_orderkey * 7 + l_partkey * 13 + l_linenumber) % (select count(*) from orders) as y,
   case (l_partkey + l_suppkey) % 7 when 0 then 'contradicts' when 1 then 'extends' when 2 then 'mechanism_for' when 3 then 'shares_target' when 4 then 'methodological_parallel' when 5 then 'convergent_evidence' else 'replicates' end as ctype,
   50 + 5 * cast(round(l_discount * 100) as int) as conf, 10 * cast(round(l_tax * 100) as int) as nov, cast(l_shipdate as date) as day
  from lineitem) t0 where x <> y) t1 group by a, b, ctype""",
    "fx_half": """
select paper_a_id as me, paper_b_id as other, connection_id, connection_type, description, confidence, novelty_score from fx_connections
union all
select paper_b_id, paper_a_id, connection_id, connection_type, description, confidence, novelty_score from fx_connections""",
    "fx_critiques": """
select concat('c', cast(doc_id as string)) as critique_id, doc_id as paper_id,
 case when doc_id % 2 = 0 then 'model-a' else 'model-b' end as model_id,
 case when quality = 1 then 'high' when toxic = 1 then 'low' else 'medium' end as overall_quality,
 cast(4 + quality * 4 - toxic * 2 as double) as methodology_score, cast((doc_id * 7) % 10 as double) as novelty_score,
 case when doc_id % 11 = 0 then 'insufficient' when quality = 1 then 'high' else null end as brief_confidence,
 cast(doc_id % 100 as int) as created_at
from labels""",
    "fx_docs": """
select doc_id as paper_id, source, lang, concat('Document ', cast(doc_id as string)) as title, text as abstract, n_chars from documents""",
    "fx_entities": f"""
select concat('C', cast(p_partkey as string)) as entity_id, concat('E', cast(p_partkey as string)) as canonical_name,
 concat('Factor-', cast(p_partkey as string)) as alias1, lower(p_name) as alias2, p_type as entity_type,
 case when p_size % 9 = 0 then null else {OP("p_size")} end as primary_operation
from part""",
    "fx_triples": f"""
select extraction_id as triple_id, paper_id, extraction_id, concat('E', cast(k1 as string)) as subject,
 case ln % 3 when 0 then 'activates' when 1 then 'inhibits' else 'blocks' end as predicate,
 concat('E', cast(k2 as string)) as object,
 case ln % 3 when 0 then 'activates' when 1 then 'inhibits' else 'blocks' end as predicate_type,
 'causal' as direction, primary_operation, case when qty % 5 = 0 then null else {OP("qty")} end as secondary_operation,
 conf as confidence,
 case when k1 % 10 = 0 then null else concat('C', cast(k1 as string)) end as subject_normalized_id,
 case when k2 % 10 = 1 then null else concat('C', cast(k2 as string)) end as object_normalized_id
from fx_ext""",
    "fx_prose": """
select extraction_id as triple_id, concat('E', cast(k1 as string)) as subject,
 concat('e', cast(k2 as string), ' response (Factor-', cast(k3 as string), '), xE', cast(k3 as string)) as object, k1, k2, k3
from fx_ext""",
    "fx_mentions": """
select distinct triple_id, entity_id, role from (
 select extraction_id as triple_id, concat('C', cast(k1 as string)) as entity_id, 'subject' as role from fx_ext
 union all select extraction_id, concat('C', cast(k2 as string)), 'object' from fx_ext
 union all select extraction_id, concat('C', cast(k3 as string)), 'object' from fx_ext) t""",
    "fx_edges": f"""
select concat('E', cast(src as string)) as source_entity_name, concat('E', cast(dst as string)) as target_entity_name,
 concat('C', cast(src as string)) as source_entity_id, concat('C', cast(dst as string)) as target_entity_id, predicate_type,
 {OP("src")} as source_operation, {OP("dst")} as target_operation, (src % 8) <> (dst % 8) as is_cross_operation,
 cast(1 + src % 5 as bigint) as support_count, cast(40 + (src * 7 + dst) % 60 as double) / 100 as mean_confidence,
 case when src % 4 = 0 then 'backbone' else 'literature' end as edge_source,
 cast(case when predicate_type = 'blocks' then 1 else 0 end as bigint) as contradiction_load,
 concat_ws('|', cast(src as string), cast(dst as string), predicate_type) as edge_key
from (select distinct p_partkey as src, (p_partkey * m + p_size * 13 + m) % {N_PART} as dst,
  case p_type when 'ECONOMY' then 'activates' when 'LARGE' then 'inhibits' when 'MEDIUM' then 'induces' when 'PROMO' then 'blocks' when 'SMALL' then 'correlates_with' else 'requires' end as predicate_type
 from (select p_partkey, p_size, p_type, 7 as m from part union all select p_partkey, p_size, p_type, 11 as m from part) k) t
where src <> dst""",
    "fx_mechs": """
select paper_id, extraction_id, concat('E', cast(k1 as string)) as upstream_entity, concat('E', cast(k2 as string)) as downstream_entity,
 verb as interaction_type, concat('E', cast(k1 as string), ' ', verb, ' E', cast(k2 as string), ' in ', context) as description,
 concat('pathway ', cast(s % 20 as string)) as pathway, context, conf as confidence, ln, study_design, primary_operation, created_date
from fx_ext""",
    "fx_claims": """
select concat('cl', extraction_id) as claim_id, paper_id, extraction_id, claim_type,
 concat('E', cast(k1 as string), ' ', verb, ' E', cast(k3 as string)) as claim_text, concat('E', cast(k1 as string)) as subject,
 verb as predicate, concat('E', cast(k3 as string)) as object, strength as evidence_strength, conf as confidence,
 primary_operation, study_design, created_date, qty
from fx_ext""",
    "fx_pm": """
select distinct l_orderkey as paper_id, concat('method ', cast(l_suppkey as string)) as method from lineitem""",
    "fx_spend": """
select event_id, ts, event_type as task, concat('model-', cast(user_id % 4 as string)) as model, value as cost_usd, user_id,
 concat('user', cast(user_id as string), '@example.org') as email from events""",
    "fx_queue": """
select connection_id as outreach_id, connection_id, paper_a_id, paper_b_id, connection_type, confidence,
 case cast(round(confidence * 100) as int) % 20 when 0 then 'pending_draft' when 5 then 'drafted' when 10 then 'sent' else 'skipped' end as status,
 novelty_score as cost_usd, created_date as created_at from fx_connections""",
    "fx_kb": """
select concat('kb', claim_id) as entry_id, paper_id, claim_text as title,
 concat('Claim: ', claim_text, ' see 10.1000/p', cast(paper_id as string), '.') as content,
 case claim_type when 'causal' then 'Conduction' when 'mechanistic' then 'Transduction' when 'associative' then 'Reception' else 'Synthesis' end as operation,
 case evidence_strength when 'strong' then 'body' when 'moderate' then 'soul' else 'spirit' end as density, 'claim' as entry_type,
 concat('{"connection_id":"', cast(paper_id as string), '"}') as structured_data
from fx_claims""",
}


def with_ctes(sql: str) -> str:
    """A query with the derivations it names, and those they name, as CTEs."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name in FX and name not in need:
                visit(FX[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} as ({FX[n].strip()})" for n in need)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"with recursive {ctes},\n{re.sub(r'(?i)^with recursive', '', body).strip()}"
    if re.match(r"(?i)with\s", body):
        return f"with {ctes},\n{re.sub(r'(?i)^with', '', body).strip()}"
    return f"with {ctes}\n{body}"


class Tables:
    """The given tables and the derived ones as DataFrames; attribute names are table names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def sql(self, text: str) -> DataFrame:
        query = with_ctes(text)
        for name in BASE_TABLES:
            if re.search(rf"\b{name}\b", query):
                self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if f"fx_{name}" in FX:
            return self.sql(f"select * from fx_{name}")
        raise AttributeError(name)

    # Nested forms, as the operators take them.

    def nested_papers(self) -> DataFrame:
        return self.papers.withColumns({
            "authors": F.array("author", F.concat(F.col("author"), F.lit(" jr"))),
            "topic_tags": F.array_distinct(F.array("topic1", "topic2")),
            "mesh_terms": F.array("topic1", "topic2"),
            "created_at": F.col("created_date"),
        })

    def nested_extractions(self) -> DataFrame:
        """Extractions with arrays of structs, built row by row (no grouping)."""
        e = lambda k: F.concat(F.lit("E"), F.col(k).cast("string"))
        ent = lambda k, kind: F.struct(e(k).alias("text"), F.lit(kind).alias("entity_type"), F.col("conf").alias("confidence"))
        claim = F.struct(
            F.concat(e("k1"), F.lit(" "), F.col("verb"), F.lit(" "), e("k3")).alias("text"), "claim_type",
            e("k1").alias("subject"), F.col("verb").alias("predicate"), e("k3").alias("object"),
            F.col("strength").alias("evidence_strength"), F.col("conf").alias("confidence"),
            F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("operations"))
        mech = F.struct(
            F.concat(e("k1"), F.lit(" "), F.col("verb"), F.lit(" "), e("k2"), F.lit(" in "), F.col("context")).alias("description"),
            F.concat(F.lit("pathway "), (F.col("s") % 20).cast("string")).alias("pathway"), e("k1").alias("upstream_entity"),
            e("k2").alias("downstream_entity"), F.col("verb").alias("interaction_type"), "context",
            F.col("conf").alias("confidence"))
        none = F.array()
        return self.ext.select(
            "extraction_id", "paper_id", "model_id", "study_design", "primary_operation",
            F.col("created_date").alias("created_at"), F.when(F.col("qty") % 3 != 0, F.col("qty")).alias("sample_size"),
            F.when(F.col("qty") % 4 == 0, "").otherwise("adults").alias("population"),
            F.when(F.col("qty") % 5 == 0, None).otherwise("drug").alias("intervention"),
            F.lit("outcome").alias("primary_outcome"), F.col("nov").alias("cost_usd"),
            F.array(ent("k1", "gene"), ent("k2", "protein"), ent("k3", "disease")).alias("entities"),
            F.when(F.col("qty") % 2 == 0, F.array(claim, claim)).otherwise(F.array(claim)).alias("claims"),
            F.array(mech).alias("mechanisms"),
            F.array(F.struct(F.concat(F.lit("method "), F.col("s").cast("string")).alias("name"), F.lit("assay").alias("category"))).alias("methods"),
            F.when(F.col("ln") > 3, F.array(F.concat(F.lit("finding "), F.col("qty").cast("string")))).otherwise(none.cast("array<string>")).alias("key_findings"),
        )

    def nested_entities(self) -> DataFrame:
        return self.entities.withColumn("aliases", F.array("alias1", "alias2")).drop("alias1", "alias2")
