"""Stored model answers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from litgraph import lookups as L
from litgraph.functions import vocab
from litgraph.functions.text import balanced_object, clean_value, nonempty, strip, strip_comments, strip_fences

EXTRACTION_XML = """
study_design string, sample_size string, population string, intervention string, comparator string,
primary_outcome string, secondary_outcomes string, funding string, conflicts string,
key_findings struct<finding:array<string>>,
entities struct<entity:array<struct<_VALUE:string,_type:string,_confidence:string>>>,
claims struct<claim:array<struct<_VALUE:string,text:string,_type:string,_strength:string,_confidence:string,
  _subject:string,_predicate:string,_object:string,_operations:string>>>,
mechanisms struct<mechanism:array<struct<_confidence:string,description:string,upstream:string,downstream:string,
  interaction:string,pathway:string,context:string>>>,
methods struct<method:array<struct<_VALUE:string,_category:string>>>,
limitations struct<limitation:array<string>>,
operation struct<primary:string,secondary:string,confidence:string,reasoning:string>,
_broken string
"""
# The elements of an answer; other tags are markup inside a text.
EXTRACTION_TAGS = (
    "extraction study_design sample_size population intervention comparator primary_outcome secondary_outcomes funding "
    "conflicts key_findings finding entities entity claims claim text mechanisms mechanism description upstream downstream "
    "interaction pathway context methods method limitations limitation operation primary secondary confidence reasoning").split()
MARKUP = rf"</?(?!(?:{'|'.join(EXTRACTION_TAGS)})[\s/>])[A-Za-z][^<>]*>"


def _split(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def _texts(items: Column) -> Column:
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), strip)
    return F.filter(trimmed, lambda x: F.length(x) > 0)


def _rows(items: str, keep, shape) -> Column:
    """Non-empty items of an optional list, reshaped."""
    return F.coalesce(F.transform(F.filter(items, keep), shape), F.array())


def parse_extraction_xml(raw: DataFrame, col: str = "response") -> DataFrame:
    """Extraction rows from answers with an ``<extraction>`` block; rows without one or with broken XML get nulls."""
    block = strip_comments(F.regexp_extract(F.col(col), r"(?s)(<extraction>.*?</extraction>)", 1))
    block = F.regexp_replace(block, MARKUP, "")
    x = raw.withColumn("x", F.from_xml(nonempty(block), EXTRACTION_XML, {"columnNameOfCorruptRecord": "_broken"}))
    x = x.withColumn("x", F.when(F.col("x._broken").isNull(), F.col("x")))
    conf = lambda v: vocab.clamp_confidence(v)
    value = lambda v: nonempty(strip(v))
    said = lambda c: F.coalesce(value(c["text"]), value(c["_VALUE"]))
    known_op = lambda o: F.when(o.isin(*L.OPERATIONS), o)
    entity = lambda e: F.struct(
        strip(e["_VALUE"]).alias("text"), F.coalesce(e["_type"], F.lit("unknown")).alias("entity_type"),
        conf(e["_confidence"]).alias("confidence"))
    claim = lambda c: F.struct(
        said(c).alias("text"), F.coalesce(c["_type"], F.lit("descriptive")).alias("claim_type"),
        nonempty(c["_subject"]).alias("subject"), nonempty(c["_predicate"]).alias("predicate"),
        nonempty(c["_object"]).alias("object"), F.coalesce(c["_strength"], F.lit("moderate")).alias("evidence_strength"),
        conf(c["_confidence"]).alias("confidence"), _split(c["_operations"]).alias("operations"))
    mechanism = lambda m: F.struct(
        strip(m["description"]).alias("description"), value(m["pathway"]).alias("pathway"),
        value(m["upstream"]).alias("upstream_entity"), value(m["downstream"]).alias("downstream_entity"),
        value(m["interaction"]).alias("interaction_type"), value(m["context"]).alias("context"),
        conf(m["_confidence"]).alias("confidence"))
    method = lambda m: F.struct(strip(m["_VALUE"]).alias("name"),
                                F.coalesce(m["_category"], F.lit("other")).alias("category"))
    return x.withColumns({
        "study_design": vocab.study_design(F.col("x.study_design")),
        "sample_size": vocab.sample_size(F.col("x.sample_size")),
        **{c: clean_value(strip(F.col(f"x.{c}"))) for c in ("population", "intervention", "comparator", "primary_outcome")},
        "secondary_outcomes": _split(F.col("x.secondary_outcomes")),
        "key_findings": _texts(F.col("x.key_findings.finding")),
        "entities": _rows("x.entities.entity", lambda e: F.length(strip(e["_VALUE"])) > 0, entity),
        "claims": _rows("x.claims.claim", lambda c: said(c).isNotNull(), claim),
        "mechanisms": _rows("x.mechanisms.mechanism", lambda m: F.length(strip(m["description"])) > 0, mechanism),
        "methods": _rows("x.methods.method", lambda m: F.length(strip(m["_VALUE"])) > 0, method),
        "limitations": _texts(F.col("x.limitations.limitation")),
        "primary_operation": known_op(strip(F.col("x.operation.primary"))),
        "secondary_operations": F.filter(_split(F.col("x.operation.secondary")), lambda o: o.isin(*L.OPERATIONS)),
        "operation_confidence": strip(F.col("x.operation.confidence")).try_cast("double"),
        "conflicts_of_interest": clean_value(strip(F.col("x.conflicts"))),
    }).drop("x", col)


_VERDICT = ("connected:boolean,connection_type:string,description:string,confidence:double,novelty_score:double,"
            "supporting_evidence:array<string>")


def _json_body(c: Column) -> Column:
    """A JSON object in an answer: the text without fences, or from its first to its last brace."""
    text = strip_fences(c)
    return F.when(text.startswith("{"), text).otherwise(nonempty(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def parse_validation_json(raw: DataFrame, col: str = "response") -> DataFrame:
    """Connections from pair verdicts; unconnected pairs and replications are dropped."""
    v = raw.withColumn("v", F.from_json(_json_body(F.col(col)), f"struct<{_VERDICT}>"))
    kind = F.coalesce("v.connection_type", F.lit("unknown"))
    return v.filter(F.col("v.connected") & (kind != "replicates")).withColumns({
        "connection_type": kind, "description": F.coalesce("v.description", F.lit("")),
        "confidence": F.coalesce("v.confidence", F.lit(0.5)), "novelty_score": F.coalesce("v.novelty_score", F.lit(0.5)),
        "supporting_evidence": F.coalesce("v.supporting_evidence", F.array().cast("array<string>")),
    }).drop("v", col)


_CRITIQUE = ("overall_quality:string,methodology_score:double,reproducibility_score:double,novelty_score:double,"
             "statistical_rigor:double,strengths:array<string>,weaknesses:array<string>,red_flags:array<string>,"
             "summary:string,recommendation:string")


def parse_critique_json(raw: DataFrame, col: str = "response") -> DataFrame:
    """Critiques from answers; an unreadable answer gives the defaults and says so."""
    text = strip_fences(F.col(col))
    parsed = F.coalesce(
        F.from_json(F.when(text.startswith("{") & text.endswith("}"), text), f"struct<{_CRITIQUE}>"),
        F.from_json(balanced_object(text), f"struct<{_CRITIQUE}>"))
    out = raw.withColumns({"_text": text, "c": parsed})
    ok = F.coalesce(F.col("c").isNotNull() & (F.size(F.map_keys(F.from_json(F.coalesce(
        F.when(F.col("_text").startswith("{") & F.col("_text").endswith("}"), F.col("_text")),
        balanced_object("_text")), "map<string,string>"))) > 0), F.lit(False))
    out = out.withColumn("_ok", ok)
    none = F.array().cast("array<string>")
    score = lambda n: F.coalesce(f"c.{n}", F.lit(5.0))
    return out.withColumns({
        "overall_quality": F.coalesce("c.overall_quality", F.lit("medium")),
        **{n: score(n) for n in ("methodology_score", "reproducibility_score", "novelty_score", "statistical_rigor")},
        "strengths": F.coalesce("c.strengths", none),
        "weaknesses": F.when(F.col("_ok"), F.coalesce("c.weaknesses", none)).otherwise(
            F.array(F.lit("Could not parse response"))),
        "red_flags": F.coalesce("c.red_flags", none),
        "summary": F.when(F.col("_ok"), F.coalesce("c.summary", F.lit(""))).otherwise(F.substring("_text", 1, 300)),
        "recommendation": F.coalesce("c.recommendation", F.lit("skim")),
    }).drop("c", "_ok", "_text", col)
