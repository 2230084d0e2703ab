"""Controlled vocabularies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from litgraph import lookups as L
from litgraph.functions.text import is_null_word, regex_any


def mapped(c: Column, pairs: dict, default: Column | str | None = None) -> Column:
    """Look ``c`` up in a small literal map."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    hit = F.try_element_at(table, c)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def norm_predicate(c: Column) -> Column:
    """lower case with underscores for blanks and hyphens; null becomes empty."""
    return F.coalesce(F.translate(F.lower(F.trim(c)), "- ", "__"), F.lit(""))


def predicate_type(raw: Column) -> Column:
    """predicate type of a normalised verb."""
    return mapped(raw, L.VERB_TYPES, L.DEFAULT_PREDICATE_TYPE)


def direction(ptype: Column) -> Column:
    """direction class of a predicate type."""
    return (
        F.when(ptype.isin(*L.CAUSAL_TYPES), "causal")
        .when(ptype.isin(*L.MECHANISTIC_TYPES), "mechanistic")
        .when(ptype.isin(*L.ASSOCIATIVE_TYPES), "associative")
        .otherwise("descriptive")
    )


def context_type(c: Column) -> Column:
    """coarse class of a context text; keywords hit as plain substrings."""
    s = F.lower(F.trim(c))
    return F.when(
        ~is_null_word(s),
        F.when(s.rlike(regex_any(L.DISEASE_WORDS)), "disease_state")
        .when(s.rlike(f"(?:{regex_any(L.CELL_SUFFIXES)})$"), "cell_type")
        .when(s.rlike(regex_any(L.TISSUE_WORDS)), "tissue")
        .when(s.rlike(regex_any(L.CONDITION_WORDS)), "condition")
        .when(s.rlike(regex_any(L.ORGANISM_WORDS)), "organism")
        .otherwise("unknown"),
    )


def evidence_type(design: Column) -> Column:
    """evidence type of a study design, or null."""
    return mapped(F.translate(F.lower(F.trim(design)), "- ", "__"), L.EVIDENCE_TYPES)


def pathway_predicate(edge_type: Column) -> Column:
    """predicate type of a pathway edge type."""
    return mapped(edge_type, L.PATHWAY_PREDICATES, L.DEFAULT_PREDICATE_TYPE)


def pathway_direction(edge_type: Column) -> Column:
    """direction class of a pathway edge type."""
    return (
        F.when(edge_type.isin(*L.PATHWAY_CAUSAL), "causal")
        .when(edge_type.isin(*L.PATHWAY_MECHANISTIC), "mechanistic")
        .otherwise("associative")
    )


def study_design(c: Column) -> Column:
    """study design from free text; anything unlisted is ``unknown``."""
    low = F.coalesce(F.lower(F.trim(c)), F.lit("unknown"))
    named = F.coalesce(mapped(low, L.STUDY_DESIGN_VARIANTS), low)
    return F.when(named.isin(*L.STUDY_DESIGNS), named).otherwise("unknown")


def sample_size(c: Column) -> Column:
    """the digits of a sample-size text as a number; none or zero becomes null."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    n = digits.try_cast("int")
    return F.when(~is_null_word(c) & (n != 0), n)


def clamp_confidence(c: Column, default: float = 0.5) -> Column:
    """confidence text as a number in 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))


def claim_operation(claim_type: Column) -> Column:
    """operation of a claim type."""
    return mapped(F.lower(F.coalesce(claim_type, F.lit("descriptive"))), L.CLAIM_OPERATIONS, "Synthesis")


def strength_density(strength: Column) -> Column:
    """density of an evidence strength."""
    return mapped(F.lower(F.coalesce(strength, F.lit("moderate"))), L.STRENGTH_DENSITY, "body")


def confidence_density(conf: Column) -> Column:
    """density of a numeric confidence."""
    return F.when(conf >= 0.8, "body").when(conf >= 0.5, "soul").otherwise("spirit")


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """USD for a call, at list prices per million tokens."""
    price_in = mapped(model, {m: p[0] for m, p in L.TOKEN_PRICES.items()}, L.DEFAULT_TOKEN_PRICE[0])
    price_out = mapped(model, {m: p[1] for m, p in L.TOKEN_PRICES.items()}, L.DEFAULT_TOKEN_PRICE[1])
    million = F.lit(1e6)
    return tokens_in / million * price_in + tokens_out / million * price_out


def epistemic_class(strength: Column) -> Column:
    """epistemic class of an evidence-strength label."""
    low = F.lower(strength)
    hits = [F.when(low.rlike(p), F.lit(k)) for p, k in L.EPISTEMIC_CLASSES]
    return F.coalesce(*hits, F.lit("speculation"))


def predicate_phrase(ptype: Column) -> Column:
    """a predicate type in words."""
    return F.coalesce(mapped(ptype, L.PREDICATE_PHRASES), ptype)


def chain_polarity(preds: Column) -> Column:
    """what a chain of predicates does on balance."""
    pos = F.size(F.filter(preds, lambda p: p.isin(*L.POSITIVE_TYPES)))
    neg = F.size(F.filter(preds, lambda p: p.isin(*L.NEGATIVE_TYPES)))
    return (
        F.when(pos > neg, "on balance raises")
        .when(neg > pos, "on balance lowers")
        .otherwise("on balance goes along with")
    )
