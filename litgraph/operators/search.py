"""Text search and concept queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from litgraph.functions.text import any_of, contains_ci, tokens
from litgraph.operators.joins import cap, half_edges, latest_extraction, top_per
from litgraph.operators.paths import shortest_paths
from litgraph.operators.reports import latest_critique, not_insufficient
from litgraph.operators.worksets import contains_any, degree


def term_index(papers: DataFrame, cols=("title", "abstract")) -> DataFrame:
    """Inverted index (term, paper_id, tf) over the whole texts."""
    words = tokens(F.concat_ws(" ", *cols))
    return papers.select("paper_id", F.explode_outer(words).alias("term")).filter(F.col("term").isNotNull()).groupBy("term", "paper_id").agg(
        F.count(F.lit(1)).alias("tf"))


def parse_query(query: str, mode: str = "web") -> list[dict[str, list]]:
    """Alternatives of a query, each with wanted ``terms``, ``phrases`` (lists of terms) and excluded terms or phrases ``without``.

    ``web``: words and "quoted phrases" are all wanted, ``-`` excludes the next one, ``or`` begins another alternative,
    so it binds less tightly than the words beside it, as in the web search syntax of PostgreSQL.
    """
    words = lambda s: re.findall(r"[^\W_]+", s)
    if mode != "web":
        return [{"terms": sorted(set(words(query.lower()))), "phrases": [], "without": []}]
    groups = [{"terms": [], "phrases": [], "without": []}]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            groups.append({"terms": [], "phrases": [], "without": []})
            continue
        found = words(phrase or word)
        if not found:
            continue
        if minus or word.startswith("-"):
            groups[-1]["without"].append(found)
        else:
            groups[-1]["terms"] += found
            if len(found) > 1:
                groups[-1]["phrases"].append(found)
    for g in groups:
        g["terms"] = sorted(set(g["terms"]))
    return [g for g in groups if g["terms"] or g["without"]]


def _holds(phrase: list[str]):
    """The terms stand side by side in ``at`` (term -> places)."""
    places = lambda t: F.coalesce(F.element_at("at", F.lit(t)), F.array().cast("array<int>"))
    follows = [lambda p, i=i, t=t: F.array_contains(places(t), p + i) for i, t in enumerate(phrase)]
    both = lambda p: reduce(lambda x, y: x & y, [f(p) for f in follows])
    return F.exists(places(phrase[0]), both)


def search(papers, conns, query, mode="and", limit: int | None = 20) -> DataFrame:
    """Papers by the query words, ranked by tf-idf, then by degree.

    ``and``: all words; ``web``: see ``parse_query``; ``prefix_or``: any word that starts with a query word. Only query
    terms are kept from the token stream, before any shuffle; degrees are counted for the papers found.
    """
    groups = parse_query(query, mode)
    want = sorted({t for g in groups for t in g["terms"]})
    avoid = sorted({t for g in groups for x in g["without"] for t in x})
    words = papers.select("paper_id", F.posexplode(tokens(F.concat_ws(" ", "title", "abstract"))).alias("place", "word"))
    if mode == "prefix_or":
        words = words.withColumn("term", F.explode(F.filter(F.lit(want), lambda t: F.col("word").startswith(t))))
    else:
        words = words.filter(F.col("word").isin(*want, *avoid)).withColumn("term", F.col("word"))
    hits = words.groupBy("paper_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.collect_list("place").alias("places"))
    total = papers.count()
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    wanted = F.col("term").isin(*want)
    ranked = hits.join(df, "term").groupBy("paper_id").agg(
        F.count_if(wanted).alias("terms"),
        F.coalesce(F.round(F.sum(F.when(wanted, F.col("tf") * F.log(1.0 + F.lit(float(total)) / F.col("df")))), 6), F.lit(0.0)).alias("rank"),
        F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    if any(not g["terms"] for g in groups):  # exclusions alone also fit papers without any of the words
        ranked = papers.select("paper_id").join(ranked, "paper_id", "left").withColumns({
            "terms": F.coalesce("terms", F.lit(0)), "rank": F.coalesce("rank", F.lit(0.0)),
            "at": F.coalesce("at", F.create_map().cast("map<string,array<int>>"))})
    if mode != "prefix_or":
        fits = [reduce(lambda x, y: x & y, [
            *[F.map_contains_key("at", t) for t in g["terms"]], *[_holds(p) for p in g["phrases"]],
            *[~_holds(p) for p in g["without"]]]) for g in groups]
        ranked = ranked.filter(reduce(lambda x, y: x | y, fits, F.lit(False)))
    found = ranked.select("paper_id", "terms", "rank")
    ends = half_edges(conns).select(F.col("me").alias("paper_id"), "connection_id").join(found.select("paper_id"), "paper_id", "left_semi")
    counted = ends.groupBy("paper_id").agg(F.count_distinct("connection_id").alias("connection_count"))
    return cap(
        found.join(counted, "paper_id", "left").withColumn("connection_count", F.coalesce("connection_count", F.lit(0))),
        [F.desc("rank"), F.desc("connection_count"), F.asc("paper_id")], limit)


def search_substring(papers, query: str, limit: int | None = 20) -> DataFrame:
    """Papers whose title or abstract holds the query as it stands, newest first; for queries without a word."""
    hit = any_of([contains_ci(F.col("title"), query), contains_ci(F.col("abstract"), query)])
    return cap(papers.filter(hit), [F.desc_nulls_last("published_date"), F.asc("paper_id")], limit)


def related_by_terms(paper_id, papers, extractions, pe: DataFrame, limit: int | None = 15) -> DataFrame:
    """Papers whose text has any entity name or claim term of a paper, by shared entities, then by terms held.

    All names and all subjects and objects of the paper's claims search (those of over four characters), and all papers
    found are ranked before the cut. ``extractions`` may be None: no claim terms then. The paper's own terms reach the
    other papers as one array; a term may stand anywhere in a text, so no key could join them.
    """
    own = pe.filter((F.col("paper_id") == paper_id) & (F.length("entity") > 4)).select("entity").distinct()
    terms = own.select(F.lower("entity").alias("term"))
    if extractions is not None:
        claims = extractions.filter(F.col("paper_id") == paper_id).select(F.explode("claims").alias("c"))
        named = claims.select(F.explode(F.array("c.subject", "c.object")).alias("term")).filter(F.length("term") > 4)
        terms = terms.unionByName(named.select(F.lower("term").alias("term")))
    held = terms.agg(F.collect_set("term").alias("_terms"))  # one row
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    cand = papers.filter(F.col("paper_id") != paper_id).select("paper_id", text.alias("_text")).crossJoin(F.broadcast(held)).select(
        "paper_id", F.size(F.filter("_terms", lambda n: F.col("_text").contains(n))).alias("rank")).filter(F.col("rank") > 0)
    shared = pe.join(own, "entity", "left_semi").groupBy("paper_id").agg(F.count_distinct("entity").alias("overlap"))
    return cap(cand.join(shared, "paper_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))),
               [F.desc("overlap"), F.desc("rank"), F.asc("paper_id")], limit)


# --- concepts ----------------------------------------------------------------------------------

def papers_with_both(pe: DataFrame, a: str, b: str) -> DataFrame:
    """Papers with an entity naming ``a`` and one naming ``b``; one pass over the pairs."""
    has = lambda c: F.max(contains_ci(F.col("entity"), c))
    return (
        pe.filter(any_of([contains_ci(F.col("entity"), a), contains_ci(F.col("entity"), b)]))
        .groupBy("paper_id").agg(has(a).alias("a"), has(b).alias("b"))
        .filter(F.col("a") & F.col("b")).select("paper_id")
    )


def concept_bridge(pe, mechs, conns, papers, a: str, b: str, n: int = 10) -> dict[str, DataFrame]:
    """What links two concepts: entities, papers, mechanisms and connections, with counts."""
    ents = pe.select("entity", "entity_type").distinct()
    match = lambda c: cap(ents.filter(contains_ci(F.col("entity"), c)), [F.asc("entity"), F.asc("entity_type")], 5)
    both = papers_with_both(pe, a, b)
    bridge = cap(papers.join(both, "paper_id", "left_semi").select("paper_id", "title", "journal", "doi"),
                 [F.asc("paper_id")], n)
    desc = F.col("description")
    found = cap(mechs.filter(contains_ci(desc, a) & contains_ci(desc, b)), [F.asc("description"), F.asc("paper_id")], n // 2)
    links = conns
    for side in ("paper_a_id", "paper_b_id"):
        links = links.join(both.withColumnRenamed("paper_id", side), side, "left_semi")
    links = cap(links, [F.desc("confidence"), F.asc("connection_id")], n // 2)
    counts = [(df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(k)))
              for k, df in (("bridge_papers", bridge), ("mechanisms", found), ("connections", links))]
    summary = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return {"entities_a": match(a), "entities_b": match(b), "bridge_papers": bridge, "mechanisms": found,
            "connections": links, "summary": summary}


def concept_neighbors(pe, claims, c: str, n: int = 10):
    """(matching entities with paper counts, matching claims)."""
    ents = pe.filter(contains_ci(F.col("entity"), c)).groupBy("entity", "entity_type").agg(
        F.count_distinct("paper_id").alias("paper_count"))
    hits = contains_any(claims, ["claim_text", "subject", "object"], c)
    return (cap(ents, [F.desc("paper_count"), F.asc("entity"), F.asc("entity_type")], n),
            cap(hits, [F.asc("claim_id")], n))


def concept_pathway(mechs, c: str, n: int = 10) -> DataFrame:
    """Mechanisms that name a concept in any field."""
    hits = contains_any(mechs, ["description", "upstream_entity", "downstream_entity", "pathway"], c)
    return cap(hits, [F.asc("description"), F.asc("paper_id")], n)


def bridge_fallback(papers, kb, a: str, b: str, n: int = 10):
    """(papers, entries) whose title or text has both concepts."""
    def both(df, cols):
        return contains_any(contains_any(df, cols, a), cols, b)

    return (cap(both(papers, ["title", "abstract"]), [F.desc_nulls_last("published_date"), F.asc("paper_id")], n),
            cap(both(kb, ["title", "content"]), [F.asc("entry_id")], n))


def bridge_report(nodes, edges, papers, similar: DataFrame | None, a: str, b: str, max_hops=4) -> dict[str, DataFrame]:
    """Paths between two concepts, papers on either, and papers similar to the first."""
    on = lambda c: cap(contains_any(papers, ["title", "abstract"], c).select("paper_id", "title"), [F.asc("paper_id")], 10)
    return {"paths": shortest_paths(nodes, edges, a, b, max_hops), "papers_a": on(a), "papers_b": on(b),
            **({"similar": similar} if similar is not None else {})}


def paper_context(papers, extractions, conns, critiques, paper_id=None, k=20) -> DataFrame:
    """A paper with its extraction, best ``k`` connections and latest usable critique, nested."""
    live = conns.filter(F.col("connection_type") != "replicates")
    if paper_id is not None:
        papers = papers.filter(F.col("paper_id") == paper_id)
        extractions = extractions.filter(F.col("paper_id") == paper_id)
        critiques = critiques.filter(F.col("paper_id") == paper_id)
        live = live.filter((F.col("paper_a_id") == paper_id) | (F.col("paper_b_id") == paper_id))
    ends = half_edges(live) if paper_id is None else half_edges(live).filter(F.col("me") == paper_id)
    best = top_per(ends, "me", [F.desc("confidence"), F.asc("connection_id")], k)
    links = best.groupBy(F.col("me").alias("paper_id")).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("confidence")).alias("neg_confidence"), "connection_id", "other", "connection_type"))).alias("connections"))
    ext = latest_extraction(extractions).select(
        "paper_id", F.struct("study_design", "entities", "claims", "mechanisms", "key_findings").alias("extraction"))
    crit = latest_critique(critiques.filter(not_insufficient())).select(
        "paper_id", F.struct("overall_quality", "methodology_score").alias("critique"))
    return papers.join(ext, "paper_id", "left").join(links, "paper_id", "left").join(crit, "paper_id", "left")
