"""Worked examples and edge cases on small hand-made rows."""

from __future__ import annotations

import gzip
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litgraph.functions import text as X, vocab as V
from litgraph.operators import briefs, entities as E, joins, outreach, pairs, paths, search, sinks
from litgraph.plans import catalog
from litgraph.sources import articles, metadata, model_output

ENTITIES = "entity_id string, canonical_name string, aliases array<string>, primary_operation string"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).head()[0]


def test_norm_key_keeps_greek_and_hyphen(spark):
    assert one(spark, "  TNF-α (human) ", X.norm_key) == "tnf-α human"
    assert one(spark, None, X.norm_key) == ""


def test_canonical_form_and_extras(spark):
    s = "short-chain fatty acids (SCFAs)"
    assert one(spark, s, X.canonical_form) == "short-chain fatty acids"
    assert one(spark, s, X.paren_extras) == ["SCFAs"]
    assert one(spark, "x ( item 0 )", X.paren_extras) == ["item 0"]


def test_vocabulary(spark):
    assert one(spark, "Up-Regulates ", V.norm_predicate) == "up_regulates"
    assert one(spark, "phosphorylates", V.predicate_type) == "activates"
    assert one(spark, "unheard_of", V.predicate_type) == "correlates_with"
    assert one(spark, "separate samples", V.context_type) == "organism"  # "rat" as plain substring
    assert one(spark, "N/A", V.context_type) is None
    assert one(spark, "1,204 patients", V.sample_size) == 1204
    assert one(spark, "Meta-Analysis", V.study_design) == "meta_analysis"


def test_dates_and_fences(spark):
    assert str(one(spark, "2019", X.flexible_date)) == "2019-01-01"
    assert one(spark, "2019-02-31", X.flexible_date) is None
    assert one(spark, "```json\n{\"a\": 1}\n```", X.strip_fences) == '{"a": 1}'
    assert one(spark, 'x {"a": {"b": 1}} y}', X.balanced_object) == '{"a": {"b": 1}}'


def _mentions(spark):
    ents = spark.createDataFrame([
        ("1", "CCM1", ["KRIT1"], "Defense"), ("2", "Oxidative stress", [], "Defense"),
        ("3", "Inflammation", ["inflammatory response"], "Defense"), ("4", "IL-6", [], None), ("5", "stress", [], None),
    ], ENTITIES)
    triples = spark.createDataFrame([
        ("t1", "p1", "CCM1", "Oxidative stress and inflammatory response"), ("t2", "p1", "mIL-6x", "IL-6 expression; il-6"),
    ], "triple_id string, paper_id string, subject string, object string")
    return ents, triples


def test_mentions_longest_whole_words(spark):
    ents, triples = _mentions(spark)
    got = {(r.triple_id, r.entity_id, r.role, r.match_text, r.match_source) for r in E.expand_mentions(triples, ents).collect()}
    assert got == {
        ("t1", "1", "subject", "CCM1", "canonical_exact"), ("t1", "2", "object", "Oxidative stress", "canonical_substring"),
        ("t1", "3", "object", "inflammatory response", "alias_substring"),
        ("t2", "4", "object", "IL-6", "canonical_substring"), ("t2", "4", "object", "il-6", "canonical_substring"),
    }


def test_prose_object_makes_two_edges(spark):
    ents, triples = _mentions(spark)
    rows = triples.withColumns({"predicate_type": F.lit("induces"), "direction": F.lit("causal"),
                                "primary_operation": F.lit("Defense"), "confidence": F.lit(0.5)})
    edges = E.literature_edges(rows, E.expand_mentions(triples, ents), ents)
    assert {(r.source_entity_name, r.target_entity_name) for r in edges.collect()} == {
        ("CCM1", "Oxidative stress"), ("CCM1", "Inflammation")}


def test_resolution_prefers_names_over_aliases(spark):
    ents = spark.createDataFrame([("9", "p53", [], None), ("1", "TP53", ["P53"], None)], ENTITIES)
    t = spark.createDataFrame([("p53.", "nothing")], "subject string, object string")
    row = E.resolve_entities(t, ents).head()
    assert (row.subject_normalized_id, row.object_normalized_id) == ("9", None)


EDGE = ("source_entity_name string, target_entity_name string, predicate_type string, source_operation string, "
        "target_operation string, edge_source string, support_count long, mean_confidence double, contradiction_load long")


def _edges(spark, pairs_):
    return spark.createDataFrame([(a, b, "activates", "Defense", "Synthesis", "literature", 1, 0.5, 0) for a, b in pairs_], EDGE)


def test_chain_is_found_and_cycles_are_not(spark):
    names = ["cortisol", "pregnenolone", "DHEA", "T cells", "longevity"]
    e = _edges(spark, [*zip(names, names[1:]), ("DHEA", "Cortisol"), ("DHEA", "DHEA")])
    seed = lambda n: spark.createDataFrame([(n,)], "resolved_name string")
    got = paths.enumerate_paths(e, seed("Cortisol"), seed("Longevity"), 5).collect()
    assert [r.path_names for r in got] == [names]
    all_ = paths.enumerate_paths(e, seed("cortisol"), max_hops=5, path_limit=None).collect()
    assert sorted(r.hops for r in all_) == [1, 2, 3, 4]
    assert all(len(set(r.path_keys)) == len(r.path_keys) for r in all_)


def test_paths_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    links = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 12, (40, 2)) if a != b})
    want, level = set(), [(a, b) for a, b in links if a in ("n1", "n2")]
    for _ in range(4):
        want |= set(level)
        level = [(*p, b) for p in level for a, b in links if a == p[-1] and b not in p]
    seeds = spark.createDataFrame([("n1",), ("n2",)], "resolved_name string")
    got = paths.enumerate_paths(_edges(spark, links), seeds, max_hops=4, path_limit=None)
    assert {tuple(r.path_names) for r in got.collect()} == want
    goals = spark.createDataFrame([("n5",), ("n7",)], "resolved_name string")
    hit = paths.enumerate_paths(_edges(spark, links), seeds, goals, max_hops=4, path_limit=None)
    assert {tuple(r.path_names) for r in hit.collect()} == {p for p in want if p[-1] in ("n5", "n7")}
    few = paths.enumerate_paths(_edges(spark, links), seeds, max_hops=4, path_limit=7).collect()
    assert [r.hops for r in few] == sorted(len(p) - 1 for p in want)[:7]


def test_novelty_values(spark):
    row = ("a|b", 1, 0, 0, ["a", "b"], ["activates"], ["D", "S"], ["literature"], [3], [0.5])
    df = spark.createDataFrame([(*row, 0), (*row, 100)], "path_key string, hops int, contra_load long, op_boundary_crossings int, "
                               "path_names array<string>, preds array<string>, ops array<string>, edge_sources array<string>, "
                               "supports array<long>, confs array<double>, co_mentions long")
    assert [r.novelty for r in paths.path_scores(df).orderBy("co_mentions").collect()] == [0.8808, 0.0682]


def test_co_mentions_need_two_triples(spark):
    t = spark.createDataFrame([("p1", "t1", "A", "B"), ("p2", "t2", "a", "x"), ("p2", "t3", "y", "b"), ("p3", "t4", "A", "B"), ("p3", "t5", "b", "z")],
                              "paper_id string, triple_id string, subject string, object string")
    ends = spark.createDataFrame([("A", "B")], "endpoint_a string, endpoint_b string")
    assert paths.co_mentions(t, ends).head().co_mentions == 2


def _pe(spark, n=60):
    rng = np.random.default_rng(5)
    rows = {(int(p), f"e{min(int(k), 19)}") for p in range(n) for k in rng.geometric(0.15, 6)}
    rows |= {(p, "hot") for p in range(n)}
    return rows, spark.createDataFrame(sorted(rows), "paper_id long, entity string")


def _brute(rows, least):
    sets = {}
    for p, e in rows:
        sets.setdefault(p, set()).add(e)
    found = [(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2)]
    return sorted((x for x in found if x[2] >= least), key=lambda x: (-x[2], x[0], x[1]))


def test_shared_pairs_split_and_rare_keys_equal_brute_force(spark):
    rows, df = _pe(spark)
    counted = pairs.shared_counts(df, "entity", "paper_id", 2, block=7)
    assert sorted(tuple(r) for r in counted.collect()) == sorted(_brute(rows, 2))
    for least, limit in ((1, 50), (2, 50), (3, 10_000)):
        top = pairs.top_shared(df, "entity", "paper_id", least, limit, block=7).collect()
        assert [(r.a, r.b, r.shared_count) for r in sorted(top, key=lambda r: (-r.shared_count, r.a, r.b))] == _brute(rows, least)[:limit]


def test_claim_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    kinds = ["causal", "null", "associative", "descriptive"]
    rows = [(int(p), kinds[k]) for p, k in zip(rng.integers(0, 25, 120), rng.integers(0, 4, 120))]
    n = {}
    for p, k in rows:
        if k != "descriptive":
            n.setdefault(p, {}).setdefault(k, 0)
            n[p][k] += 1
    want = []
    for a, b in itertools.combinations(sorted(n), 2):
        total = sum(n[a][k] + n[b][k] for k in n[a] if k in n[b])
        if total:
            want.append((a, b, total))
    want = sorted(want, key=lambda x: (-x[2], x[0], x[1]))
    df = spark.createDataFrame(rows, "paper_id long, claim_type string")
    for limit in (5, 40, 10_000):
        got = pairs.convergent_claim_pairs(df, limit).collect()
        assert sorted(((r.paper_a_id, r.paper_b_id, r.shared_count) for r in got), key=lambda x: (-x[2], x[0], x[1])) == want[:limit]


def test_mechanism_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(p), f"U{u}" if u else None, f"d{d}", f"v{v}") for p, u, d, v in rng.integers(0, 5, (40, 4))]
    df = spark.createDataFrame(rows, "paper_id long, upstream_entity string, downstream_entity string, interaction_type string")
    for verbs in (False, True):
        n = {}
        for x, y in itertools.product(rows, rows):
            if x[0] < y[0] and ((x[1] and x[1] == y[1]) or x[2] == y[2] or (verbs and x[3] == y[3])):
                n[x[0], y[0]] = n.get((x[0], y[0]), 0) + 1
        for limit in (3, 100):
            got = pairs.shared_mechanism_pairs(df, limit, verbs, block=4).collect()
            want = sorted(((a, b, c) for (a, b), c in n.items()), key=lambda x: (-x[2], x[0], x[1]))[:limit]
            assert sorted(((r.paper_a_id, r.paper_b_id, r.shared_count) for r in got), key=lambda x: (-x[2], x[0], x[1])) == want


def test_vector_pairs_equal_brute_force_with_copies(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(80, 6))
    v[50:] = v[0]  # a group of copies
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    u = v.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {(i, j) for i, j in itertools.combinations(range(80), 2) if u[i] @ u[j] >= 0.6}
    got = pairs.similar_pairs(df, 0.6, 10_000, pivots=5, block=9).collect()
    assert len(got) == len(want) and {(r.paper_a_id, r.paper_b_id) for r in got} == want
    assert all(abs(r.similarity - u[r.paper_a_id] @ u[r.paper_b_id]) < 1e-9 for r in got)
    assert pairs.similar_pairs(df, 0.6, 20, pivots=5, block=9).count() == 20


def test_close_pairs_have_no_limit(spark, tmp_path):
    n = 1500  # 1,124,250 pairs
    rows = spark.range(n).selectExpr("id as vec_id", "array(1f, cast(id % 7 as float) / 20, cast(id % 5 as float) / 20) as embedding")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.queries()["J08_close_pairs"](spark, str(tmp_path))
    assert got.count() == got.distinct().count() == n * (n - 1) // 2


def test_related_papers_use_all_terms_and_rank_before_the_cut(spark):
    names = [f"name{i:02d}" for i in range(20)]
    many = " ".join(names[:15])
    papers = spark.createDataFrame(
        [(1, "own", many), *[(i, many, None) for i in range(10, 14)], (20, "late", "has NAME19 alone"), (21, "claims", "of kinase-x"), (22, "nothing", None),
         (23, "one name00", "")], "paper_id long, title string, abstract string")
    pe = spark.createDataFrame([(1, n) for n in names] + [(20, "name19")] + [(23, n) for n in names[:9]], "paper_id long, entity string")
    claim = "array<struct<subject: string, object: string>>"
    ext = spark.createDataFrame([(1, [("Kinase-X", None), ("name00", "of")]), (22, [("nothing", "late")])], f"paper_id long, claims {claim}")
    rows = lambda *a: [(r.paper_id, r.overlap, r.rank) for r in search.related_by_terms(1, papers, *a).collect()]
    assert rows(ext, pe, 2) == [(23, 9, 1), (20, 1, 1)]
    assert rows(ext, pe) == [(23, 9, 1), (20, 1, 1), *[(i, 0, 15) for i in range(10, 14)], (21, 0, 1)]
    assert rows(None, pe.filter("paper_id <> 1")) == []


def test_shortest_paths_prefers_near_sources(spark):
    nodes = spark.createDataFrame([(c, "Entity", c) for c in ("aa1", "aa2", "m", "n", "bb1", "bb2")], "id string, label string, text string")
    edges = spark.createDataFrame([("aa1", "m"), ("m", "bb1"), ("bb2", "aa2"), ("aa2", "n"), ("n", "bb1")], "src string, dst string")
    got = [(r.source, r.target, r.hops) for r in paths.shortest_paths(nodes, edges, "AA", "bb").orderBy("hops", "source", "target").collect()]
    assert got == [("aa2", "bb2", 1), ("aa1", "bb1", 2), ("aa2", "bb1", 2)]


JATS = """<article><front><article-meta><article-id pub-id-type='doi'> 10.1/x </article-id><title-group><article-title>A <i>b</i> c</article-title></title-group>
<contrib contrib-type='author'><name><surname>Doe</surname><given-names>Jo</given-names></name></contrib><pub-date pub-type='epub'><year>2020</year><month>3</month></pub-date>
<abstract><p>One.</p><p>Two.</p></abstract></article-meta></front><body><sec><title>Introduction</title><p>In.</p><sec><title>Background</title><p>More.</p></sec></sec>
<sec><title>Results</title><p>Re.</p></sec></body></article>"""


def test_jats(spark):
    df = spark.createDataFrame([("1", bytearray(gzip.compress(JATS.encode()))), ("2", bytearray(b"<broken"))], "article_id string, body binary")
    good, bad = articles.parse_jats(df, "body").orderBy("article_id").collect()
    assert (good.title, good.abstract, good.authors, good.pub_date, good.doi) == ("A b c", "One. Two.", ["Doe, Jo"], "2020-03-01", "10.1/x")
    assert good.sections == {"introduction": "In. More.", "results": "Re."} and good.full_text == "In. More. Re."
    assert bad.title is None and bad.sections is None


def test_scrape_falls_back_to_body(spark):
    long = "word " * 30
    df = spark.createDataFrame([(f"<meta name='description' content='short'><div class=\"x abstract\"><b>{long}</b></div>",),
                                (f"<META NAME='citation_abstract' CONTENT='{long}'>",), ("<p>none</p>",)], "html string")
    assert [r.abstract for r in metadata.scrape_abstract(df).collect()] == [long.strip(), long.strip(), None]


def test_unreadable_answers_get_defaults(spark):
    df = spark.createDataFrame([("sorry",), ('{"overall_quality": "high"}',)], "response string")
    bad, good = model_output.parse_critique_json(df).collect()
    assert bad.weaknesses == ["Could not parse response"] and bad.overall_quality == "medium" and bad.summary == "sorry"
    assert good.overall_quality == "high" and good.weaknesses == [] and good.methodology_score == 5.0
    none = model_output.parse_extraction_xml(spark.createDataFrame([("no block",)], "response string")).head()
    assert none.entities == [] and none.study_design == "unknown"


def test_upserts_are_idempotent(spark):
    rows = "connection_id string, paper_a_id long, paper_b_id long, connection_type string, confidence double, created_at int"
    old = spark.createDataFrame([("x", 1, 2, "extends", 0.5, 1)], rows)
    new = spark.createDataFrame([("y", 2, 1, "extends", 0.9, 2)], rows).withColumn("row_id", F.lit("r"))
    once = sinks.upsert_connections(old, new)
    twice = sinks.upsert_connections(once, new)
    assert [tuple(r) for r in once.collect()] == [tuple(r) for r in twice.collect()]
    assert once.count() == 1 and once.head().confidence == 0.9


def test_decompose(spark):
    df = spark.createDataFrame([("Glioblastoma multiforme how does it start?",)], "question string")
    r = briefs.decompose(df).head()
    assert r.subject == "Glioblastoma multiforme" and r.seeds == ["Glioblastoma"] and r.pattern == "initiation"
    assert r.targets[0] == "Glioblastoma multiforme pathogenesis" and len(r.queries) == 7


def test_schedule_core_ring_first(spark):
    q = spark.createDataFrame([("a", 1, 9), ("b", 0, 1), ("c", 0, 5)], "query string, ring int, priority int")
    assert [(r.query, r.query_limit) for r in outreach.schedule(q, 25).orderBy("position").collect()] == [("c", 10), ("b", 10), ("a", 5)]


def test_scores_stay_in_range(spark):
    assert math.isclose(one(spark, 0.0, lambda c: 1 / (1 + F.exp(-c)), "double"), 0.5)


def test_jats_and_bioc_archives(spark):
    cut = gzip.compress(JATS.encode())[:60]
    bioc = '{"documents":[{"infons":{"doi":"10.1/b"},"passages":[{"infons":{"type":"title"},"text":"T"}]}]}'
    rows = [("1", "jats", bytearray(gzip.compress(JATS.encode()))), ("2", "jats", bytearray(cut)), ("3", "bioc", bytearray(gzip.compress(bioc.encode()))),
            ("4", "bioc", bytearray(bioc.encode())), ("5", "bioc", bytearray(gzip.compress(bioc.encode())[:40])), ("6", "bioc", bytearray(b"\xff\xfe{")), ("7", "jats", None)]
    df = spark.createDataFrame(rows, "article_id string, fmt string, body binary")
    got = {r.article_id: (r.title, r.doi) for r in articles.parse_article(df, "fmt", "body").collect()}
    assert got == {"1": ("A b c", "10.1/x"), "2": (None, None), "3": ("T", "10.1/b"), "4": ("T", "10.1/b"), "5": (None, None), "6": (None, None), "7": (None, None)}


def test_jats_parts(spark):
    xml = """<article><front><journal-id journal-id-type='nlm-ta'>J N</journal-id><article-title/><contrib contrib-type='author'><surname>Solo</surname></contrib>
    <contrib contrib-type='editor'><surname>Ed</surname></contrib><pub-date pub-type='ppub'><year>2001</year><month>3</month><day>4</day></pub-date>
    <pub-date pub-type='epub'><month>9</month></pub-date><abstract>No <b>paragraph</b></abstract></front><body><p>Only text</p></body><back><ref-list>
    <ref id='r1'><person-group person-group-type='author'><name><surname>A</surname><given-names>B</given-names></name><name><surname>C</surname></name></person-group>
    <source>Book</source><year>1999</year><pub-id pub-id-type='pmid'> 7 </pub-id></ref></ref-list></back></article>"""
    r = articles.jats_record(xml)
    assert (r["title"], r["abstract"], r["authors"], r["journal"], r["pub_date"], r["pub_year"]) == ("", "No paragraph", ["Solo"], "J N", "2001-03-04", 2001)
    assert r["full_text"] == "Only text" and r["sections"] == {} and r["reference_count"] == 1
    assert r["references"] == [{"ref_id": "r1", "title": "Book", "authors": "B A; C", "year": "1999", "doi": None, "pmid": "7"}] or \
        r["references"] == [{"ref_id": "r1", "title": "Book", "authors": "A B; C", "year": "1999", "doi": None, "pmid": "7"}]


def test_papers_without_doi_stay_apart(spark):
    rows = [("crossref", " 10.1/X", "A"), ("pubmed", "10.1/x", "B"), ("pubmed", None, "C"), ("pubmed", " ", "D"), ("html", None, None)]
    df = spark.createDataFrame(rows, "source string, doi string, title string")
    assert sorted((r.doi or "", r.title) for r in metadata.coalesce_metadata(df).collect()) == [("", "C"), ("", "D"), ("", "Unknown"), ("10.1/x", "A")]


def test_broken_answers_and_markup(spark):
    whole = "<extraction><study_design>rct</study_design><claims><claim type='causal'>IL-6 <i>raises</i> CRP</claim></claims></extraction>"
    broken = "<extraction><study_design>rct</study_design><claims><claim>x</claims></extraction>"
    df = spark.createDataFrame([(1, whole), (2, broken)], "id int, response string")
    good, bad = model_output.parse_extraction_xml(df).orderBy("id").collect()
    assert good.study_design == "rct" and [c.text for c in good.claims] == ["IL-6 raises CRP"]
    assert bad.study_design == "unknown" and bad.claims == []


def test_repeated_arriving_keys_give_one_row(spark):
    old = spark.createDataFrame([("s", "1", "p1", "t", "a", "queued", "x", None)], "source string, external_id string, paper_id string, title string, abstract string, status string, data_source string, full_text string")
    new = spark.createDataFrame([("s", "1", "q", "t", "a", ""), ("s", "1", "r", "t", "a", "text"), ("s", "2", "z", "t", "a", "b"), ("s", "2", "y", "t", "a", "c")],
                                "source string, external_id string, paper_id string, title string, abstract string, full_text string")
    assert sorted((r.external_id, r.paper_id, r.full_text) for r in sinks.merge_fulltext(old, new).collect()) == [("1", "p1", "text"), ("2", "y", "c")]
    papers = spark.createDataFrame([("p", "t", [1])], "paper_id string, title string, references_list array<int>")
    parsed = spark.createDataFrame([("p", "", [1, 2]), ("p", "new", []), ("p", None, None)], "paper_id string, title string, references_list array<int>")
    assert [tuple(r) for r in sinks.patch_parsed(papers, parsed, cap_refs=None).collect()] == [("p", "new", [1, 2])]
    ents = spark.createDataFrame([("1", "A", "gene", ["x"], "Defense")], "entity_id string, canonical_name string, entity_type string, aliases array<string>, primary_operation string")
    seeds = spark.createDataFrame([("A", "gene", ["y"], None), ("A", "gene", ["z"], None), ("B", "gene", ["b"], None), ("B", "gene", ["c"], "Defense")],
                                  "canonical_name string, entity_type string, aliases array<string>, primary_operation string")
    got = {r.canonical_name: sorted(r.aliases) for r in E.merge_aliases(ents, seeds).collect()}
    assert got == {"A": ["x", "y", "z"], "B": ["b", "c"]}


def test_convergent_claims_of_forty_types(spark):
    import random
    rnd = random.Random(3)
    counts = {}
    for p in range(60):
        for t in rnd.sample(range(40), rnd.randint(1, 6)):
            counts[p, f"t{t:02d}"] = rnd.randint(1, 4)
    rows = [(p, t) for (p, t), n in counts.items() for _ in range(n)] + [(p, "descriptive") for p in range(60)]
    df = spark.createDataFrame(rows, "paper_id long, claim_type string")
    of = {p: {t: n for (q, t), n in counts.items() if q == p} for p in range(60)}
    want = []
    for a, b in itertools.combinations(range(60), 2):
        if both := set(of[a]) & set(of[b]):
            want.append((-sum(of[a][t] + of[b][t] for t in both), a, b, min(both)))
    for limit in (5, 40, 10_000):
        got = pairs.convergent_claim_pairs(df, limit).collect()
        assert sorted((-r.shared_count, r.paper_a_id, r.paper_b_id) for r in got) == sorted(w[:3] for w in sorted(want)[:limit])


# --- streams: several micro-batches, Arrow batches of two rows ------------------------------------

def _run_stream(spark, tmp_path, batches, schema, build):
    """Rows that a stream over ``batches`` gives; each batch is a file and a micro-batch of its own."""
    src, out = str(tmp_path / "src"), []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        q = build(live).writeStream.foreachBatch(lambda df, i: out.extend(df.collect()) and None).option(
            "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    return out


def test_suppression_in_order_of_time(spark, tmp_path):
    import datetime as dt

    from litgraph.streaming import incremental as T
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[("A@x ", day(400)), ("a@x", day(0)), ("a@x", day(300)), ("a@x", day(100)), ("a@x", day(200)), ("b@x", day(0))],
               [("a@x", day(450)), ("b@x", day(405))], [("a@x", day(491)), ("c@x", day(480)), ("c@x", day(460))]]
    got = _run_stream(spark, tmp_path, batches, "email string, sent_at timestamp", lambda s: T.suppression_stream(s, 90))
    flagged = sorted((r.email, (r.sent_at - dt.datetime(2024, 1, 1)).days) for r in got if r.suppressed)
    assert len(got) == 11 and flagged == [("a@x", 450), ("c@x", 480)]
    rows = [(i, e.strip().lower(), at) for i, (e, at) in enumerate(r for b in batches for r in b)] + [(99, "a@x", day(0))]
    batch = T.suppression(spark.createDataFrame(rows, "send_id long, email string, sent_at timestamp"), 90).filter("suppressed").collect()
    assert sorted((r.email, (r.sent_at - dt.datetime(2024, 1, 1)).days, r.send_id) for r in batch)[1:] == [("a@x", 450, 6), ("c@x", 480, 9)]
    assert len(batch) == 3 and min(r.send_id for r in batch if r.sent_at == day(0)) == 99  # of equal times the first goes out


def test_settling_in_order_of_polls(spark, tmp_path):
    from litgraph.streaming import incremental as T
    polls = [("s", i, n) for i, n in enumerate((0, 50, 55, 60, 65, 200, 205, 210))]
    batches = [[polls[3], polls[0], polls[2], polls[1]], [polls[5], polls[4]], [polls[7], polls[6]]]
    got = _run_stream(spark, tmp_path, batches, "series string, poll long, n long", lambda s: T.settling_stream(s))
    want = T.settling(spark.createDataFrame(polls, "series string, poll long, n long")).select("poll", "streak").collect()
    assert sorted((r.poll, r.streak) for r in got) == sorted(map(tuple, want))


def test_watchlists_count_a_paper_once(spark, tmp_path):
    from litgraph.streaming import incremental as T
    lists = spark.createDataFrame([("w", "entity", "x"), ("w", "author", "Ann"), ("v", "entity", "y")], "watchlist_id string, watch_type string, watch_value string")
    schema = "paper_id long, title string, abstract string, entities array<string>, authors array<string>"
    batches = [[(1, "", "", ["X", "x"], ["ann"])], [(1, "", "", ["x"], []), (2, "", "", ["x", "y"], [])], [(2, "", "", ["Y"], ["ANN"])]]
    got = _run_stream(spark, tmp_path, batches, schema, lambda s: T.watchlist_matches(s, lists))
    assert sorted((r.watchlist_id, r.paper_id) for r in got) == [("v", 2), ("w", 1), ("w", 2)]


def test_dedupe_against_known_papers(spark, tmp_path):
    from litgraph.streaming import incremental as T
    known = spark.createDataFrame([("s", "9")], "source string, external_id string")
    batches = [[("s", "1", "2024-01-01 00:00:00"), ("s", "9", "2024-01-01 00:00:00")], [("s", "1", "2024-01-01 01:00:00"), ("s", "2", "2024-01-01 02:00:00")], [("s", "9", "2024-03-01 00:00:00")]]
    got = _run_stream(spark, tmp_path, batches, "source string, external_id string, ts string", lambda s: T.dedupe_stream(s, "1 day", known=known))
    assert sorted(r.external_id for r in got) == ["1", "2"]


def test_refresh_over_many_batches_and_a_retried_one(spark, tmp_path):
    import glob
    import os

    from litgraph.streaming import incremental as T
    ents = spark.createDataFrame([(str(i), f"N{i}", [], "Defense") for i in range(6)], ENTITIES)
    claim = "claim_id string, paper_id string, subject string, predicate string, object string, operations array<string>, confidence double"
    ext = ("extraction_id string, paper_id string, primary_operation string, study_design string, created_at timestamp, "
           "mechanisms array<struct<upstream_entity:string,interaction_type:string,downstream_entity:string,context:string,confidence:double>>")
    claims = [(f"c{i}", f"p{i % 7}", f"N{i % 6}", "activates", f"N{(i + 1 + i // 6) % 6}", [], 0.5) for i in range(12)]
    exts = [(f"x{i}", f"p{i % 5}", f"op{i}", "cohort", pd.Timestamp(2024, 1, 1 + i).to_pydatetime(), [(f"N{i % 6}", "inhibits", f"N{(i + 2) % 6}", None, 0.7)]) for i in range(12)]
    files = lambda b: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/edges/bucket={b}/*.parquet")}
    step = lambda b, i, o: T.refresh_batch(
        spark.createDataFrame([claims[k] for k in i], claim), spark.createDataFrame([exts[k] for k in i], ext), b, ents, o, 4)
    read = lambda o: sorted(map(str, spark.read.parquet(f"{o}/edges").drop("bucket").collect()))
    out, whole = str(tmp_path / "refresh"), str(tmp_path / "whole")
    for b in range(6):
        step(b, [2 * b, 2 * b + 1], out)
        if b == 3:
            step(b, [2 * b, 2 * b + 1], out)  # retried
    step(0, range(12), whole)
    assert read(out) == read(whole)
    before = {b: files(b) for b in range(4)}
    step(6, [11], out)  # rows that are known: nothing changes but the files of the buckets of its paper's edges
    heads = spark.read.parquet(f"{out}/heads").filter("batch = 6").select(F.explode("buckets").alias("b")).collect()
    changed = {b for b in before if files(b) != before[b]}
    assert read(out) == read(whole) and changed == {r["b"] for r in heads} and len(changed) < 4


def test_refresh_deals_a_batch_of_one_file_to_all_tasks(spark, tmp_path, monkeypatch):
    from litgraph.streaming import incremental as T
    ents = spark.createDataFrame([(str(i), f"N{i}", [], "Defense") for i in range(6)], ENTITIES)
    claims = spark.createDataFrame([(f"c{i}", f"p{i}", f"N{i % 6}", "activates", f"N{(i + 1) % 6}", [], 0.5) for i in range(400)],
                                   "claim_id string, paper_id string, subject string, predicate string, object string, operations array<string>, confidence double")
    ext = spark.createDataFrame([], "extraction_id string, paper_id string, primary_operation string, study_design string, created_at timestamp, "
                                    "mechanisms array<struct<upstream_entity:string,interaction_type:string,downstream_entity:string,context:string,confidence:double>>")
    dealt, real = {}, T._write
    monkeypatch.setattr(T, "_write", lambda df, out, name, *keys: (dealt.setdefault(name, df.rdd.glom().map(len).collect()), real(df, out, name, *keys)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        T.refresh_batch(claims.coalesce(1), ext, 0, ents, str(tmp_path / "out"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(dealt["claims"]) == 400 and sum(n > 0 for n in dealt["claims"]) > 1, dealt["claims"]  # two buckets, four partitions
    got = {(r.source_entity_name, r.target_entity_name): r.support_count for r in spark.read.parquet(str(tmp_path / "out/edges")).collect()}
    assert got == {(f"N{k}", f"N{(k + 1) % 6}"): len(range(k, 400, 6)) for k in range(6)}


def test_web_search_syntax():
    from litgraph.operators.search import parse_query
    g = lambda t, p=(), w=(): {"terms": sorted(t), "phrases": [list(x) for x in p], "without": [list(x) for x in w]}
    assert parse_query("alpha beta or gamma") == [g(["alpha", "beta"]), g(["gamma"])]
    assert parse_query('"beta alpha" -gamma') == [g(["alpha", "beta"], [["beta", "alpha"]], [["gamma"]])]
    assert parse_query('IL-6 or -"a b"') == [g(["il", "6"], [["il", "6"]]), g([], [], [["a", "b"]])]
    assert parse_query("a or B", "and") == [g(["a", "b", "or"])]


def test_graph_tells_claims_with_colliding_short_ids_apart(spark):
    from litgraph.functions.scores import short_id

    names = ["claim 18196154", "claim 26306642"]
    kind = "array<struct<text:string,claim_type:string>>"
    made = spark.createDataFrame([(n,) for n in names], "t string").select(short_id(F.concat(F.lit("1:claim:0:"), "t")).alias("id"))
    assert made.distinct().count() == 1
    papers = spark.createDataFrame([(1, "T", None, [])], "paper_id long, title string, abstract string, authors array<string>")
    ext = spark.createDataFrame([(1, n, [], [(n, "causal")], [], []) for n in names],
                                "paper_id long, extraction_id string, entities array<struct<text:string,entity_type:string>>, "
                                f"claims {kind}, mechanisms array<struct<description:string,interaction_type:string>>, "
                                "methods array<struct<name:string,category:string>>")
    nodes, edges = E.build_graph(papers, ext)
    assert nodes.filter("label = 'Claim'").count() == 2 and edges.filter("type = 'MAKES_CLAIM'").count() == 2


def test_graph_holds_every_author_claim_mechanism_and_method(spark):
    names = [f"n{i}" for i in range(45)]
    papers = spark.createDataFrame([(1, "T", None, names)], "paper_id long, title string, abstract string, authors array<string>")
    ext = spark.createDataFrame([(1, "x", [(n, "gene") for n in names], [(n, "causal") for n in names], [(n, "binds") for n in names], [(n, "assay") for n in names])],
                                "paper_id long, extraction_id string, entities array<struct<text:string,entity_type:string>>, "
                                "claims array<struct<text:string,claim_type:string>>, mechanisms array<struct<description:string,interaction_type:string>>, "
                                "methods array<struct<name:string,category:string>>")
    nodes, edges = E.build_graph(papers, ext)
    of = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
    assert of(nodes, "label") == {"Paper": 1} | dict.fromkeys(("Researcher", "Entity", "Claim", "Mechanism", "Method"), 45)
    assert of(edges, "type") == dict.fromkeys(("AUTHORED_BY", "HAS_ENTITY", "MAKES_CLAIM", "DESCRIBES_MECHANISM", "USES_METHOD"), 45)


def test_citations_by_titles_that_go_on_for_a_few_characters(spark):
    ref = "array<struct<title:string,doi:string>>"
    papers = spark.createDataFrame(
        [(1, "-", None, [("PAPER 1", None)]), (2, "Paper 1", None, []), (3, "Paper 12345", None, []), (4, "Paper 123456", None, []),
         (5, "x" * 80, None, []), (6, "-", None, [("x" * 80, None)])], f"paper_id long, title string, doi string, references_list {ref}")
    found = lambda *rest: {tuple(r) for r in joins.citations(papers, *rest).collect()}
    assert found(4) == {(1, 2), (1, 3), (6, 5)}
    assert found() == {(1, 2), (1, 3), (1, 4), (6, 5)}


def test_frame_endpoints_by_grouping(spark):
    frames = spark.createDataFrame([("f", ["B", "a", "b", None, "A"], ["{condition} x", "GOUT X", "y"]), ("g", [], ["Y"])],
                                   "frame_id string, default_seeds array<string>, target_templates array<string>")
    seeds, targets = briefs.frame_endpoints(frames, "gout")
    assert {tuple(r) for r in seeds.collect()} == {("f", "B"), ("f", "a")}
    assert {tuple(r) for r in targets.collect()} == {("f", "gout x"), ("f", "y"), ("g", "Y")}
    for df in (seeds, targets):  # no comparison of all names with all others
        assert "array_position" not in df._jdf.queryExecution().optimizedPlan().toString()
