"""Steps whose rows between stages must stay in proportion to their input; results against brute force."""

from __future__ import annotations

import os
import random
from collections import Counter
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from litgraph.operators import entities, mentions, pairs, paths


def shuffled(spark, run):
    """What ``run`` returns, and the rows that its stages wrote for shuffles, as of tables too large to broadcast."""
    def written():
        lists, jvm = spark._jvm.java.util.ArrayList, spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, jvm.new_array(jvm.jvm.double, 0), lists())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        out = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, written() - before


def test_co_mentions_stay_within_papers(spark):
    # Every name has each of 40 names as partner and is in 40 of 400 papers: along the pairs that is 64,000 meetings.
    rows = [(p, f"t{p}-{i}", f"n{(p * 4 + 2 * i) % 40}", f"N{(p * 4 + 2 * i + 1 + p % 3) % 40}") for p in range(400) for i in range(2)]
    rows += [(0, f"big{i}", f"x{i}", f"n{i % 40}") for i in range(200)]  # a paper with more names than partners
    ends = list(product([f"n{i}" for i in range(40)], repeat=2)) + [("x1", "X2"), ("x1", "none"), (None, "n1")]
    triples = spark.createDataFrame(rows, "paper_id long, triple_id string, subject string, object string")
    pairs = spark.createDataFrame(ends, "endpoint_a string, endpoint_b string")
    got, n = shuffled(spark, lambda: paths.co_mentions(triples, pairs).collect())
    touch = {}
    for p, t, s, o in rows:
        for name in {s.lower(), o.lower()}:
            touch.setdefault((p, name), set()).add(t)
    want = Counter()
    for a, b in {(a and a.lower(), b.lower()) for a, b in ends}:
        want[a, b] = sum(any(x != y for x in touch.get((p, a), ()) for y in touch.get((p, b), ())) for p in range(400))
    assert {(r.endpoint_a, r.endpoint_b): r.co_mentions for r in got} == dict(want)
    assert n < 30_000, n


def most_shared(rows, least, limit):
    keys = {}
    for p, k in rows:
        keys.setdefault(p, set()).add(k)
    found = ((len(keys[a] & keys[b]), a, b) for a, b in combinations(sorted(keys), 2))
    return sorted((x for x in found if x[0] >= least), key=lambda x: (-x[0], *x[1:]))[:limit]


def test_pairs_meet_on_two_keys_at_once(spark):
    # Each of 40 keys has 100 papers: 100,000 pairs share the rarer key of one of them, some thousands share two.
    deal = random.Random(3)
    rows = [(p, f"k{k}") for p in range(2000) for k in deal.sample(range(40), 2)]
    df = spark.createDataFrame(rows, "paper_id long, entity string")
    got, n = shuffled(spark, lambda: pairs.top_shared(df, "entity", "paper_id", 2, 100_000).collect())
    assert sorted(((r.shared_count, r.a, r.b) for r in got), key=lambda x: (-x[0], *x[1:])) == most_shared(rows, 2, 100_000)
    assert n < 80_000, n


@pytest.mark.parametrize("least, limit", [(2, 5), (2, 100000), (3, 60), (1, 100000)])
def test_ids_with_many_keys_meet_those_with_few(spark, monkeypatch, least, limit):
    monkeypatch.setattr(pairs, "FEW", 3)
    deal = random.Random(least + limit)
    rows = sorted({(p, f"k{int(deal.random() ** 2 * 12)}") for p in range(40) for _ in range(1 + p % 7)})
    df = spark.createDataFrame(rows, "paper_id long, entity string")
    got = pairs.top_shared(df, "entity", "paper_id", least, limit, block=7).collect()
    assert sorted(((r.shared_count, r.a, r.b) for r in got), key=lambda x: (-x[0], *x[1:])) == most_shared(rows, least, limit)


def test_cut_lineage_is_compressed_and_equal_hashes_are_told_apart(spark, monkeypatch):
    from litgraph.runtime import cut_lineage

    kept = cut_lineage(spark.range(1000).selectExpr("id", "repeat('word ', 50) as t"))
    files = [f.removeprefix("file://").removeprefix("file:") for f in kept.inputFiles()]
    assert kept.count() == 1000 and sum(map(os.path.getsize, files)) < 50_000  # 250,000 characters
    assert cut_lineage(spark.range(3).selectExpr("id", "null as n")).count() == 3
    # All keys of a length have one hash: pairs meet too often, and are counted over the keys themselves.
    monkeypatch.setattr(pairs.F, "xxhash64", lambda c: F.length(c).cast("long"))
    deal = random.Random(6)
    rows = sorted({(p, "k" * deal.randrange(1, 4) + str(deal.randrange(4))) for p in range(30) for _ in range(4)})
    got = pairs.top_shared(spark.createDataFrame(rows, "paper_id long, entity string"), "entity", "paper_id", 2, 50, block=10_000).collect()
    assert sorted(((r.shared_count, r.a, r.b) for r in got), key=lambda x: (-x[0], *x[1:])) == most_shared(rows, 2, 50)


def test_claim_pairs_leave_small_papers_aside(spark, monkeypatch):
    # 3,000 papers with a claim or two of each of four types; 30 papers with up to nine more. Ids are dealt out of order.
    deal = random.Random(5)
    rows = [(p * 7919 % 3001, t) for p in range(3000) for t in "abcd" for _ in range(1 + (p % 40 == 0) + (p % 100 == 0) * deal.randrange(9))]
    claims = spark.createDataFrame(rows, "paper_id long, claim_type string")
    kept, real = [], pairs.cut_lineage
    monkeypatch.setattr(pairs, "cut_lineage", lambda df: (kept.append(df.count()) if "counts" in df.columns else None) or real(df))
    got = pairs.convergent_claim_pairs(claims, 40).collect()
    size = Counter(p for p, _ in rows)
    want = sorted(((size[a] + size[b], a, b) for a, b in combinations(sorted(size, key=lambda p: (-size[p], p))[:200], 2)))
    want = sorted(((x, min(a, b), max(a, b)) for x, a, b in want), key=lambda x: (-x[0], *x[1:]))[:40]
    assert sorted(((r.shared_count, r.paper_a_id, r.paper_b_id) for r in got), key=lambda x: (-x[0], *x[1:])) == want
    assert kept[0] == 3000 and kept[-1] < 100, kept  # only papers that can matter are ranked for every set of types


def test_mechanisms_meet_without_shuffling_single_matches(spark):
    # Each of 80 ends has some 50 papers: 98,000 pairs agree in one end. Some papers repeat an end, some have none.
    deal = random.Random(8)
    rows = [(p, f"u{deal.randrange(40)}", f"d{deal.randrange(40)}", "v") for p in range(1000) for _ in range(2)]
    rows += [(p, None, f"d{p}", None) for p in range(5)] + [(9, "u1", "d1", "v"), (9, "u1", "d2", "v"), (2000, None, None, None)]
    mechs = spark.createDataFrame(rows, "paper_id long, upstream_entity string, downstream_entity string, interaction_type string")
    got, n = shuffled(spark, lambda: pairs.shared_mechanism_pairs(mechs, 200, False, block=40).collect())
    want = Counter()
    for x, y in product(rows, rows):
        if x[0] < y[0] and ((x[1] and x[1] == y[1]) or (x[2] and x[2] == y[2])):
            want[x[0], y[0]] += 1
    want = sorted(((c, a, b) for (a, b), c in want.items()), key=lambda x: (-x[0], *x[1:]))[:200]
    assert sorted(((r.shared_count, r.paper_a_id, r.paper_b_id) for r in got), key=lambda x: (-x[0], *x[1:])) == want
    assert n < 90_000, n


def mechanism_pairs(rows, limit):
    agree = lambda x, y: any(u and u == v for u, v in zip(x[1:], y[1:]))
    papers = {}
    for r in rows:
        papers.setdefault(r[0], []).append(r)
    found = ((sum(agree(x, y) for x in papers[a] for y in papers[b]), a, b) for a, b in combinations(sorted(papers), 2))
    return sorted((x for x in found if x[0]), key=lambda x: (-x[0], *x[1:]))[:limit]


@pytest.mark.parametrize("verbs, limit", [(3, 200), (500, 60), (0, 40), (5, 7), (2, 10_000)])
def test_mechanisms_meet_by_ends_or_interaction(spark, verbs, limit):
    # With few verbs nearly every two papers share one: 400 papers of up to seven mechanisms, some ends repeated in a paper.
    deal = random.Random(verbs)
    rows = [(p, f"u{deal.randrange(60)}", f"d{deal.randrange(60)}", f"v{deal.randrange(verbs)}" if verbs else None)
            for p in range(400 if limit < 1000 else 60) for _ in range(1 + p % 7)]
    rows += [(p, "u1", "d1", None) for p in (3, 3, 3, 5, 5, 5)] + [(900, None, None, "v1"), (901, None, None, None)]
    mechs = spark.createDataFrame(rows, "paper_id long, upstream_entity string, downstream_entity string, interaction_type string")
    got, n = shuffled(spark, lambda: pairs.shared_mechanism_pairs(mechs, limit, block=40).collect())
    assert sorted(((r.shared_count, r.paper_a_id, r.paper_b_id) for r in got), key=lambda x: (-x[0], *x[1:])) == mechanism_pairs(rows, limit)
    if verbs == 3:
        assert n < 100_000, n


def test_facts_are_dealt_by_edge_once(spark):
    deal = random.Random(4)
    rows = [(f"t{i}", deal.randrange(300), deal.choice(["blocks", "activates"]), deal.choice(["contradicts", None]), deal.choice(["x", "y", None]), i % 10 / 10)
            for i in range(3000)] + [("t-", None, "blocks", None, None, None)]
    said = [(r[0], deal.choice("abc"), role) for r in rows for role in ("subject", "object", "object")]
    triples = spark.createDataFrame(rows, "triple_id string, paper_id long, predicate_type string, direction string, primary_operation string, confidence double")
    mentions = spark.createDataFrame(said, "triple_id string, entity_id string, role string")
    ents = spark.createDataFrame([(e, e.upper(), [], None) for e in "abc"], "entity_id string, canonical_name string, aliases array<string>, primary_operation string")
    got, n = shuffled(spark, lambda: entities.literature_edges(triples, mentions, ents).collect())
    ends = {}
    for t, e, role in said:
        ends.setdefault((t, role), set()).add(e)
    want = {}
    for t, p, kind, way, op, c in rows:
        for s, o in product(ends[t, "subject"], ends[t, "object"]):
            if s != o:
                want.setdefault((s.upper(), o.upper(), kind), []).append((p, kind == "blocks" or way == "contradicts", c))
    papers = lambda xs: len({p for p, *_ in xs} - {None})
    assert {(r.source_entity_name, r.target_entity_name, r.predicate_type): (r.support_count, r.contradiction_load, r.max_confidence) for r in got} == {
        k: (papers(v), papers([x for x in v if x[1]]), max((x[2] for x in v if x[2] is not None), default=None)) for k, v in want.items()}
    facts = sum(map(len, want.values()))
    assert n < len(said) + len(rows) + 3 * facts + 500, (n, facts)  # mentions, triples and, past two joins with entities, facts; each once


def test_large_dictionaries_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(mentions, "PART_BYTES", 200)
    monkeypatch.setattr(mentions, "trie_of", lambda terms: pytest.fail("a part of the dictionary on the driver"))
    words = spark.createDataFrame([(f"red fox{i}" if i else "red fox", f"e{i}", "canonical") for i in range(100)] + [("fox", "f", "alias")],
                                  "term string, entity_id string, source string")
    texts = spark.createDataFrame([(1, "A Red fox, red fox7; fox"), (1, "a fox8"), (2, None)], "k long, body string")
    got = {(r["k"], r["at"], r["match_text"], r["entity_id"]) for r in mentions.find(texts, words, "body").collect()}
    assert got == {(1, 2, "Red fox", "e0"), (1, 7, "red fox7", "e7"), (1, 12, "fox", "f")}
