"""Branch and bound against full enumeration on random graphs; hubs in blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from litgraph.operators import paths

EDGES = ("source_entity_name string, target_entity_name string, predicate_type string, source_operation string, target_operation string, "
         "edge_source string, support_count long, mean_confidence double, contradiction_load long")


def graph(spark, seed: int, nodes: int = 14, links: int = 75):
    rnd = random.Random(seed)
    op = {n: rnd.choice(["Defense", "Repair", None, "Sensing"]) for n in range(nodes)}
    rows = []
    for _ in range(links):
        a, b = rnd.randrange(nodes), rnd.randrange(nodes)
        rows.append((f"N{a}", f"n{b}", rnd.choice(["blocks", "induces"]), op[a], op[b], rnd.choice(["backbone", "literature", "triple"]), rnd.randint(1, 5),
                     rnd.choice([None, 0.3, 0.5, 0.9, 1.0]), rnd.choice([None, 0, 0, 1, 3])))
    return spark.createDataFrame(rows, EDGES)


@pytest.mark.parametrize("seed", [1])
def test_best_paths_equal_enumeration(spark, seed):
    edges = graph(spark, seed).cache()
    rnd = random.Random(seed)
    triples = spark.createDataFrame(
        [(f"p{rnd.randrange(12)}", f"t{i}", f"n{rnd.randrange(14)}", f"N{rnd.randrange(14)}") for i in range(60)],
        "paper_id string, triple_id string, subject string, object string")
    seeds = spark.createDataFrame([("N1",), ("n2",)], "resolved_name string")
    every = paths.enumerate_paths(edges, seeds, max_hops=4, path_limit=None).cache()
    ends = every.select(F.element_at("path_keys", 1).alias("endpoint_a"), F.element_at("path_keys", -1).alias("endpoint_b"))
    scored = paths.score_paths(every, paths.co_mentions(triples, ends)).select("path_key", "composite", "hops").collect()
    want = sorted(((-r["composite"], r["hops"], r["path_key"]) for r in scored))
    for k in (8,):
        got = paths.best_paths(edges, triples, seeds, k, 4).collect()
        assert sorted((-r["composite"], r["hops"], r["path_key"]) for r in got) == want[:k]
    assert len(want) > 150


def test_traverse_equals_enumeration(spark):
    edges = graph(spark, 5).cache()
    rows = paths.traverse(edges, "n3", limit=None).select("op_boundary_crossings", "path_conf", "contra_load", "path_key").collect()
    key = lambda r: (-r["op_boundary_crossings"], -r["path_conf"], r["contra_load"] is not None, r["contra_load"] or 0, r["path_key"])
    for k in (20,):
        got = paths.traverse(edges, "n3", limit=k).collect()
        assert [r["path_key"] for r in sorted(got, key=key)] == [r["path_key"] for r in sorted(rows, key=key)[:k]]


def test_hub_edges_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(paths, "HUB_EDGES", 50)
    links = [(f"a{i}", "hub", i) for i in range(20)] + [("hub", f"z{i}", i) for i in range(1000)] + [("z1", "end", 0)]
    edges = spark.createDataFrame([(a, b, "induces", "Defense", "Repair", "literature", 1, 0.5, n % 3) for a, b, n in links], EDGES)
    steps, hubs = paths.in_blocks(paths._edge_steps(edges))
    assert [tuple(r) for r in hubs.collect()] == [("hub", 20)]
    sizes = [r["count"] for r in steps.filter("from_key = 'hub'").groupBy("block").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 50
    seeds = spark.createDataFrame([(f"A{i}",) for i in range(20)], "resolved_name string")
    found = paths.enumerate_paths(edges, seeds, max_hops=3, path_limit=None)
    assert sorted(map(tuple, found.groupBy("hops").count().collect())) == [(1, 20), (2, 20_000), (3, 20)]
    goal = spark.createDataFrame([("END",)], "resolved_name string")
    assert paths.enumerate_paths(edges, seeds, goal, max_hops=4, path_limit=7).count() == 7


def test_searches_end_when_each_group_is_full(spark):
    links = [("a", "g1"), ("a", "b"), ("b", "g1"), ("c", "d"), ("d", "g2"), ("d", "e"), ("e", "g2")]
    edges = spark.createDataFrame([(a, b, "induces", "Defense", "Repair", "literature", 1, 0.5, 0) for a, b in links], EDGES)
    seeds = spark.createDataFrame([("x", "a"), ("y", "c")], "frame_id string, resolved_name string")
    goals = spark.createDataFrame([("x", "g1"), ("y", "g2")], "frame_id string, resolved_name string")
    got = paths.enumerate_paths(edges, seeds, goals, max_hops=3, path_limit=1, carry=("frame_id",)).collect()
    assert {(r["frame_id"], "|".join(r["path_keys"])) for r in got} == {("x", "a|g1"), ("y", "c|d|g2")}


def test_template_brief_document(spark):
    from litgraph.operators import briefs

    nodes = spark.createDataFrame([("a", 4, ["f1", "f2", "f3", "f4"], "convergent"), ("b", 3, ["f1", "f2", "f3"], "convergent"), ("c", 2, ["f1", "f2"], "bridge")],
                                  "node string, frame_count long, frames array<string>, kind string")
    stats = spark.createDataFrame([("f2", "Second", "why?", 9, 0.25, False), ("f1", "First", "how?", 1, 0.5, True)],
                                  "frame_id string, label string, frame_question string, paths_scored long, top_score double, thin boolean")
    text = briefs.template_brief(nodes, stats, "What helps?", None).head()["brief_md"]
    assert text == "\n\n".join([
        "# Brief: What helps?", "**Condition:** unspecified", "## Findings by frame",
        "### First\n*how?*\n- Paths scored: 1\n- Top score: 0.500\n### Second\n*why?*\n- Paths scored: 9\n- Top score: 0.250",
        "## Nodes of three frames or more", "- **a** — 4 frames: f1, f2, f3, f4\n- **b** — 3 frames: f1, f2, f3",
        "## Nodes of two frames", "- **c** — f1 ↔ f2", "## Gaps", "- First: 1 paths (thin)"])
    none = briefs.template_brief(nodes.limit(0), stats.limit(0), "q", "c").head()["brief_md"]
    assert none.startswith("# Brief: q\n\n**Condition:** c\n\n## Findings by frame\n\n")
