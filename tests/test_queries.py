"""Registered queries against their SQL twins, and the shape of their plans."""

from __future__ import annotations

import shutil
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from litgraph.plans.derive import BASE_TABLES, Tables
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "A04_convergences", "A09_literature_edges", "A13_bridge_score", "A18_critique_candidates", "D02_enumerate_paths",
    "D02_paths_to_targets", "D04_co_mentions", "D07_missing_edges_all", "D12_synthesize_nodes", "G02_claim_triples",
    "G05_expand_mentions", "G09_shared_entity_pairs", "G10_convergent_claim_pairs", "G11_shared_mechanism_pairs", "G15_cooccurrence",
    "G19_shortest_paths", "G30_bridge_signals", "J13_citations", "J18_missed_citations", "S02_parse_jats", "S12_merge_fulltext",
    "T03_spend_stream", "T06_settling_stream", "X01_similar_pairs", "X04_search", "X10_outreach_eligibility",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cur = duck.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", ["J03_or_endpoint_join", "A03_degree", "G15_cooccurrence", "G09_shared_entity_pairs", "J12_no_edge_either_way",
                                  "D07_missing_edges", "G10_convergent_claim_pairs", "D04_co_mentions"])
def test_no_nested_loops(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # Derivations hold one-row scalar subqueries, which are not joins.
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from litgraph.operators.joins import page

    df = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    plan = page(df, ["o_orderkey"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_entry(spark):
    assert entry(spark).count() == 20


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_incremental_refresh_equals_rebuild(spark, duck):
    df = queries()["T01_refresh_stream"](spark, SF)
    cur = duck.execute(oracle_sql()["T01_refresh_stream"])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_mechanism_pairs_agree_in_the_interaction_too(spark, tmp_path):
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter("l_orderkey < 150" if name == "lineitem" else "true").write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = Tables(spark, str(tmp_path)).mechs.select("paper_id", "upstream_entity", "downstream_entity", "interaction_type").collect()
    want = Counter((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and (x[1] == y[1] or x[2] == y[2] or x[3] == y[3]))
    want = sorted(((a, b, n) for (a, b), n in want.items()), key=lambda x: (-x[2], *x[:2]))[:300]
    got = queries()["G11_shared_mechanism_pairs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda x: (-x[2], *x[:2])) == want


def test_citations_name_titles_that_go_on_for_any_length(spark, tmp_path):
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{SF}/{name}.parquet").filter(F.col(key) < 400).withColumn(key, F.col(key) * 10007 + 1).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Tables(spark, str(tmp_path))
    refs = [(r.me, r.other) for r in t.half.select("me", "other").collect()]
    papers = [(r.paper_id, r.title.lower(), r.doi) for r in t.papers.select("paper_id", "title", "doi").collect()]
    want = {(me, p) for me, other in refs for p, title, doi in papers if p != me and (
        doi == f"10.1000/p{other}" if me % 2 == 0 else title.startswith(f"paper {other}"))}
    assert any(len(str(p)) - len(str(other)) > 4 for me, other in refs for m, p in want if m == me)
    assert {tuple(r) for r in queries()["J13_citations"](spark, str(tmp_path)).collect()} == want


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    for at in ("a", "b"):
        shutil.copytree(SF, tmp_path / "x", dirs_exist_ok=True)
        (tmp_path / "x/documents.parquet").rename(tmp_path / at)
    (tmp_path / "x/documents.parquet").mkdir()
    for at in ("a", "b"):
        (tmp_path / at).rename(tmp_path / f"x/documents.parquet/{at}.parquet")
    got = {r.watchlist_id: r.new_count for r in queries()["T05_watchlist_stream"](spark, str(tmp_path / "x")).collect()}
    want = {r.source: r.n for r in spark.read.parquet(f"{SF}/documents.parquet").groupBy("source").agg(F.count_distinct("doc_id").alias("n")).collect()}
    assert got == want
