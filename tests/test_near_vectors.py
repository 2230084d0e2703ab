"""Approximate vector pairs: recall against all pairs, and buckets that stay bounded."""

from __future__ import annotations

import numpy as np
import pytest

from litgraph.operators import pairs

SF = "/root/testdata/sf0.01"


def exact(v: np.ndarray, ids: list[int], threshold: float) -> set[tuple[int, int]]:
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    return {tuple(sorted((ids[a], ids[b]))) for a, b in zip(i.tolist(), j.tolist())}


@pytest.mark.parametrize("block", [1000, 40])
def test_recall_on_clustered_vectors(spark, block):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.standard_normal((60, 24)), 15, axis=0) + rng.standard_normal((900, 24)) * 0.55
    v[:200] = v[0] + rng.standard_normal((200, 24)) * 0.05  # one hot bucket
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 24)], "vec_id long, embedding array<double>")
    got = {(r["paper_a_id"], r["paper_b_id"]) for r in pairs.similar_pairs_lsh(rows, 0.75, None, block=block).collect()}
    want = exact(v, list(range(900)), 0.75)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 20_000
    away = {p for p in want if p[0] >= 200}
    assert len(got & away) >= 0.95 * len(away) and len(away) > 300


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    kept = [(r["vec_id"], r["embedding"]) for r in rows.collect() if r["embedding"] is not None]
    want = exact(np.array([v for _, v in kept]), [i for i, _ in kept], 0.35)
    got = {(r["paper_a_id"], r["paper_b_id"]) for r in pairs.similar_pairs_lsh(rows, 0.35, None).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 0
    assert pairs.similar_pairs_lsh(rows.limit(0)).collect() == []


def test_few_tables_for_many_vectors():
    made = [len(pairs.code_tables(120_000, 64, t)) for t in (0.9, 0.6, 0.35)]
    assert made == sorted(made) and made[-1] < 100  # each vector travels twice a table at most
    low, high = pairs.code_tables(120_000, 64, 0.35), pairs.code_tables(120_000, 64, 0.9)
    assert np.array_equal(low[:len(high)], high)


def test_steps_down_to_the_limit(spark):
    v = np.random.default_rng(5).standard_normal((1500, 48)).astype("float32")
    v[1400:] = v[:100] + np.float32(0.3) * v[100:200]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    i, j = np.triu_indices(len(v), 1)
    s = (unit @ unit.T)[i, j]
    best = {(int(a), int(b)) for a, b in zip(i[np.argsort(-s)[:300]], j[np.argsort(-s)[:300]])}
    got = {(r["paper_a_id"], r["paper_b_id"]): r["similarity"] for r in pairs.similar_pairs_lsh(rows, 0.35, 300, block=100).collect()}
    assert len(got) == 300 and len(best & set(got)) >= 0.93 * 300
    assert all(abs(unit[a] @ unit[b] - x) < 1e-9 for (a, b), x in got.items())


def test_rows_are_placed_few_at_a_time(spark, monkeypatch):
    v = np.random.default_rng(6).standard_normal((300, 12)).astype("float32")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(pairs, "PLACED", 7)
    got = {(r["paper_a_id"], r["paper_b_id"]) for r in pairs.similar_pairs(rows, 0.5, None, pivots=9, block=20).collect()}
    assert got == exact(v.astype(float), list(range(300)), 0.5) and pairs.measured_vectors(rows).schema["v"].dataType.simpleString() == "array<float>"
