"""Operators 11, 12 and 13: exact algebra, gradients, brute force and held-out accuracy."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, empty, words  # noqa: E402

from litgraph.llm import negatives, quality, queries, vectors, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, component int, n int, anchor int, rank int, block int, crew int"
EXTRA = (1, "a", 2, 3, 4, 5, 6, 7)


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def dirty_vectors(seed: int = 2, n: int = 160, width: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, 0.3, width)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(i + n, rows[3][1], 1) for i in range(40)] + [(5, rows[5][1], rows[5][2])] * 3  # a hot vector, repeated rows
    rows += [(5, rows[9][1], 2), (None, rows[7][1], 1), (1000, None, 1), (1001, [0.1] * (width - 1) + [None], 1), (1002, [float("nan")] * width, 1),
             (1003, [float("inf")] + [0.0] * (width - 1), 1), (1004, rows[8][1], None), (1050, [0.25, -0.5], 3), (1100, [], 0), (1150, [-0.0] * width, 2)]
    return rows


def kept(rows: list[tuple], width: int = 6) -> list[tuple]:
    """Rows with integer vectors."""
    out = []
    for i, v, label in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            out.append((i, [int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)), label))
    return out


# Whitening

def whitened_by_force(rows: list[tuple]) -> tuple[np.ndarray, int, list[int], np.ndarray, np.ndarray]:
    fit = sorted({tuple(x) for _, x, _ in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    apart = np.array(fit, float) - np.array(sums) / n
    values, basis = np.linalg.eigh(apart.T @ apart / n)
    return np.array(fit, float), n, sums, values[::-1], basis[:, ::-1]


def test_whitening_equals_eigenvectors(spark):
    rows = kept(dirty_vectors())
    _, n, sums, values, basis = whitened_by_force(rows)
    got = whitening.whiten(vectors_of(spark, dirty_vectors())).collect()
    assert len(got) == 4 * len(rows)
    deviation = lambda x: sum((n * a - b) ** 2 for a, b in zip(x, sums))
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1 and r["vec_id"] is not None) == sorted(
        (i, deviation(x)) for i, x, _ in rows if i is not None)
    assert {r["n"] for r in got} == {n} and {r["identity_error"] <= 1e-9 for r in got} == {True}
    by_id = {i: x for i, x, _ in rows if i not in (None, 5)}
    for k in range(4):
        own = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        want = {i: float((np.array(x) - np.array(sums) / n) @ basis[:, k] / np.sqrt(values[k])) for i, x in by_id.items()}
        sign = np.sign(sum(own[i]["whitened"] * w for i, w in want.items()))
        assert max(abs(sign * own[i]["whitened"] - w) for i, w in want.items()) < 1e-9
        assert own[0]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-12)


def test_filter_with_fewer_columns_than_dimensions(spark):
    """Wide vectors with a flat spectrum: the block is filtered, grows where that gains little, and is certified."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 0.2, (900, 48)) * np.linspace(1.02, 1, 48)).astype(np.int64)
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<bigint>").repartition(5)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    for guards, degree in ((2, 10), (20, 10), (2, 2)):
        model = whitening.fit_components(fit, 48, components=3, guards=guards, degree=degree)
        assert model.certified and model.passes > 1
        assert np.allclose(model.values, values[::-1][:3], rtol=1e-12)
        assert np.allclose(np.abs((model.basis * basis[:, ::-1][:, :3]).sum(axis=0)), 1, atol=1e-10)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25], 1)] * 4)).collect() == []  # no variance
    assert whitening.whiten(vectors_of(spark, [(1, [], 1), (2, None, 1)])).collect() == []
    line = whitening.whiten(vectors_of(spark, [(i, [i / 8, i / 4, 1.0], 0) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 9 and line[0]["explained"] == pytest.approx(1)
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0)])).collect()
    assert {r["deviation"] for r in huge} == {None}
    assert whitening.whiten(vectors_of(spark, []).select("vec_id", "embedding")).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FAN", 3)
    rows = spark.range(500).selectExpr("array(id, -id * 5000000000) x").repartition(30)
    assert whitening._sums(rows, 2) == (500, [124750, -124750 * 5000000000])


# Quality

def test_slopes_are_the_derivatives_of_the_loss():
    rng = np.random.default_rng(3)
    model = quality.AttentionModel(encoded=5, gates=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    features, own = rng.normal(0, 1, (9, quality.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    good, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss() -> float:
        h, _, _, e = model._passages(features)
        bag = np.array([(e[own == d, None] * h[own == d]).sum(axis=0) / e[own == d].sum() for d in range(3)])
        said = 1 / (1 + np.exp(-(bag @ model.weights["c"] + model.weights["d"])))
        return float(-(weight * (good * np.log(said) + (1 - good) * np.log(1 - said))).sum() / weight.sum())
    slopes = model._slopes(features, own, good, weight)
    for k, v in model.weights.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(6)]:
            v[at] += 1e-5
            up = loss()
            v[at] -= 2e-5
            assert slopes[k][at] == pytest.approx((up - loss()) / 2e-5, rel=2e-3, abs=1e-7)
            v[at] += 1e-5


def test_passages_cover_whole_texts():
    rnd = random.Random(1)
    texts = [b"", b"x", b"y" * 512, b"z" * 513, words(rnd, 3000).encode(), b"", b"tail"]
    for at_once in (1, 3, 1000):
        back = [b""] * len(texts)
        for owner, number, data, lengths in quality.passages(texts, at_once):
            for o, i, d, n in zip(owner, number, data, lengths):
                assert len(back[o]) == i * quality.PASSAGE
                back[o] += bytes(d[:n])
        assert back == texts
    model = quality.AttentionModel()
    alone = [model.score([t]) for t in texts]
    together = model.score(texts)
    for k in range(3):
        assert np.allclose([a[k][0] for a in alone], together[k])
    assert together[1].tolist() == [1, 1, 1, 2, -(-len(texts[4]) // 512), 1, 1]


def test_features_of_a_passage():
    text = b"one one two TWO 11!"
    data = np.frombuffer(text.ljust(512, b"q"), np.uint8).reshape(1, -1)
    f = quality.encode(data, np.array([len(text)]))[0]
    assert f[0] == pytest.approx(np.sqrt(9 / 19)) and f[1] == pytest.approx(np.sqrt(3 / 19)) and f[2] == pytest.approx(np.sqrt(2 / 19))
    assert f[-3] == pytest.approx(1 / 5) and f[-2] == pytest.approx(15 / 5 / 32) and f[-1] == pytest.approx(19 / 512)
    assert (quality.encode(data, np.array([0]))[0] == 0).all()
    again = quality.encode(np.frombuffer(b"abcdefghij" * 20 + bytes(312), np.uint8).reshape(1, -1), np.array([200]))[0]
    assert again[-4] == pytest.approx((193 - 10) / 200)


def test_one_bad_passage_is_found():
    rnd = random.Random(2)
    clean = [words(rnd, 400).encode() for _ in range(120)]
    junk = [t[:900] + b"BUY!! NOW!! " * 40 + t[900:] for t in clean[:60]]
    bags = [quality.encode(d, n) for t in clean[60:] + junk for _, _, d, n in quality.passages([t])]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    model = quality.AttentionModel().fit(np.concatenate(bags), owner, np.arange(120) < 60, np.ones(120, np.float32))
    long = b"".join(clean[:20])
    said, count, focus = model.score([clean[0], junk[0], long[:20_000] + b"BUY!! NOW!! " * 60 + long[20_000:]])
    assert said[0] > 0.7 and said[1] < 0.7 and 512 <= focus[1] <= 1536
    assert 19_900 // 512 * 512 <= focus[2] <= 21_000 and count[2] > 80


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op12_quality_classifier(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert len(held) > 50 and sum(p == m for p, m in held) >= 0.93 * len(held)


def test_quality_of_dirty_and_empty_tables(spark):
    rows, df = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, "x", "y") for i in range(30)] + [(3, 0, "x", "y"), (None, 1, "x", "y"), (4, None, "x", "y")], "doc_id long, quality int, text string, h string")
    got = quality.classify(df, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    same = {r["score"] for r in got if r["doc_id"] in (0, 1)}
    assert len(same) == 1 and all(0 <= r["score"] <= 1 for r in got)  # null and empty alike
    assert quality.classify(empty(spark), labels).collect() == []
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    ones = {r["score"] for r in quality.classify(df, labels.filter("quality = 1 and doc_id <> 3")).collect()}
    assert len(ones) == 1 and min(ones) > 0.5
    again = {(r["doc_id"], r["score"]) for r in quality.classify(df.repartition(5), labels.repartition(2)).collect()}
    assert {(d, round(s, 4)) for d, s in again} == {(r["doc_id"], round(r["score"], 4)) for r in got}


# Hard negatives

def mined_by_force(rows: list[tuple], anchors: int, positives: int = 5, k: int = 3) -> list[tuple]:
    seen = sorted({(i, label, tuple(x)) for i, x, label in rows if label is not None}, key=str)
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, label, x in seen:
        if i is None or i % anchors:
            continue
        score = lambda y: sum(a * b for a, b in zip(x, y))
        close = sorted(((score(y), j) for j, m, y in seen if m == label and j != i), key=order)[:positives]
        for p, j in close:
            hard = [(score(y), h) for h, m, y in seen if m != label and 50 * p <= 100 * score(y) <= 95 * p]
            out += [(i, j, r + 1, h, p, s) for r, (s, h) in enumerate(sorted(hard, key=order)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,crew,first", [(4096, 512, 32), (16, 3, 1), (40, 512, 4)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, crew, first):
    for name, value in (("BLOCK", block), ("ANCHORS", crew), ("FIRST_DEPTH", first)):
        monkeypatch.setattr(negatives, name, value)
    rows = dirty_vectors(block)
    got = negatives.mine(vectors_of(spark, rows), is_anchor="vec_id % 5 = 0").collect()
    assert sorted(map(tuple, got), key=str) == mined_by_force(kept(rows), 5) and len(got) > 50


def test_search_stops_early_and_exactly():
    """Few dimensions: the threshold ends the search long before the lists do."""
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(0, 60, (3000, 3))).astype(np.int64)
    lists = negatives.Lists(rng.permutation(3000), np.zeros(3000, np.int64), x)
    depths: list[int] = []
    shown = lists.shown
    lists.shown = lambda anchors, depth: depths.append(depth) or shown(anchors, depth)
    anchors = np.array([[200, 10, -5], [0, 0, 90], [-30, 80, 20]])
    scores = anchors @ lists.x.T
    allowed = rng.random((3, 3000)) < 0.8
    low, high = np.array([[0, 1], [10, 0], [5, 5000]]), np.array([[10**9, 9000], [8000, -1], [10**9, 10**9]])
    found = negatives.search(lists, anchors, allowed, low, high, 4)
    for w in range(2):
        for g in range(3):
            at = [i for i in range(3000) if allowed[g, i] and low[g, w] <= scores[g, i] <= high[g, w]]
            want = sorted(((-scores[g, i], lists.ids[i]) for i in at))[:4]
            assert [(-s, lists.ids[i]) for o, i, s in zip(*found[w]) if o == g] == want
    top = negatives.search(lists, anchors, np.ones((3, 3000), bool), np.full((3, 1), -10**9), np.full((3, 1), 10**9), 4)
    assert max(depths) < 3000 or len(depths) > 3
    depths.clear()
    negatives.search(lists, anchors, np.ones((3, 3000), bool), np.full((3, 1), -10**9), np.full((3, 1), 10**9), 4)
    assert max(depths) < 3000 and len(top[0][0]) == 12


def test_negatives_of_odd_tables(spark):
    assert negatives.mine(vectors_of(spark, [])).collect() == []
    assert negatives.mine(vectors_of(spark, [(50, [0.5], 1)])).collect() == []
    assert negatives.mine(vectors_of(spark, [(1, [0.5], 1), (2, [0.5], 2)])).collect() == []
    blank = negatives.mine(vectors_of(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).collect()
    assert [tuple(r) for r in blank] == [(0, 1, 1, 2, 0, 0)]
    zero = negatives.mine(vectors_of(spark, [(0, [0.0], 1), (1, [1.0], 1), (2, [1.0], 2), (3, [1.0], 2)])).collect()
    assert [tuple(r) for r in zero] == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]
    large = [(0, [3e13], 1), (1, [3e13], 1), (2, [2e13], 2)]
    assert len(negatives.mine(vectors_of(spark, [(i, [v[0] / 1e7], m) for i, v, m in large])).collect()) == 1
