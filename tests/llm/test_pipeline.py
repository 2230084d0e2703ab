"""The pipeline against a brute-force version of its stages on planted documents."""

from __future__ import annotations

import random
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import frame, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from litgraph.llm import language, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_documents(spark):
    rnd = random.Random(8)
    clean = {i: words(rnd, 150) for i in range(30)}
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    near = clean[3].split()
    near[70] = "altered"
    rows = list(clean.items()) + [(100, clean[1]), (101, clean[1]), (101, clean[1]), (102, " ".join(near)), (103, None), (104, "123 ... 456"),
                                  (105, "漢字仮名交じり文" * 30), (106, words(rnd, 60) + "\n" + item + "\n" + words(rnd, 60))]
    lang = F.when(F.col("doc_id") != 105, F.col("lang"))  # else its own script would be learned from it
    docs, seen = frame(spark, rows).withColumn("lang", lang).select(*corpus_pipeline.COLUMNS), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    everything = set(clean) | {100, 101, 102, 106}
    assert set(seen[0]) == everything and seen[0].count(101) == 2
    assert seen[1] == sorted(everything - {1, 100})
    assert seen[2] == sorted(everything - {1, 100, 102})
    assert seen[3] == sorted(everything - {1, 100, 102, 106})


def test_rows_are_told_apart_by_id_and_text(spark):
    rnd = random.Random(4)
    a, b, c = (words(rnd, 80) for _ in range(3))
    near = " ".join([*c.split()[:-1], "other"])
    columns = lambda rows: frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    copies = corpus_pipeline.without_copies(spark, columns([(5, a), (5, b), (9, a), (None, a), (None, c), (None, c), (None, ""), (3, None)]), SF)
    assert rows(copies) == sorted([(5, b), (9, a), (None, c), (3, None)], key=str)
    close = corpus_pipeline.without_near_copies(spark, columns([(5, c), (5, b), (4, near), (None, near + " x"), (None, a), (6, b)]), SF)
    assert rows(close) == sorted([(5, b), (4, near), (None, a)], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = corpus_pipeline.without_leaks(spark, columns([(1, a), (1, item), (None, b), (None, b + " " + item), (2, None)]), SF)
    assert rows(clean) == sorted([(1, a), (None, b), (2, None)], key=str)


def test_stages_of_empty_tables(spark):
    none = frame(spark, []).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def sets_of(text: str | None) -> frozenset:
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))) if ws else frozenset()


def groups_of(texts: dict[int, str]) -> dict[int, int]:
    """Least id reached over pairs of similarity 0.8 or more."""
    sets, by = {d: sets_of(t) for d, t in texts.items()}, {}
    root = {d: d for d in texts}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    met = Counter((a, b) for ids in by.values() for a, b in combinations(sorted(ids), 2))
    for (a, b), both in met.items():
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root[a], root[b]))
            root = {d: x if r == y else r for d, r in root.items()}
    return root


def test_recall_of_near_copies(spark):
    """Pairs just at or over the similarity: nearly all are found, and none under it."""
    rnd = random.Random(3)
    texts, pairs, pool = {}, [], " ".join(f"w{i}" for i in range(3000))
    for n in range(400):
        base = words(rnd, rnd.choice([120, 200, 400]), pool).split()
        copy = list(base)
        for _ in range(int(len(base) * rnd.uniform(0.008, 0.026))):
            copy[rnd.randrange(len(copy))] = "x" + str(rnd.random())
        texts[2 * n], texts[2 * n + 1] = " ".join(base), " ".join(copy)
        a, b = sets_of(texts[2 * n]), sets_of(texts[2 * n + 1])
        pairs.append((2 * n, len(a & b) / len(a | b)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, list(texts.items()))).collect()}
    near = [d for d, s in pairs if s >= 0.8]
    border = [d for d, s in pairs if 0.8 <= s < 0.85]
    assert len(near) > 150 and len(border) > 40
    assert sum(got[d + 1] == d for d in near) >= 0.95 * len(near) and sum(got[d + 1] == d for d in border) >= 0.9 * len(border)
    assert all(got[d + 1] == d + 1 for d, s in pairs if s < 0.8) and all(got[d] == d for d, _ in pairs)


@pytest.mark.parametrize("block", [1024, 8])
def test_near_copies_equal_brute_force(spark, monkeypatch, block):
    """A large group of copies of copies, chains that the similarity cuts, short and dirty texts."""
    monkeypatch.setattr(simhash, "BLOCK", block)  # 8: the group is dealt to pairs of blocks
    rnd = random.Random(21)
    texts = {i: words(rnd, 90, " ".join(f"w{k}" for k in range(400))) for i in range(25)}
    last = texts[3]
    for i in range(100, 180):
        ws = (texts[3] if rnd.random() < 0.7 else last).split()
        ws[rnd.randrange(len(ws))] = f"c{i}"
        texts[i] = last = " ".join(ws)
    texts |= {200: "one", 201: "ONE ", 202: "two words", 203: "a b c d e f", 204: "a b c d e g", 205: None, 206: " "}
    want = groups_of(texts)
    want[206] = 205
    got = {r["doc_id"]: (r["component_id"], r["leads"]) for r in simhash.similar_groups(frame(spark, list(texts.items()))).collect()}
    assert got == {d: (g, g == d) for d, g in want.items()}


def test_distances_and_forests():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, (12, 4)).astype(np.uint64)
    fps = np.repeat(base, 15, axis=0)
    for row in fps:
        for b in rng.choice(256, rng.integers(0, 40), False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    starts, ends = np.repeat([0, 70], [70, 110]), np.repeat([70, 180], [70, 110])
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)
    for radius in (0, 20, 50):
        i, j, distance = simhash.sliced_distances(fps, starts, ends, radius)
        want = {(a, b, int(apart[a, b])) for a in range(180) for b in range(a + 1, int(ends[a])) if apart[a, b] <= radius}
        assert set(zip(i.tolist(), j.tolist(), distance.tolist())) == want
    kept = simhash.nearest_forest(180, i, j, distance)
    assert (simhash.stars(180, i[kept], j[kept]) == simhash.stars(180, i, j)).all()
    assert len(kept) == 180 - len(set(simhash.stars(180, i, j).tolist()))
    for limit in (10, 25, 40):  # a minimum forest joins what pairs up to any distance join
        some = kept[distance[kept] <= limit]
        assert (simhash.stars(180, i[some], j[some]) == simhash.stars(180, i[distance <= limit], j[distance <= limit])).all()


def test_run_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    names, _, spans = model.predict([r["text"] for r in table])
    left = {r["doc_id"]: r["text"] for r, n, s in zip(table, names, spans) if n != "und" and s >= corpus_pipeline.LEAST_SPAN}
    newest = {t: d for d, t in sorted(left.items())}
    left = {d: t for t, d in newest.items()}
    roots = groups_of(left)
    left = {d: t for d, t in left.items() if roots[d] == d}
    plain = lambda t: " " + " ".join(w.strip(".,!?:|*#$%&").lower() for w in t.split()) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for d, t in left.items() if not any(i in plain(t) for i in items)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in left.items()}
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_links_that_a_forest_leaves_out(spark):
    """Pairs near the threshold: a nearer pair of the forest may fail the check while one left out of it passes."""
    rnd, texts = random.Random(16), []
    for _ in range(150):
        base = [f"{rnd.randrange(1 << 30):x}" for _ in range(rnd.randint(80, 104))]
        for _ in range(8):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = f"{rnd.randrange(1 << 30):x}"
            texts.append(" ".join(copy))
    shingles, bounds = simhash.shingle_sets(texts)
    fps = simhash.long_fingerprints(shingles, bounds)
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    keys, sets, pairs = simhash.table_keys(len(texts)), [set(shingles[a:b].tolist()) for a, b in zip(bounds, bounds[1:])], []
    for group in range(0, len(texts), 8):
        for i in range(group, group + 8):
            for j in range(i + 1, group + 8):
                differ = bits[i] != bits[j]
                both = len(sets[i] & sets[j])
                if differ.sum() <= simhash.RADIUS and not differ[keys].any(axis=1).all() and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    pairs.append((i, j))
    want = simhash.stars(len(texts), *np.array(pairs).T)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_batches_are_small_and_the_session_keeps_its_own(spark, monkeypatch):
    conf, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    stage = lambda spark, docs, sf_dir: seen.append(int(spark.conf.get(conf))) or docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("last", stage)])
    before = spark.conf.get(conf)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert seen == [2000, 2000] and spark.conf.get(conf) == before
