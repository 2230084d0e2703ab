"""Operators 2, 4 and 6 against brute force."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, empty, frame, words  # noqa: E402

from litgraph.llm import components, exact_dedup, repeats, simhash  # noqa: E402


def removed_by_force(raws: list[bytes], length: int) -> list[tuple]:
    seen = Counter(b[q:q + length] for b in raws for q in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for q in range(len(b) - length + 1):
            if seen[b[q:q + length]] > 1:
                gone[q:q + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def removed(df) -> list[tuple]:
    rows = df.selectExpr("n_bytes", "n_removed", "size(spans)", "kept_sha256", "doc_id").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("group", [4096, 5])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 5: nearly all groups are cut, down to single windows
    rnd = random.Random(group)
    common = words(rnd, 90)
    rows = [(1000 + i, words(rnd, rnd.randint(0, 40)) + common[rnd.randint(0, 60):] + words(rnd, rnd.randint(0, 40))) for i in range(60)]
    dirty, _ = documents(spark)
    rows += [(d, t[:4000] if t else t) for d, t in dirty]
    want = removed_by_force([(t or "").encode() for _, t in rows], 400)
    got = removed(repeats.remove_repeats(frame(spark, rows)))
    assert got == sorted([(*w, d) for w, (d, _) in zip(want, rows)], key=str)


def test_texts_without_repeats(spark):
    rnd = random.Random(6)
    unique = [(i, "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randint(395, 2500)))) for i in range(40)]
    for rows in (unique[:1], unique):
        got = removed(repeats.remove_repeats(frame(spark, rows)))
        assert got == sorted([(len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest(), d) for d, t in rows], key=str)
    rows = unique + [(100 + i, unique[0][1] if i % 2 else unique[1][1][:450]) for i in range(20)]
    df = frame(spark, rows[:40]).coalesce(1).unionByName(frame(spark, rows[40:]).coalesce(1))  # one partition without repeats
    want = removed_by_force([t.encode() for _, t in rows], 400)
    assert removed(repeats.remove_repeats(df)) == sorted([(*w, d) for w, (d, _) in zip(want, rows)], key=str)


@pytest.mark.parametrize("group", [4096, 20])
def test_one_core_in_very_many_different_texts(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rnd = random.Random(11)
    core = "".join(rnd.choice("klmnopqrstuvwxyz ") for _ in range(430))
    noise = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    rows = [(i, noise(rnd.randint(0, 60)) + core[rnd.randint(0, 40):430 - rnd.randint(0, 40)] + noise(rnd.randint(0, 60))) for i in range(400)]
    rows += [(7, rows[7][1])] * 3 + [(7, rows[8][1])]  # a repeated row, an id with two texts
    want = removed_by_force([t.encode() for _, t in rows], 400)
    assert removed(repeats.remove_repeats(frame(spark, rows))) == sorted([(*w, d) for w, (d, _) in zip(want, rows)], key=str)


def test_repeats_in_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 5000)  # texts over it are read in parts
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(12_000))
    text = text + text[3000:3900] + "Z" + text[:401]
    got = removed(repeats.remove_repeats(frame(spark, [(1, text)]), 400))
    assert got == [(*removed_by_force([text.encode()], 400)[0], 1)]


def fingerprint_by_force(text: str | None) -> int:
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(fps: list[int], ids: list, radius: int) -> list:
    left, out = set(range(len(fps))), {}
    while left:
        todo, found = [left.pop()], set()
        while todo:
            x = todo.pop()
            found.add(x)
            near = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= radius}
            left -= near
            todo += near
        known = [ids[x] for x in found if ids[x] is not None]
        for x in found:
            out[x] = min(known) if known else None
    return [out[x] for x in range(len(fps))]


@pytest.mark.parametrize("radius,blocks,block", [(3, 5, 1024), (3, 5, 4), (6, 8, 1024)])
def test_simhash_equals_brute_force(spark, monkeypatch, radius, blocks, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 4: most buckets are dealt to pairs of blocks
    rows, _ = documents(spark)
    rnd = random.Random(9)
    base = words(rnd, 60).split()
    for i in range(120):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = rnd.choice(base)
        rows.append((500 + i, " ".join(copy)))
    fps = [fingerprint_by_force(t) for _, t in rows]
    want = [(d, f"{f:016x}", g) for (d, _), f, g in zip(rows, fps, groups_by_force(fps, [d for d, _ in rows], radius))]
    got = [tuple(r) for r in simhash.near_groups(frame(spark, rows), radius=radius, blocks=blocks).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprint_of_many_slices(monkeypatch):
    text = words(random.Random(2), 900)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 100)
    assert simhash.fingerprint(text) == whole == np.int64(np.uint64(fingerprint_by_force(text)))


def test_sliced_links_equal_counting():
    rng = np.random.default_rng(4)
    fps = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), False)) for b in rng.integers(0, 1 << 62, 9) for _ in range(20)], np.uint64)
    starts, ends = np.repeat([0, 100], [100, 80]), np.repeat([100, 180], [100, 80])
    for radius in (0, 2, 3, 6):
        got = set(zip(*(x.tolist() for x in simhash.sliced_links(fps, starts, ends, radius))))
        want = {(i, j) for i in range(180) for j in range(i + 1, int(ends[i])) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
        assert got == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (5000, 4000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + k: 1000 for k in range(50)} | {5000: 4000, 4000: 4000}


def test_filter_grows_with_the_rows(spark):
    """Many more rows than one filter serves: nearly all single rows still go straight through, and no repeated one."""
    rows = spark.range(300_000).selectExpr("id", "unhex(sha2(cast(if(id % 10 = 0, id % 1000, id) as string), 256)) sha")
    bits, ranges = exact_dedup._sizes(300_000, 8, 1 << 18)
    assert (bits, ranges) == (1 << 18, 10)
    hashed = rows.selectExpr("*", f"cast(pmod(xxhash64(sha, 2), {ranges}) as int) range").cache()
    found = exact_dedup.probed_rows(hashed, 300_000, 8, 1 << 18)
    single = found.filter("id % 10 <> 0")
    assert found.count() == 300_000 and found.filter("id % 10 = 0 AND NOT suspect").count() == 0
    assert single.filter("suspect").count() < 0.03 * single.count()


@pytest.mark.parametrize("bits,most", [(8, 1 << 27), (0, 1 << 27), (8, 100)])
def test_exact_dedup_equals_brute_force(spark, bits, most):
    rows, df = documents(spark)
    by_text = defaultdict(list)
    for d, t in rows:
        by_text[t or ""].append(d)
    want = []
    for d, t in rows:
        ids = [x for x in by_text[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((d, keep, len(by_text[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(df, bits_per_row=bits, max_bits=most).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_dedup_full_filter_changes_nothing(spark, monkeypatch):
    _, df = documents(spark)
    usual = sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "_slot", lambda seed, bits: exact_dedup.F.lit(seed * bits))  # all rows share both slots
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str) == usual


def test_empty_tables(spark):
    assert repeats.remove_repeats(empty(spark)).collect() == []
    assert simhash.near_groups(empty(spark)).collect() == []
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []
