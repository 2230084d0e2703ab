"""Operators 3, 7 and 10: exact round trips and invariants."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, empty, frame, words  # noqa: E402

from litgraph.llm import dac, packing, sharding  # noqa: E402
from litgraph.llm.tokens import ChunkEncoder  # noqa: E402

FILES = {False: "word_bpe_49k.json", True: "byte_bpe_50k.json"}


def ids_by_force(blanks: bool, texts, end: int) -> list[list[int]]:
    t = Tokenizer.from_file(public_tokenizers.path(FILES[blanks]))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("blanks", [False, True])
def test_chunks_give_the_ids_of_whole_texts(blanks):
    rnd = random.Random(blanks)
    texts = ["".join(rnd.choice(" \nab's É1.!\t 　") for _ in range(rnd.randint(0, 30))) for _ in range(600)]
    texts += ["".join(rnd.choice(" \nab's É1 .!") for _ in range(40)) for _ in range(600)]
    texts += [None, "", " ", "ΑΣ ΟΔΟΣ end", "<|endoftext|> a", "a <|endoftext|> b", "x <|startoftext|>y, z", "\0abc x", "e ́x", "👩‍👩‍👧 x y"]
    e = ChunkEncoder(public_tokenizers.path(FILES[blanks]), blanks, remember=50)
    want = ids_by_force(blanks, texts, 7)
    for at in range(0, len(texts), 100):
        ids, counts = e.encode(texts[at:at + 100], 7)
        assert ids.tolist() == [i for x in want[at:at + 100] for i in x]
        assert counts.tolist() == [len(x) for x in want[at:at + 100]]


@pytest.mark.parametrize("blanks", [False, True])
def test_marks_of_any_script_before_stops_and_commas(blanks):
    rnd = random.Random(blanks)
    texts = ["“word”, he said", "« mot », dit", "50€. Then", "wait…, no", "21°, then", "a®, b", "a…. b", "ok 👍. Then", "हिन्दी, नमस्ते. है",
             "क\u093c, \u0958, x", "H\u0331. x", "\u0130\u0327, x", "e\u0301. x", "x\x01. y\x7f, z", "१, ½. 漢, Ⅳ. x", "a., b.) c, d"]
    signs = "aé1\u0958\u0301\u093f\u0331\u0130Hя漢²½”»…€°®👍\u200d\ufe0f)'_"
    texts += ["".join(rnd.choice(signs) + rnd.choice(["", "", ". ", ", ", " ", ".", "\n"]) for _ in range(12)) for _ in range(3000)]
    texts += [f"b a{chr(c)}. b{chr(c)}, c" for c in range(0x3000) if not chr(c).isspace()]
    ids, counts = ChunkEncoder(public_tokenizers.path(FILES[blanks]), blanks).encode(texts, 7)
    for text, want, end, n in zip(texts, ids_by_force(blanks, texts, 7), np.cumsum(counts), counts):
        assert ids[end - n:end].tolist() == want, text


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << k, 700) for k in (1, 7, 8, 9, 16, 17, 24, 31)] + [[0, 255, 256, 2**32 - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    block = dac.Block(dac.pack(ids, np.array([0, 3, 3, len(ids)])))
    assert block.bounds.tolist() == [0, 3, 3, len(ids)] and len(block.levels) == 4
    at = rng.integers(0, len(ids), 4000)
    assert (block.tokens(at) == ids[at]).all()
    for a, b in [(0, len(ids)), (5, 5), (0, 1), (63, 65), (511, 1025), (len(ids) - 1, len(ids))]:
        assert (block.run(a, b) == ids[a:b]).all()
    for n in (64, 511, 512, 513, 1024):
        even = np.full(n, 300, np.uint32)
        assert (dac.Block(dac.pack(even, np.array([0, n]))).run(0, n) == even).all()
    nothing = dac.Block(dac.pack(np.zeros(0, np.uint32), np.array([0])))
    assert nothing.run(0, 0).tolist() == []


@pytest.mark.parametrize("tokens", [1 << 20, 200])
def test_token_files_round_trip(spark, monkeypatch, tokens):
    monkeypatch.setattr(dac, "BLOCK_TOKENS", tokens)
    rows, df = documents(spark)
    path = public_tokenizers.path(FILES[False])
    files = dac.token_files(df, "t", path, False, 2)
    got = [tuple(r) for r in dac.read_documents(files).orderBy("start").collect()]
    ids = ids_by_force(False, [t for _, t in rows], 2)
    want = Counter((d, len(x), crc(x)) for (d, _), x in zip(rows, ids))
    assert Counter((d, n, c) for d, _, n, c in got) == want
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda d: -1 if d is None else d)

    own = {d: x for (d, _), x in zip(rows, ids) if Counter(d for d, _ in rows)[d] == 1 and d is not None}
    asked = [(d, at) for d, x in own.items() for at in {0, len(x) - 1, len(x) // 2, len(x)}]
    found = dac.tokens_at(files, spark.createDataFrame(asked, "doc_id long, at long")).collect()
    assert sorted(map(tuple, found)) == sorted((d, at, own[d][at]) for d, at in asked if at < len(own[d]))


def test_piece_lengths():
    for n in [*range(1, 700), 2047, 2048, 2049, 5000]:
        cut = packing.piece_lengths(n, 2048, 0.03, 48)
        assert sum(cut) == n and all(0 < x <= 2048 for x in cut)


def test_rests_share_sequences():
    totals = {3: 1000, 4: 900, 7: 1048, 9: 100, 11: 1200}
    bins = packing.first_fit(totals, 2048)
    assert sorted(set(bins.values())) == list(range(max(bins.values()) + 1)) and packing.first_fit({}, 2048) == {}
    assert max(sum(totals[k] for k in totals if bins[k] == b) for b in bins.values()) <= 2048 and max(bins.values()) == 2


def test_packing(spark):
    rows, df = documents(spark)
    out = packing.pack(df, public_tokenizers.path(FILES[True]), True, 1, with_ids=True).collect()
    ids = ids_by_force(True, [t for _, t in rows], 1)
    pieces = defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
    copies = Counter(d for d, _ in rows)
    for (d, _), x in zip(rows, ids):
        if copies[d] == 1:
            own = sorted(pieces[d], key=lambda r: r["start"])
            assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == x
            assert [r["start"] for r in own] == np.concatenate([[0], np.cumsum([r["length"] for r in own])[:-1]]).tolist()
            assert {r["doc_tokens"] for r in own} == {len(x)}
    assert sum(r["length"] for r in out) == sum(map(len, ids))
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.concatenate([[0], np.cumsum([n for _, n in s])[:-1]]).tolist()
        assert sum(n for _, n in s) <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(map(len, ids)) > 0.9 * 2048 * len(sequences)


def test_shards_are_exact_and_gapless(spark):
    rnd = random.Random(1)
    rows, _ = documents(spark)
    rows += [(100 + i, words(rnd, 5) if i % 3 else "hot") for i in range(1000)]
    df = frame(spark, rows)
    got = sharding.shard_rows(df, 24).collect()
    facts = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, *facts(t)) for d, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    counts = [len(shards[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert Counter(map(tuple, sharding.shard_rows(df, 24).collect())) == Counter(map(tuple, got))
    other = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_rows(df, 24, seed=7).collect()}
    assert sum(other[r["doc_id"], r["text_crc32"]] == r["shard"] for r in got) < 0.15 * len(got)


def test_hypergeometric_draws():
    rng = random.Random(3)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert 0 <= sharding.hypergeometric(rng, 10**9, 10**10, 10**8) <= 10**8
    matrix = sharding.communication_matrix({0: 10, 1: 0, 5: 91}, 24, 1)
    columns = np.array(list(matrix.values())).sum(axis=0)
    assert [sum(r) for r in matrix.values()] == [10, 0, 91] and columns.max() - columns.min() == 1


def test_empty_tables(spark):
    assert dac.read_documents(dac.token_files(empty(spark), "t", public_tokenizers.path(FILES[False]), False, 2)).collect() == []
    assert packing.pack(empty(spark), public_tokenizers.path(FILES[True]), True, 1).collect() == []
    assert sharding.shard_rows(empty(spark)).collect() == []
