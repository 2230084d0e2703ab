"""Operator 4, SimHash near-dedup: bit-sliced comparison of 64-bit fingerprints within shared-block buckets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import join_groups, parts, staged
from litgraph.llm.components import components
from litgraph.llm.tokens import in_groups

BLOCK = 1024  # fingerprints of a bucket that meet in one task; larger buckets are dealt to pairs of such blocks
SLICE = 1 << 16  # shingles that are hashed at once
CHARS = 500_000  # characters of texts whose shingles a task holds at once


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a whole text: XXH64, one vote a shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = max(len(words) - width + 1, 1 if words else 0)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        some = words[at:at + SLICE + width - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(some[i:i + width]), seed) for i in range(min(SLICE, n - at))]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of all sets of blocks of which at least one is equal in any two fingerprints within the radius."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(single[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def sliced_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j < ends[i], j >= starts[i], of ``fps`` within the radius, by bit planes.

    Plane b holds bit b of 64 fingerprints a word. A row of work is (query i, word w): three bitwise counters sum the
    64 distances of the word side by side, a fourth notes those that passed the radius (7 at most); rows of which no
    distance is left within it are abandoned after every eighth plane.
    """
    n = len(fps)
    n_words = (n + 63) // 64
    padded = np.zeros(n_words * 64, np.uint64)
    padded[:n] = fps
    grid = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(grid.T, axis=1, bitorder="little").copy().view(np.uint64)  # 64 x n_words
    flags = grid[:n].T.astype(bool)
    first, last = np.arange(n) // 64, (ends - 1) // 64
    count = np.where(ends > starts, last - first + 1, 0)
    query = np.repeat(np.arange(n), count)
    word = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.maximum(np.maximum(starts[query], query + 1) - 64 * word, 0)
    high = np.minimum(ends[query] - 64 * word, 64)
    upto = lambda k: np.where(k >= 64, ones, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
    alive = np.where(high > low, upto(high) & ~upto(low), np.uint64(0))
    c1 = c2 = c4 = np.zeros(len(query), np.uint64)
    for b in range(64):
        if b % 8 == 0:
            going = alive != 0
            if not going.all():
                query, word, alive, c1, c2, c4 = (x[going] for x in (query, word, alive, c1, c2, c4))
            if not len(query):
                break
        differs = planes[b, word] ^ np.where(flags[b, query], ones, np.uint64(0))
        carry1 = c1 & differs
        c1 = c1 ^ differs
        carry2 = c2 & carry1
        c2 = c2 ^ carry1
        alive = alive & ~(c4 & carry2)  # eight or more
        c4 = c4 ^ carry2
        above = np.zeros(len(query), np.uint64)  # counter > radius, from the high bit down
        equal = np.full(len(query), ones)
        for c, r in ((c4, radius & 4), (c2, radius & 2), (c1, radius & 1)):
            if r:
                equal = equal & c
            else:
                above |= equal & c
                equal = equal & ~c
        alive = alive & ~above
    if not len(query):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    going = alive != 0
    query, word, alive = query[going], word[going], alive[going]
    hits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(hits)
    return query[row], word[row] * 64 + bit


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of ``n`` indices reaches over the pairs."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        while not np.array_equal(new, again := new[new]):
            new = again
        if np.array_equal(new, root):
            return root
        root = new
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _linker(masks: list[int], radius: int, rows_at_once: int = 1 << 15):
    """For partitions sorted by (table, masked fingerprint, block pair): edges that span each bucket's components."""
    mask = np.array(masks, np.uint64)

    def links(t: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        key = fp & mask[t]
        new = np.ones(len(fp), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        many = np.repeat(size > 1, size)
        fp, starts, ends = fp[many], None, None
        size = size[size > 1]
        ends = np.repeat(np.cumsum(size), size)
        starts = ends - np.repeat(size, size)
        a, b = [], []
        if len(fp):
            i, j = sliced_links(fp, starts, ends, radius)
            root = stars(len(fp), i, j)
            away = np.flatnonzero(root != np.arange(len(fp)))
            a, b = fp[root[away]].view(np.int64), fp[away].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            got = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            held = [np.concatenate([*held, got], axis=1)]
            if held[0].shape[1] >= rows_at_once:
                t, pair, fp = held[0]
                fp = fp.view(np.uint64)
                key = fp & mask[t]
                last = np.flatnonzero((t != t[-1]) | (key != key[-1]) | (pair != pair[-1]))
                if len(last):  # all buckets but the last one are whole
                    cut = last[-1] + 1
                    yield links(t[:cut], pair[:cut], fp[:cut])
                    held = [held[0][:, cut:]]
        if held and held[0].shape[1]:
            t, pair, fp = held[0]
            yield links(t, pair, fp.view(np.uint64))
    return run


def near_links(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all fingerprints linked within the radius.

    Two fingerprints within the radius agree on ``blocks - radius`` of the blocks, so they share the bucket of that
    choice. A bucket over BLOCK fingerprints is dealt to blocks, and each pair of blocks meets in a group of its own.
    """
    masks = block_masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m).cast("long") for m in signed]), F.col("t") + 1))
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
    large = rows.groupBy("t", key.alias("key")).count().filter(F.col("count") > BLOCK).select(
        "t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    rows = rows.withColumn("key", key).join(large, ["t", "key"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n").cast("long")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.least(o, own).cast("long") * F.col("n") + F.greatest(o, own))
    rows = rows.select("t", F.explode(F.coalesce(meets, F.array(F.lit(0).cast("long")))).alias("pair"), "fp", "key")
    dealt = rows.repartition(parts(fps.sparkSession), "t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    return dealt.select("t", "pair", "fp").mapInArrow(_linker(masks, radius), "a bigint, b bigint")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 3,
    blocks: int = 5,
) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id (least id that links reach).

    Fingerprints within ``radius`` (6 at most) bits are linked; no pair is dropped, whatever the size of its bucket.
    ``blocks`` sets the number of bucket tables and so their keys' length. Equal fingerprints are one node. Null text
    counts as empty and has fingerprint zero. Null ids are grouped like others, but are least of no group unless it
    has no other id. Repeated rows are returned each. Empty input gives no rows; other columns are ignored.
    """
    if not 0 <= radius <= 6 or blocks <= radius:
        raise ValueError("radius must be 0 to 6 and blocks larger than it")
    rows = staged(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    total = rows.count()
    roots = components(near_links(nodes, radius, blocks))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    nodes = join_groups(nodes, named, ["root"], "size", total, F.col("fp")).select("fp", "component_id", "n")
    hex_of: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_groups(rows, nodes, ["fp"], "n", total, F.col("id")).select(
        F.col("id").alias(id_col), hex_of.alias("fingerprint"), "component_id")


# Fingerprints of shingle sets, for a stated similarity

WORDS = 4  # 64-bit words of a long fingerprint
RADIUS = 50  # of its 256 bits; sets of similarity 0.8 differ in 38.8 bits, give or take 5.7
DIFFER = float(np.arccos(2 * 0.8 / 1.8) / np.pi)  # share of bits in which they differ
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles of ``width`` words, sorted, and where each text's begin.

    Words are lower-cased and split at white space; a text of fewer words is one shingle, an empty one has none.
    """
    stripped = [(t or "").strip() for t in texts]
    split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(stripped, pa.large_string())))
    coded = split.flatten().dictionary_encode()
    names = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = names[coded.indices.to_numpy()]
    bounds = split.offsets.to_numpy()
    many = np.where([bool(t) for t in stripped], np.diff(bounds), 0)
    count = np.where(many > 0, np.maximum(many - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(many)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][owner]
    stop = bounds[:-1][owner] + many[owner]
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        own = np.where(at + j < stop, word[np.minimum(at + j, len(word) - 1)], np.uint64(1))
        total = (total ^ own) * MIXERS[0]
        total ^= total >> np.uint64(29)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    return total[new], np.searchsorted(owner[new], np.arange(len(many) + 1))


def long_fingerprints(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """WORDS x 64 bits of each set, a bit being set if it is in over half of the set's mixed hashes."""
    votes = np.zeros((len(bounds) - 1, 64 * WORDS), np.int64)
    sizes = np.diff(bounds)
    for a in range(0, len(shingles), SLICE):
        some = shingles[a:a + SLICE]
        mixed = some[:, None] * MIXERS[None, :]
        mixed ^= mixed >> np.uint64(31)
        mixed *= MIXERS[None, ::-1]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        owner = np.searchsorted(bounds, np.arange(a, a + len(some)), "right") - 1
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        votes[owner[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view(np.uint64)


def table_keys(n: int, recall: float = 0.97) -> np.ndarray:
    """Bits of a long fingerprint that each table's key takes, for ``n`` sets: as many as tell most sets apart, and so
    many tables that a pair of similarity 0.8 shares a key with the probability ``recall``."""
    bits = min(max(int(np.ceil(np.log2(max(n, 2)))) - 2, 12), 32)
    tables = int(np.ceil(np.log(1 - recall) / np.log1p(-(1 - DIFFER) ** bits)))
    rng = np.random.default_rng(64)
    return np.array([rng.choice(64 * WORDS, bits, replace=False) for _ in range(tables)])


def sliced_distances(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, distance), i < j < ends[i], j >= starts[i], of long fingerprints within the radius, by bit planes.

    As ``sliced_links``, with as many carry-save counters as the radius needs; words of which no distance is left within
    it are abandoned after every sixteenth plane.
    """
    n = len(fps)
    n_words = (n + 63) // 64
    padded = np.zeros((n_words * 64, fps.shape[1]), np.uint64)
    padded[:n] = fps
    grid = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    planes = np.packbits(grid.T, axis=1, bitorder="little").copy().view(np.uint64)
    flags = grid[:n].T.astype(bool)
    first, last = np.arange(n) // 64, (ends - 1) // 64
    count = np.where(ends > starts, last - first + 1, 0)
    query = np.repeat(np.arange(n), count)
    word = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.maximum(np.maximum(starts[query], query + 1) - 64 * word, 0)
    high = np.minimum(ends[query] - 64 * word, 64)
    upto = lambda k: np.where(k >= 64, ones, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
    alive = np.where(high > low, upto(high) & ~upto(low), np.uint64(0))
    counters = [np.zeros(len(query), np.uint64) for _ in range(int(radius + 16).bit_length())]
    for b in range(len(planes)):
        carry = planes[b, word] ^ np.where(flags[b, query], ones, np.uint64(0))
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        if b % 16 == 15:
            above, equal = np.zeros(len(query), np.uint64), np.full(len(query), ones)
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            alive = alive & ~above
            going = alive != 0
            if not going.all():
                query, word, alive, *counters = (x[going] for x in (query, word, alive, *counters))
            if not len(query):
                break
    spread = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(spread(alive)) if len(query) else (np.zeros(0, np.int64),) * 2
    distance = sum((spread(c)[row, bit].astype(np.int64) << k for k, c in enumerate(counters)), np.zeros(len(row), np.int64))
    return query[row], word[row] * 64 + bit, distance


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of a minimum spanning forest: each tree takes its nearest pair that leads out, and again."""
    root, chosen = np.arange(n), []
    order = np.lexsort((j, i, distance))
    while len(order):
        a, b = root[i[order]], root[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        best = np.full(n, len(order))
        place = np.arange(len(order))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        own = np.unique(best[best < len(order)])
        if not len(own):
            break
        chosen.append(order[own])
        root = stars(n, np.concatenate([np.arange(n), a[own]]), np.concatenate([root, b[own]]))
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _tables(keys: np.ndarray):
    """(node, f0 to f3) to a row for each table: t, key, node, f0 to f3."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                fps = np.stack([batch.column(1 + w).to_numpy() for w in range(WORDS)], axis=1)
                bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
                for t, places in enumerate(keys):
                    key = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), t), pa.int32()), pa.array(key), *batch.columns], ["t", "key", "node", *(f"f{w}" for w in range(WORDS))])
    return run


def _buckets(batches: Iterator[pa.RecordBatch], rows_at_once: int = 1 << 14) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole buckets, from a partition sorted by (t, key, pair)."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {f: batch.column(n).to_numpy(zero_copy_only=False) for n, f in enumerate(batch.schema.names)}
        held = now if held is None else {k: np.concatenate([held[k], v]) for k, v in now.items()}
        if len(held["t"]) >= rows_at_once:
            last = np.flatnonzero((held["t"] != held["t"][-1]) | (held["key"] != held["key"][-1]) | (held["pair"] != held["pair"][-1]))
            if len(last):  # all buckets but the last one are whole
                yield {k: v[:last[-1] + 1] for k, v in held.items()}
                held = {k: v[last[-1] + 1:] for k, v in held.items()}
    if held is not None and len(held["t"]):
        yield held


def _candidates(x: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(many, i, j, distance): rows of buckets of two or more, and the pairs within the radius as numbers of those rows."""
    new = np.ones(len(x["t"]), bool)
    new[1:] = (x["t"][1:] != x["t"][:-1]) | (x["key"][1:] != x["key"][:-1]) | (x["pair"][1:] != x["pair"][:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    many = np.flatnonzero(np.repeat(size > 1, size))
    size = size[size > 1]
    if not len(many):
        return many, many, many, many
    ends = np.repeat(np.cumsum(size), size)
    fps = np.stack([x[f"f{w}"][many] for w in range(WORDS)], axis=1).view(np.uint64)
    return many, *sliced_distances(fps, ends - np.repeat(size, size), ends, radius)


def _neighbours(radius: int):
    """For partitions sorted by (t, key, pair): the pairs (a, b, distance) of each bucket's minimum spanning forest.

    Members of other pairs within the radius follow as rows with ``b`` null, with their bucket and fingerprint.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _buckets(batches):
            many, i, j, apart = _candidates(x, radius)
            kept = nearest_forest(len(many), i, j, apart)
            rest = np.ones(len(i), bool)
            rest[kept] = False
            open_ = many[np.unique(np.concatenate([i[rest], j[rest]]))]
            a, b = x["node"][many[i[kept]]], x["node"][many[j[kept]]]
            rows = len(a) + len(open_)
            only = lambda v, kind: pa.concat_arrays([pa.nulls(len(a), kind), pa.array(v[open_], kind)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([*a, *x["node"][open_]], pa.binary()), pa.array([*b, *[None] * len(open_)], pa.binary()),
                 pa.array(np.append(apart[kept], np.zeros(rows - len(a), np.int64)), pa.int32()),
                 only(x["t"], pa.int32()), *(only(x[f], pa.int64()) for f in ("key", "pair", *(f"f{w}" for w in range(WORDS))))],
                ["a", "b", "distance", "t", "key", "pair", *(f"f{w}" for w in range(WORDS))])
    return run


def _crossing(radius: int):
    """For partitions sorted by (t, key, pair): all pairs (a, b) within the radius whose roots differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _buckets(batches):
            many, i, j, _ = _candidates(x, radius)
            i, j = many[i], many[j]
            apart = x["root"][i] != x["root"][j]
            i, j = i[apart], j[apart]
            for at in range(0, len(i), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(x["node"][n[at:at + SLICE]], pa.binary()) for n in (i, j)], ["a", "b"])
    return run


def _near_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Rows of ``_neighbours`` over nodes that share a table's key and differ in ``radius`` bits at most; see ``similar_groups``."""
    keys = table_keys(nodes.count())
    fields = [f"f{w}" for w in range(WORDS)]
    rows = nodes.select("node", *fields).mapInArrow(_tables(keys), "t int, key bigint, node binary, " + ", ".join(f"{f} bigint" for f in fields))
    rows = staged(rows, "tables")
    large = rows.groupBy("t", "key").count().filter(F.col("count") > BLOCK).select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    rows = rows.join(large, ["t", "key"], "left")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n").cast("long")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.least(o, own).cast("long") * F.col("n") + F.greatest(o, own))
    rows = rows.withColumn("pair", F.explode(F.coalesce(meets, F.array(F.lit(0).cast("long")))))
    order = ("t", "key", "pair")
    dealt = rows.select(*order, "node", *fields).repartition(parts(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_neighbours(radius), "a binary, b binary, distance int, t int, key bigint, pair bigint, " + ", ".join(f"{f} bigint" for f in fields))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS,
) -> DataFrame:
    """One row per input row: ``id_col``, node, component_id (least id that links reach), leads (the row stands for its group), h, h2.

    Links are pairs of texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.
    Candidates share a table's key of their long fingerprints (see ``table_keys``) and differ in ``radius`` bits at most;
    at 0.8 that finds some 94 of 100 pairs, more above. Within a bucket a minimum spanning forest by distance goes on
    first, not all pairs, so a group of copies gives about as many rows as it has members; buckets over BLOCK are dealt to
    pairs of blocks. Candidates are then checked on the shingle sets themselves: first each text's nearest one, then
    those that would join groups that are still apart, last all pairs that the forests left out and whose ends are still
    apart, so no candidate that links two groups is lost.

    Texts with the same first two words of the fingerprint are one node. Null texts are empty, and all empty texts are
    alike. A group's least row by id, then by text hash, leads; rows that repeat both lead alike. Null ids come last.
    h and h2 are hashes of the text, by which rows of one id are told apart.
    Empty input gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    kind = rows.schema["id"].dataType.simpleString()
    fields = [f"f{w}" for w in range(WORDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_groups(texts, CHARS):
                fps = long_fingerprints(*shingle_sets(texts[a:b], width)).view(np.int64)
                node = [f.tobytes() for f in fps[:, :2]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), pa.array(node, pa.binary()),
                     *(pa.array(fps[:, w]) for w in range(WORDS))], ["id", "h", "h2", "node", *fields])
    sketches = staged(rows.mapInArrow(sketch, f"id {kind}, h bigint, h2 bigint, node binary, " + ", ".join(f"{f} bigint" for f in fields)), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h", "h2", *fields)).alias("least")
    nodes = staged(sketches.groupBy("node").agg(least, F.count("*").alias("n")).select("node", "n", "least.*"), "nodes")
    near = staged(_near_pairs(nodes, radius), "near")
    ordered = lambda found: found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in found.columns if c == "distance"])
    pairs = staged(ordered(near.filter(F.col("b").isNotNull()).select("a", "b", "distance")).distinct(), "pairs")
    members = near.filter(F.col("b").isNull()).select("t", "key", "pair", F.col("a").alias("node"), *fields)

    # the shingle sets of texts in pairs, one text a node; every member of a pair is in some pair of the forest
    paired = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    picked = nodes.join(paired, "node", "left_semi").select("node", "id", "h", "h2")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_groups(texts, CHARS):
                shingles, bounds = shingle_sets(texts[a:b], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64)))], ["node", "shingles"])
    same = (rows["id"].eqNullSafe(picked["id"])) & (rows["h"] == picked["h"]) & (rows["h2"] == picked["h2"])
    texts = rows.join(picked, same).select("node", "text").dropDuplicates(["node"])
    shingles = staged(texts.mapInArrow(sets, "node binary, shingles array<bigint>"), "shingles")

    def checked(some: DataFrame) -> DataFrame:
        met = some.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
            shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return met.filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b", "distance"), F.struct(F.col("b").alias("node"), "a", "b", "distance"))).alias("e")).select("e.*")
    nearest = ends.groupBy("node").agg(F.min(F.struct("distance", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
    links = staged(checked(nearest), "links")
    roots = staged(components(links), "roots")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    left = pairs.join(nearest, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = left.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    links = staged(links.unionByName(checked(apart)), "forest-links")
    roots = staged(components(links), "forest-roots")

    # pairs that a forest left out matter if their ends are still apart
    order = ("t", "key", "pair")
    placed = members.join(root("node"), "node", "left").withColumn("root", F.coalesce("node_root", "node")).drop("node_root")
    mixed = placed.groupBy(*order).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select(*order)
    dealt = placed.join(mixed, list(order), "left_semi").repartition(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    rest = ordered(dealt.mapInArrow(_crossing(radius), "a binary, b binary")).distinct().join(pairs, ["a", "b"], "left_anti")
    roots = components(staged(links.unionByName(checked(rest)), "all-links"))

    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct("z", "id", "h", "h2", "node")).alias("first")
    named = nodes.groupBy("root").agg(first, F.count("*").alias("size"))
    total = sketches.count()
    nodes = join_groups(nodes.select("root", "node", "n"), named, ["root"], "size", total, F.col("node")).select("node", "n", "first")
    met = join_groups(sketches.select("id", "h", "h2", "node"), nodes, ["node"], "n", total, F.col("id"))
    leads = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("h2") == F.col("first.h2")) & (F.col("node") == F.col("first.node"))
    return met.select(F.col("id").alias(id_col), "node", F.col("first.id").alias("component_id"), leads.alias("leads"), "h", "h2")
