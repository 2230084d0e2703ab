"""Operator 2, suffix-array dedup: removes bytes of strings of a least length that also start anywhere else.

Windows of that length are grouped by content first, so that no task needs the whole corpus; inside a group a
positional Burrows-Wheeler transform is extended backwards, breadth first, until the least length is reached.

1. Every window has one anchor, its least 32-byte gram (leftmost of equals). Equal windows have equal anchors at equal
   places, so they can only meet in windows of the same anchor. Windows of one anchor are cut, by their distance to it,
   into pieces of at most WIDTHS[0] windows that all hold a common core.
2. Pieces meet by core, in one order over all of them, so pieces of a common core spread over many tasks. A piece whose
   whole text repeats is covered. One whose core is alone is not. The others go on.
3. In a group of one core, a piece is left bytes, core, right bytes. Suffixes are sorted by their right bytes; with the
   core as one symbol their common prefixes have at least the core's length. Each round puts one more left byte in
   front: an interval of suffixes is split by the byte before it, as a backward search step on the transform does, and
   all common prefixes grow by one. Intervals of one suffix are abandoned. A window is repeated if a neighbour of its
   interval shares enough of its right bytes, so the search ends at the least length.
4. Groups over GROUP pieces do not fit a task's memory. They are split by longer common prefixes: each piece is cut into
   pieces of fewer windows, whose cores take in more bytes of both sides, and the same search goes on in the smaller
   groups. At one window there is nothing left to extend: all pieces of a group are equal strings.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.llm.common import discard, parts, staged, text_of

GRAM = 32
WIDTHS = (128, 16, 2, 1)
GROUP = 4096  # pieces that one task extends together
SLICE = 1 << 22  # window starts of one text at once; places fit into 24 bits
CHUNK = 1 << 23  # bytes of text among which a task combines equal pieces before they shuffle


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = (h[:-step] * np.uint64(0xD6E8FEB86659FD93)) ^ h[step:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    return h


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """The anchor's place of each window."""
    places = np.uint64((1 << 24) - 1)
    least = (_gram_hashes(data) & ~places)
    least |= np.arange(len(least), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if rest := width - step:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & places).astype(np.int64)


def pieces_of(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(core, whole, whole2, first, last, place): hashes, first and last window and the core's place of each piece."""
    width, found = WIDTHS[0], []
    for at in range(0, len(text) - length + 1, SLICE):
        own = text[at:at + SLICE + length - 1]
        anchor = _anchors(np.frombuffer(own, np.uint8), length)
        window = np.arange(len(anchor))
        band = (anchor - window) // width
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(band, prepend=-1) != 0))
        last = np.append(new[1:], len(anchor)) - 1
        place = anchor[new] - band[new] * width
        hold = length - width + 1
        core = [xxhash.xxh64_intdigest(own[p:p + hold], b) for p, b in zip(place.tolist(), band[new].tolist())]
        whole = b"".join([xxhash.xxh3_128_digest(own[a:z + length], p - a) for a, z, p in zip(new.tolist(), last.tolist(), place.tolist())])
        whole = np.frombuffer(whole, np.int64).reshape(-1, 2)
        found.append((np.array(core, np.uint64).view(np.int64), whole[:, 0], whole[:, 1], new + at, last + at, place + at))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found))


ROW = "core bigint, whole bigint, whole2 bigint, many boolean, row bigint, row2 bigint, first int, last int, place int"
NAMES = ("core", "whole", "whole2", "many", "row", "row2", "first", "last", "place")


def _rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"many": pa.bool_(), "first": pa.int32(), "last": pa.int32(), "place": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c]).cast(kinds.get(c, pa.int64())) for c in NAMES], list(NAMES))


def _scan(length: int):
    """(row, text) to pieces. Equal pieces of a chunk become one row marked ``many``; each is covered (place -1)."""
    def joined(rows: list[tuple]) -> pa.RecordBatch:
        x = dict(zip(("core", "whole", "whole2", "first", "last", "place", "row", "row2"), (np.concatenate(c) for c in zip(*rows))))
        n = len(x["core"])
        order = np.lexsort((x["whole2"], x["whole"], x["core"]))
        same = np.zeros(n + 1, bool)
        same[1:-1] = np.logical_and.reduce([x[k][order][1:] == x[k][order][:-1] for k in ("core", "whole", "whole2")])
        many = np.zeros(n, bool)
        many[order] = same[1:] | same[:-1]
        lead = np.zeros(n, bool)
        lead[order] = ~same[:-1]
        sent = {k: v[lead] for k, v in x.items()} | {"many": many[lead]}
        # windows of neighbouring covered pieces of a row become one
        c = {k: x[k][many] for k in ("row", "row2", "first", "last")}
        new = np.ones(len(c["row"]), bool)
        new[1:] = (c["row"][1:] != c["row"][:-1]) | (c["row2"][1:] != c["row2"][:-1]) | (c["first"][1:] != c["last"][:-1] + 1)
        ends = np.append(new[1:], True)[:len(new)]
        nothing = np.zeros(int(new.sum()), np.int64)
        covered = {k: c[k][new] for k in ("row", "row2", "first")} | {
            "core": c["row"][new], "whole": nothing, "whole2": nothing, "many": nothing == 0, "last": c["last"][ends], "place": nothing - 1}
        return _rows({k: np.concatenate([sent[k], covered[k]]) for k in NAMES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, row2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                if len(raw) >= length:
                    found = pieces_of(raw, length)
                    n = len(found[0])
                    held.append((*found, np.full(n, row), np.full(n, row2)))
                    size += len(raw)
                if size >= CHUNK:
                    yield joined(held)
                    held, size = [], 0
        if held:
            yield joined(held)
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of (core, whole): covered windows (place -1), and one piece of each whole whose core has others.

    The first and the last piece of a task are sent on in any case, as their core may go on in another task.
    """
    def judged(x: dict[str, np.ndarray], begins: bool, ends: bool) -> pa.RecordBatch:
        n = len(x["core"])
        core = x["core"][1:] == x["core"][:-1]
        whole = core & (x["whole"][1:] == x["whole"][:-1]) & (x["whole2"][1:] == x["whole2"][:-1])
        repeated = np.append(False, whole) | np.append(whole, False)
        other = np.append(begins, core & ~whole) | np.append(core & ~whole, ends)
        settled = x["place"] < 0
        own = np.arange(0 if begins else 1, n if ends else n - 1)
        covered = own[(settled | (repeated & ~x["many"]))[own]]
        asked = own[(~settled & other)[own]]
        pick = np.concatenate([covered, asked])
        place = x["place"][pick].copy()
        place[:len(covered)] = -1
        return _rows({k: v[pick] for k, v in x.items()} | {"place": place, "many": (x["many"] | repeated)[pick]})

    held, begins = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names)}
        held = now if held is None else {k: np.concatenate([held[k], v]) for k, v in now.items()}
        if len(held["core"]) > 2:
            yield judged(held, begins, False)
            held, begins = {k: v[-2:] for k, v in held.items()}, False
    if held is not None:
        yield judged(held, begins, True)


FLANKS = "core binary, many boolean, row bigint, row2 bigint, place int, least int, most int, left binary, right binary"
"""``least`` and ``most``: bytes before the core of the shortest and the longest reach to the left of the windows."""
RUN = "row bigint, row2 bigint, first int, last int"


def _cut_flanks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = length - WIDTHS[0] + 1
        for batch in batches:
            out = []
            for row, row2, text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for a in asks:
                    at = a["place"]
                    core = xxhash.xxh3_128_digest(raw[at:at + hold]) + a["core"].to_bytes(8, "little", signed=True)
                    out.append((core, a["many"], row, row2, at, at - a["last"], at - a["first"], raw[a["first"]:at], raw[at + hold:a["last"] + length]))
            yield _flank_batch(out)
    return run


def _flank_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ("core", "many", "row", "row2", "place", "least", "most", "left", "right")
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


def _narrow(width: int, to: int):
    """Cuts pieces of ``width`` windows into pieces of ``to`` windows, whose cores take in bytes of both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = r["left"], r["right"]
                for band in range(r["least"] // to, r["most"] // to + 1):
                    least, most = max(r["least"], band * to), min(r["most"], band * to + to - 1)
                    inner, beyond = band * to, width - to - band * to  # bytes of either side that join the core
                    mid = len(left) - inner
                    key = xxhash.xxh3_128_digest(r["core"] + left[mid:] + right[:beyond], band)
                    out.append((key, r["many"], r["row"], r["row2"], r["place"] - inner, least - inner, most - inner,
                                left[mid - (most - inner):mid], right[beyond:width - 1 - least]))
            yield _flank_batch(out)
    return run


def expand(group: np.ndarray, left: list[bytes], right: list[bytes], width: int) -> np.ndarray:
    """covered[piece, k]: whether the window with k bytes before the core also occurs in another piece of the group.

    The breadth-first backward extension. ``group`` is sorted. ``floor`` answers common prefixes of right bytes between
    any two suffixes by minima over the sorted order.
    """
    n = len(group)
    covered = np.zeros((n, width), bool)
    rights = np.zeros((n, 8 + width), np.uint8)
    rights[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
    lefts = np.zeros((n, width), np.uint8)  # column k: k-th byte before the core
    left_len, right_len = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for i in range(n):
        rights[i, 8:8 + right_len[i]] = np.frombuffer(right[i], np.uint8)
        lefts[i, 1:left_len[i] + 1] = np.frombuffer(left[i], np.uint8)[::-1]
    order = np.lexsort((right_len, rights.view(f"S{8 + width}").ravel()))
    r, l = rights[order, 8:], right_len[order]
    differs = r[1:] != r[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(l[1:], l[:-1]))
    common = np.where(group[order][1:] == group[order][:-1], common, -1)
    floor = [np.append(-1, common)]
    while 2 ** len(floor) <= n:
        half = 2 ** (len(floor) - 1)
        floor.append(np.minimum(floor[-1][:-half], floor[-1][half:]))
    rank = np.arange(n)  # of the suffixes that are still looked at, in the order of their interval
    interval = np.concatenate([[0], np.cumsum(common < 0)])
    for k in range(width):
        if k:
            going = left_len[order[rank]] >= k
            rank, interval = rank[going], interval[going]
            step = np.argsort(interval * 256 + lefts[order[rank], k], kind="stable")  # the byte before each suffix
            rank, key = rank[step], (interval * 256 + lefts[order[rank], k])[step]
            interval = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else interval
        same = interval[1:] == interval[:-1]
        alone = ~(np.append(False, same) | np.append(same, False))[:len(rank)]
        if alone.any():
            rank, interval = rank[~alone], interval[~alone]
            same = interval[1:] == interval[:-1]
        if not len(rank):
            break
        a, b = rank[:-1] + 1, rank[1:]
        span = np.where(same, b - a + 1, 1)
        level = np.frexp(span)[1] - 1
        shared = np.full(len(span), -1)
        for v in np.unique(level[same]):
            at = np.flatnonzero(same & (level == v))
            shared[at] = np.minimum(floor[v][a[at]], floor[v][b[at] - (1 << v) + 1])
        enough = same & (shared >= width - 1 - k)
        covered[order[rank[:-1][enough]], k] = True
        covered[order[rank[1:][enough]], k] = True
    return covered


def _search(width: int, rows_at_once: int = 20_000):
    """Flanks sorted by core to covered windows (row, first, last)."""
    def found(x: dict[str, list]) -> pa.RecordBatch:
        group = np.cumsum([0, *(a != b for a, b in zip(x["core"][1:], x["core"]))])
        covered = expand(group, x["left"], x["right"], width)
        covered &= ~np.array(x["many"], bool)[:, None]  # these are covered already
        edge = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        piece, begin = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        place = np.array(x["place"], np.int64)[piece]
        columns = [np.array(x[k], np.int64)[piece] for k in ("row", "row2")] + [place - stop + 1, place - begin]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], ["row", "row2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("core", "many", "row", "row2", "place", "left", "right")
        held = {k: [] for k in names}
        for batch in batches:
            for k in names:
                held[k] += batch.column(batch.schema.get_field_index(k)).to_pylist()
            if len(held["core"]) >= rows_at_once:
                cut = len(held["core"])
                while cut and held["core"][cut - 1] == held["core"][-1]:
                    cut -= 1
                if cut:
                    yield found({k: v[:cut] for k, v in held.items()})
                    held = {k: v[cut:] for k, v in held.items()}
        if held["core"]:
            yield found(held)
    return run


def _free(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished steps, which it does once their plans are garbage."""
    gc.collect()
    spark._jvm.System.gc()


def covered_windows(rows: DataFrame, length: int) -> DataFrame:
    """(row, row2, first, last): runs of window starts of ``rows`` (row, row2, text as binary) whose strings start elsewhere too."""
    if length < 2 * WIDTHS[0]:
        raise ValueError(f"length must be at least {2 * WIDTHS[0]}")
    spark = rows.sparkSession
    n = parts(spark)
    pieces = staged(rows.mapInArrow(_scan(length), ROW), "pieces")
    order = ("core", "whole", "whole2")
    met = staged(pieces.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_meet, ROW), "met")
    discard(pieces)
    _free(spark)
    results = [met.filter("place < 0").select("row", "row2", "first", "last")]
    asks = met.filter("place >= 0").groupBy("row", "row2").agg(  # of one text's pieces; rows that repeat it add none
        F.collect_set(F.struct("core", "many", "first", "last", "place")).alias("asks"))
    flanks = staged(rows.join(asks, ["row", "row2"]).select("row", "row2", "text", "asks").mapInArrow(_cut_flanks(length), FLANKS), "flanks")
    _free(spark)
    for width, narrower in zip(WIDTHS, [*WIDTHS[1:], 0]):
        sizes = staged(flanks.groupBy("core").count().filter("count > 1"), "group-sizes")
        if width == 1:
            results.append(flanks.filter("NOT many").join(sizes, "core", "left_semi").select("row", "row2", F.col("place").alias("first"), F.col("place").alias("last")))
            break
        small, large = sizes.filter(F.col("count") <= GROUP), sizes.filter(F.col("count") > GROUP)
        results.append(flanks.join(small, "core", "left_semi").repartition(n, "core").sortWithinPartitions("core").mapInArrow(_search(width), RUN))
        if not large.take(1):
            break
        flanks = staged(flanks.join(large, "core", "left_semi").mapInArrow(_narrow(width, narrower), FLANKS), "flanks")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                spans: list[list[int]] = []
                for r in sorted(runs or [], key=lambda r: r["first"]):
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["last"] + length)
                    else:
                        spans.append([r["first"], r["last"] + length])
                edges = [0, *(e for s in spans for e in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(kept), [{"start": a, "stop": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest()))
            n, removed, spans, kept, sha = zip(*out) if out else ([],) * 5
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()),
                 pa.array(sha, pa.string())], ["id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, spans (start, stop of each removed run), kept (bytes), kept_sha256.

    Each byte is removed that is covered by a string of ``length`` bytes which also starts anywhere else, in the same
    document or another one; matches never cross documents and are judged on the whole input. Cores and whole pieces are
    compared by 128-bit hashes, the bytes next to a core one by one.

    Null text is empty; texts under ``length`` bytes stay whole. Rows that repeat id and text cover each other. Empty
    input gives no rows; other columns are ignored. ``length`` is 256 at least.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    rows = rows.withColumns({"row": F.xxhash64("id", "text"), "row2": F.xxhash64(F.lit(length), "text", "id")})
    covered = staged(covered_windows(rows.select("row", "row2", "text"), length), "covered")
    _free(docs.sparkSession)
    runs = covered.groupBy("row", "row2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.join(runs, ["row", "row2"], "left").select("id", "text", "runs").mapInArrow(
        _kept(length), f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary, kept_sha256 string",
    ).withColumnRenamed("id", id_col)
