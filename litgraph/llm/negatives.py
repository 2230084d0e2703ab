"""Operator 13, hard-negative mining: Fagin's threshold algorithm over blocks of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from litgraph.llm.common import parts, staged
from litgraph.llm.vectors import integers, is_whole, padded

BLOCK = 4096  # candidates whose lists are sorted and searched together
ANCHORS = 512  # anchors that search them together
NO_ID = 2**63 - 1  # stands for a null id inside tasks: last of equals
FIRST_DEPTH, DEEPER = 32, 4  # depth of the first round of sorted access, and its growth by round
NEVER = np.iinfo(np.int64).min


class Lists:
    """A block's candidates with one list per dimension, sorted by value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # so that the first of equal scores has the smaller id
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.falling = np.argsort(-self.x, axis=0, kind="stable").T  # dimension, place: row
        self.sorted = np.take_along_axis(self.x, self.falling.T, axis=0).T

    def threshold(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """The most that a row may score that no list of an anchor has shown in its first ``depth`` places."""
        last = min(depth, len(self.ids)) - 1
        return np.where(anchors > 0, anchors * self.sorted[:, last], anchors * self.sorted[:, -1 - last]).sum(axis=1)

    def shown(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """Rows that some anchor meets in the first ``depth`` places of its lists, read from the end its sign asks for."""
        seen = np.full(len(self.ids), depth >= len(self.ids))  # at the end all rows are met, by an anchor of zeros too
        seen[self.falling[(anchors > 0).any(axis=0), :depth]] = True
        seen[self.falling[(anchors < 0).any(axis=0), -depth:]] = True
        return seen


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where these are whole numbers under 2 ** 53."""
    if x.size and y.size and x.shape[1] * int(np.abs(x).max()) * int(np.abs(y).max()) < 2**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def search(lists: Lists, anchors: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
    """For each anchor (row) and window (column of ``low`` and ``high``): rows of its ``k`` best scores within the window.

    ``allowed[anchor, row]`` says which rows an anchor may take. Rounds of sorted access go deeper down all lists. Rows
    that are met are scored once, by random access, for all anchors that still search. An anchor stops as soon as its
    threshold is strictly below the kth score of each window, or below a window's least score where that has fewer: then
    no unseen row can enter a window, nor tie with its last one. Returns, per window, (anchor, row, score) columns.
    """
    n, size = len(anchors), len(lists.ids)
    scores = np.full((n, size), NEVER)
    scored = np.zeros(size, bool)
    asked = low <= high
    least_high = np.where(asked, high, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
    going, depth = np.flatnonzero(asked.any(axis=1)), FIRST_DEPTH
    while len(going):
        new = np.flatnonzero(lists.shown(anchors[going], depth) & ~scored)
        scored[new] = True
        own = np.where(allowed[going[:, None], new], _products(anchors[going], lists.x[new]), NEVER)
        scores[going[:, None], new] = own
        if depth >= size:
            break
        most = lists.threshold(anchors[going], depth)
        ends = most < least_high[going]  # else some window is still open at its upper side
        for at in np.flatnonzero(ends).tolist():
            g = going[at]
            for w in np.flatnonzero(asked[g]).tolist():
                inside = scores[g][(scores[g] >= low[g, w]) & (scores[g] <= high[g, w])]
                kth = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else low[g, w]
                if most[at] >= kth:
                    ends[at] = False
                    break
        going, depth = going[~ends], depth * DEEPER
    found = []
    for w in range(high.shape[1]):
        inside = (scores >= low[:, w, None]) & (scores <= high[:, w, None]) & (scores != NEVER)
        rows, kept = [], []
        for g in np.flatnonzero(inside.any(axis=1)).tolist():
            at = np.flatnonzero(inside[g])
            own = scores[g, at]
            if len(at) > k:
                kth = np.partition(own, len(own) - k)[len(own) - k]
                at, own = at[own >= kth], own[own >= kth]
            at = at[np.argsort(-own, kind="stable")][:k]
            rows.append(at)
            kept.append(np.full(len(at), g))
        g, at = (np.concatenate(kept), np.concatenate(rows)) if rows else (np.zeros(0, np.int64),) * 2
        found.append((g, at, scores[g, at]))
    return found


def _columns(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return frame["id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), np.stack(frame["x"].to_numpy()).reshape(len(frame), width).astype(np.int64)


def _meet(width: int, k: int, windows: bool):
    """One block of candidates and one of anchors (cogrouped) to each anchor's best of the block."""
    def run(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(candidates) and len(anchors):
            lists = Lists(*_columns(candidates, width))
            ids, labels, x = _columns(anchors, width)
            same = labels[:, None] == lists.labels[None, :]
            if windows:
                wide = max(map(len, anchors["positive"]))
                scores = np.full((len(anchors), wide), 0, np.int64)
                given = np.zeros((len(anchors), wide), bool)
                for g, values in enumerate(anchors["positive"]):
                    scores[g, :len(values)], given[g, :len(values)] = values, True
                low = np.where(given, -(-scores // 2), 1)  # 50 p <= 100 s <= 95 p in whole numbers, without overflow
                high = np.where(given, scores // 100 * 95 + scores % 100 * 95 // 100, 0)
                met = search(lists, x, ~same, low, high, k)
            else:
                other = (ids[:, None] != lists.ids[None, :]) | (ids[:, None] == NO_ID)
                low, high = np.full((len(anchors), 1), NEVER + 1), np.full((len(anchors), 1), NO_ID)
                met = search(lists, x, same & other, low, high, k)
            keys = anchors["anchor"].to_numpy(np.int64)
            for w, (g, at, score) in enumerate(met):
                found.append(pd.DataFrame({"anchor": keys[g], "place": np.full(len(g), w + 1), "found": lists.ids[at], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "place", "found", "score")})
    return run


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "found")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    table: DataFrame, is_anchor: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", noise: str | None = None,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without a label or vector, or with null or non-finite entries, take no part. ``noise`` is an SQL expression
    that replaces the label first. Entries become floor(scale * c), scores are integer inner products, higher first,
    ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each of them its
    first ``negatives`` rows of other labels are returned whose score is within 50 to 95 percent of the positive's.

    Candidates and anchors are dealt to blocks of bounded size, whose numbers grow with the table, and each pair of
    blocks is one group: no task holds more than two blocks. Each runs the threshold algorithm (``search``) and gives
    its best rows per anchor, of which the first ones of all blocks are kept. Rows are dealt at random and the deal is
    written down, so hot labels and vectors do not matter and a repeated task changes nothing.

    Rows that repeat id, label and vector count once; rows of one id with other labels or vectors each count, and an
    anchor is never its own positive by id. A null id is a candidate (last of equals, and returned as null), and an
    anchor only if ``is_anchor`` says so. Vectors shorter than the longest are filled up with zeros, empty ones as well. Scores must fit
    into a long. Empty input gives no rows; other columns are ignored.
    """
    spark = table.sparkSession
    label = F.expr(noise) if noise else F.col(label_col)
    rows = table.filter(F.col(label_col).isNotNull() & is_whole(vector_col)).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), integers(vector_col, scale).alias("x"),
        F.coalesce(F.expr(is_anchor), F.lit(False)).alias("is_anchor"))
    rows, width = padded(rows, "x", 1)
    rows = staged(rows.distinct().withColumn("anchor", F.monotonically_increasing_id()), "vectors")
    total, chosen = rows.select(F.count("*"), F.count_if("is_anchor")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not chosen:
        return spark.createDataFrame([], schema)
    blocks, groups = -(-total // BLOCK), -(-chosen // ANCHORS)
    deal = F.xxhash64("anchor")
    candidates = rows.select("id", "label", "x", F.pmod(deal, F.lit(blocks)).alias("block"))
    candidates = candidates.withColumn("crew", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    crew = F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(groups)).cast("int")
    anchors = staged(rows.filter("is_anchor").select("anchor", "id", "label", "x", crew.alias("crew")), "anchors")

    def met(asking: DataFrame, k: int, windows: bool) -> DataFrame:
        asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return candidates.groupBy("block", "crew").cogroup(asking.groupBy("block", "crew")).applyInPandas(
            _meet(width, k, windows), "anchor bigint, place int, found bigint, score bigint")
    close = staged(_first(met(anchors, positives, False), ["anchor"], positives).select(
        "anchor", F.col("rank").alias("place"), F.col("found").alias("positive"), "score"), "positives")
    scores = close.groupBy("anchor").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("positive"))  # ``positives`` at most
    wanting = anchors.join(scores, "anchor")
    hard = _first(met(wanting, negatives, True), ["anchor", "place"], negatives)
    named = close.select("anchor", "place", "positive", F.col("score").alias("positive_score"))
    whole = hard.join(named, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return whole.select(
        null("anchor_id").alias("anchor_id"), null("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), null("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
