"""Operator 10, sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

DataFrame functions only; the driver draws the matrix, one row per input partition, from the partitions' counts.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from litgraph.llm.common import staged, text_of

MAX_BROADCAST_PARTITIONS = 200_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw: good ones among ``draws`` taken without return; inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    start = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - start
    down, up, p_down, p_up = mode, mode, start, start
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Rows that each partition sends to each shard; shard totals differ by one at most and are exact."""
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    rng = random.Random(seed)
    matrix = {}
    for part in sorted(counts):
        todo, rest, row = counts[part], sum(free), []
        for s in range(shards):
            rest -= free[s]
            take = hypergeometric(rng, free[s], rest, todo)
            row.append(take)
            free[s] -= take
            todo -= take
        matrix[part] = row
    return matrix


def _matrix_frame(spark: SparkSession, matrix: dict[int, list[int]]) -> DataFrame:
    """(part, first): ``first`` holds the local rank at which each next shard's rows begin."""
    rows = []
    for part, row in matrix.items():
        ends, at = [], 0
        for take in row[:-1]:
            at += take
            ends.append(at)
        rows.append({"part": part, "first": ends})
    said = F.from_json(F.lit(json.dumps(rows)), "array<struct<part:bigint,first:array<bigint>>>")
    return spark.range(1).select(F.inline(said))


def shard_rows(
    docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """One row per input row: ``id_col``, size, text_crc32, shard, slot. Shard counts differ by one at most.

    Each input partition orders its rows by a seeded hash (local permutation) and numbers them; its row of the
    communication matrix, drawn without return from the shards' free places, says how many of these numbers go to
    which shard. Within its shard a row gets its slot by a second seeded hash: the shard is cut by that hash into
    blocks that are numbered side by side, so no task holds a shard. Slots are gapless from 0. All orders are hashes
    of the row, and the local numbers are written to the shared folder before they are used, so a repeated task gives
    the same rows.

    Null text has size 8 and crc 0. A null id is hashed as such. Repeated rows are separate rows. Equal texts are
    spread like all others. Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    facts = ["id", "text_crc32", "size"]
    local = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    local = local.withColumn("_order", F.xxhash64(*facts, F.lit(seed)))
    local = staged(local.sortWithinPartitions("_order", *facts).withColumn("_at", F.monotonically_increasing_id()).drop("_order"), "local")
    local = local.select(
        *facts, F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("rank"))
    counts = {r["part"]: r["count"] for r in local.groupBy("part").count().collect()}  # a row per input partition
    firsts = _matrix_frame(spark, communication_matrix(counts, shards, seed))
    if len(counts) <= MAX_BROADCAST_PARTITIONS:
        firsts = F.broadcast(firsts)
    blocks = 64
    while blocks * shards * rows_per_block < sum(counts.values()):
        blocks *= 2
    placed = local.join(firsts, "part").select(
        *facts, F.size(F.filter("first", lambda x: x <= F.col("rank"))).alias("shard"),
        F.xxhash64(*facts, F.lit(seed + 1)).alias("_order"))
    placed = placed.withColumn("_block", F.shiftrightunsigned("_order", 64 - int(math.log2(blocks))).cast("int"))
    by_shard = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n")).select(  # shards * blocks rows
        "shard", "_block", F.coalesce(F.sum("_n").over(by_shard), F.lit(0)).alias("_before"))
    in_block = Window.partitionBy("shard", "_block").orderBy("_order", *facts)
    slots = placed.withColumn("_slot", F.row_number().over(in_block) - 1)
    return slots.join(before, ["shard", "_block"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("_before") + F.col("_slot")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 42, id_col: str = "doc_id") -> None:
    """Writes whole rows to ``path/shard=N``, each file run in slot order; ``id_col`` must be unique here."""
    placed = shard_rows(docs, shards, seed, id_col).select(id_col, "shard", "slot")
    docs.join(placed, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
