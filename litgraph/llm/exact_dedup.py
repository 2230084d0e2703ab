"""Operator 6, exact dedup: a two-pass Bloom filter decides which rows shuffle. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import join_groups, staged, text_of

BLOCK_BITS = 1 << 15  # bits of one block of Spark's bitmap functions


def _slot(seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64("sha", F.lit(seed)), F.lit(bits)) + F.lit(seed * bits)


def _repeated_slots(hashed: DataFrame, bits: int) -> DataFrame:
    """First pass: by range of hashes, blocks of bits, a bit being set where two or more rows fall into its slot."""
    return (
        hashed.select("range", F.explode(F.array(_slot(0, bits), _slot(1, bits))).alias("slot"))
        .groupBy("range", "slot").count().filter(F.col("count") > 1)
        .groupBy("range", F.expr(f"slot div {BLOCK_BITS}").alias("block"))
        .agg(F.bitmap_construct_agg(F.col("slot") % BLOCK_BITS).alias("bitmap"))
    )


def _probe(rows: DataFrame, blocks: DataFrame, seed: int, bits: int) -> DataFrame:
    """Second pass for one of the two slots; a block without repeats is absent."""
    rows = rows.withColumn("_at", _slot(seed, bits)).withColumn("block", F.expr(f"_at div {BLOCK_BITS}"))
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, int(_at % {BLOCK_BITS} div 8) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("1 << int(_at % 8)").bitwiseAND(byte) != 0
    return rows.join(F.broadcast(blocks), "block", "left").withColumn(
        f"_hit{seed}", F.coalesce(is_set, F.lit(False))).drop("block", "bitmap", "_at")


def probed_rows(hashed: DataFrame, total: int, bits_per_row: int, max_bits: int) -> DataFrame:
    """``hashed`` (id, sha, range) with ``suspect``: whether both slots of a row are shared with other rows.

    A table of more rows than ``max_bits`` serves has several ranges of hashes, each with a filter of its own: the rows of
    a range meet its blocks alone, so the filter grows with the table and no broadcast is over 2 * ``max_bits`` / 8 bytes.
    """
    bits, ranges = _sizes(total, bits_per_row, max_bits)
    blocks = _repeated_slots(hashed, bits)
    if ranges > 1:
        blocks = staged(blocks, "filter")
    found = None
    for n in range(ranges):
        own = blocks.filter(F.col("range") == n).drop("range")
        probed = _probe(_probe(hashed.filter(F.col("range") == n), own, 0, bits), own, 1, bits)
        found = probed if found is None else found.unionByName(probed)
    return found.withColumn("suspect", F.col("_hit0") & F.col("_hit1"))


def _sizes(total: int, bits_per_row: int, max_bits: int) -> tuple[int, int]:
    """Bits of a range's filter for each of the two slots, and ranges."""
    ranges = max(-(-bits_per_row * total // max_bits), 1)
    bits = BLOCK_BITS
    while bits < min(bits_per_row * total / ranges, max_bits):
        bits *= 2
    return bits, ranges


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 8, max_bits: int = 1 << 27,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; its largest id stays. Pass one counts rows per filter slot (two slots per SHA-256; only slot
    numbers shuffle, combined first), pass two probes the slots' bitmaps: rows of which both slots are shared may be
    repeats and shuffle by their hash, all others go straight through, as they are alone. The filter has ``bits_per_row``
    bits a row for each of the two slots at any number of rows, in parts of ``max_bits`` (see ``probed_rows``). Texts
    themselves never shuffle.

    Null text counts as empty. Rows that share id and text are copies of one document: each is returned and kept
    alike (the pipeline drops such copies). A null id is smaller than any other; a group of null ids only keeps them.
    Empty input gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("sha"))
    hashed = staged(rows, "sha")
    total = hashed.count()
    ranges = _sizes(total, bits_per_row, max_bits)[1]
    hashed = hashed.withColumn("range", F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(ranges)).cast("int"))
    probed = probed_rows(hashed, total, bits_per_row, max_bits)
    alone = probed.filter("NOT suspect").select("sha", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = probed.filter("suspect").select("sha", "id")
    groups = suspects.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    met = join_groups(suspects, groups, ["sha"], "group_size", total, F.col("id"))
    return alone.unionByName(met.select(alone.columns)).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
