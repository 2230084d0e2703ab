"""Operator 7, packing: harmonic classes of piece lengths, a fixed number of pieces per sequence of each class."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from litgraph.llm.common import staged, text_of
from litgraph.llm.tokens import ChunkEncoder, in_groups


def piece_lengths(tokens: int, capacity: int, slack: float, least: int) -> list[int]:
    """Cuts a document: whole sequences first, then the largest capacity // k that fits, again and again.

    A rest stays in one piece if it leaves at most ``slack`` of its class's share empty, or has ``least`` tokens or fewer.
    """
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest  # the class that holds the rest as it is
        if rest <= least or rest >= (1 - slack) * (capacity // k):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def _pieces(docs: DataFrame, tokenizer: str, keeps_blanks: bool, end: int, capacity: int, slack: float, least: int, with_ids: bool) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, class, part, rank[, ids]); rank counts a class's pieces in its part."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = ChunkEncoder(tokenizer, keeps_blanks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                ids, counts = encoder.encode(texts[a:b], end)
                raw, at, rows = ids.astype("<u4").tobytes(), 0, []
                for doc, n in enumerate(counts.tolist()):
                    start = 0
                    for length in piece_lengths(n, capacity, slack, least):
                        k, own = capacity // length, raw[4 * (at + start):4 * (at + start + length)]
                        rows.append((doc, start, length, zlib.crc32(own), n, k, filled[k], own if with_ids else None))
                        filled[k] += 1
                        start += length
                    at += n
                doc, start, length, crc, n, k, rank, own = zip(*rows)
                columns = [batch.column(0).slice(a, b - a).take(pa.array(doc, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc, n, k)]
                columns += [pa.array([part] * len(rows), pa.int64()), pa.array(rank, pa.int64())]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank"]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class bigint, part bigint, rank bigint"
    return docs.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def first_fit(totals: dict[int, int], capacity: int) -> dict[int, int]:
    """A bin for each class's rest: the first one with room, larger rests before smaller ones."""
    free, bins = [], {}
    for k, total in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        at = next((n for n, room in enumerate(free) if room >= total), len(free))
        if at == len(free):
            free.append(capacity)
        free[at] -= total
        bins[k] = at
    return bins


def pack(
    docs: DataFrame, tokenizer: str, keeps_blanks: bool, end: int, capacity: int = 2048, slack: float = 0.03, least: int = 48,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Packs all documents (ids of the text, then ``end``) into sequences of at most ``capacity`` tokens.

    A document is cut into whole sequences and a rest, the rest into harmonic shares (see ``piece_lengths``). Class k
    holds pieces of capacity // (k + 1) + 1 to capacity // k tokens, k of which fill a sequence, whichever they are;
    so each input partition numbers its pieces of a class alone, and only the counts per partition and class meet, to
    give every partition its range of places. Each class ends with fewer than k pieces that fill no sequence, under
    ``capacity`` tokens a class at any size of input; such rests stay whole and share sequences, first fit by falling
    total. Only the classes' totals, ``capacity`` numbers at most, reach the driver for that.

    One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids
    (little-endian 32-bit numbers). The piece's place in its partition is written to the shared folder before use, so
    a repeated task changes nothing. Null texts are empty (one token); repeated rows are packed each; null ids stay.
    Empty input gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    pieces = staged(_pieces(rows, tokenizer, keeps_blanks, end, capacity, slack, least, with_ids), "pieces")
    counts = staged(pieces.groupBy("class", "part").agg(F.count("*").alias("n")), "piece-counts")
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))  # one row a class
    bins = totals.select("class", "total", F.expr("total div class").alias("whole"))
    bins = bins.withColumn("first", F.coalesce(F.sum("whole").over(
        Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = counts.select("class", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = pieces.join(before, ["class", "part"]).join(F.broadcast(bins), "class")
    placed = placed.withColumn("at", F.col("before") + F.col("rank"))
    keep = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    whole = F.col("at") < F.col("whole") * F.col("class")
    rests = {r["class"]: r["n"] for r in placed.filter(~whole).groupBy("class").agg(F.sum("length").alias("n")).collect()}
    used = bins.agg(F.sum("whole")).first()[0] or 0
    homes = [(k, used + n) for k, n in first_fit(rests, capacity).items()]
    homes = docs.sparkSession.createDataFrame(homes, "class bigint, home bigint")
    placed = placed.join(F.broadcast(homes), "class", "left").withColumn(
        "sequence_id", F.when(whole, F.col("first") + F.expr("at div class")).otherwise(F.col("home")))
    in_order = Window.partitionBy("sequence_id").orderBy("class", "at").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(in_order), F.lit(0))
    return placed.select(*keep, "sequence_id", offset.alias("offset")).withColumnRenamed("id", id_col)
