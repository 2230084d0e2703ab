"""Operator 3, token-ID output: blocks of directly addressable codes, any token being read without decoding its block."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from litgraph.llm.common import parts, scratch_folder, text_of
from litgraph.llm.tokens import ChunkEncoder, in_groups

MAGIC = 0x31434144  # "DAC1"
CHUNK_BITS = 8
RANK_WORDS = 8  # a rank entry per 8 words (512 bits) of a continuation bitmap
BLOCK_TOKENS = 1 << 20


def pack(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """One block. ``bounds``: each document's first token, and the total.

    Little-endian. Header: magic, documents, levels as 64-bit numbers; the bounds; per level its number of chunks,
    then the chunks of 8 bits (low ones first), the continuation bitmap in 64-bit words and the rank directory, the
    ones before each 512 bits. All parts are padded to 8 bytes, so they are used in place.
    """
    out = []
    rest = ids.astype(np.uint32)
    levels = 0
    while len(rest) or not levels:
        chunks = (rest & np.uint32(255)).astype(np.uint8)
        more = rest >> np.uint32(CHUNK_BITS)
        goes_on = more > 0
        words = np.zeros(-(-len(rest) // 512) * RANK_WORDS + 1, np.uint64)
        bits = np.packbits(goes_on, bitorder="little")
        words.view(np.uint8)[:len(bits)] = bits
        ones = np.bitwise_count(words[:-1].reshape(-1, RANK_WORDS)).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        padded = np.zeros(-(-len(chunks) // 8) * 8, np.uint8)
        padded[:len(chunks)] = chunks
        out += [np.array([len(rest)], "<u8").tobytes(), padded.tobytes(), words.astype("<u8").tobytes(), ranks.astype("<u8").tobytes()]
        rest = more[goes_on]
        levels += 1
    head = np.array([MAGIC, len(bounds) - 1, levels], "<u8").tobytes() + bounds.astype("<u8").tobytes()
    return head + b"".join(out)


class Block:
    """Reads a packed block in place."""

    def __init__(self, payload: bytes) -> None:
        head = np.frombuffer(payload, "<u8", 3)
        if int(head[0]) != MAGIC:
            raise ValueError("not a block of token ids")
        self.bounds = np.frombuffer(payload, "<u8", int(head[1]) + 1, 24).astype(np.int64)
        at = 24 + 8 * len(self.bounds)
        self.levels = []
        for _ in range(int(head[2])):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            at += -(-n // 8) * 8
            groups = -(-n // 512)
            words = np.frombuffer(payload, "<u8", groups * RANK_WORDS + 1, at)
            at += 8 * len(words)
            ranks = np.frombuffer(payload, "<u8", groups + 1, at)
            at += 8 * len(ranks)
            self.levels.append((chunks, words, ranks))

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of the level's bitmap before each place."""
        _, words, ranks = self.levels[level]
        group, word = at // 512, at // 64
        found = ranks[group].astype(np.int64)
        for k in range(RANK_WORDS - 1):
            before = np.minimum(group * RANK_WORDS + k, len(words) - 1)  # the end of a full bitmap has no words behind it
            found += np.where(group * RANK_WORDS + k < word, np.bitwise_count(words[before]), 0)
        part = words[word] & ((np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1))
        return found + np.bitwise_count(part)

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The tokens at any places; each one follows its own chunks, level by level."""
        at = np.asarray(at, np.int64)
        ids, todo, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for level, (chunks, words, _) in enumerate(self.levels):
            ids[todo] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            goes_on = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) != 0
            todo, at = todo[goes_on], at[goes_on]
            if not len(todo):
                break
            at = self._rank(level, at)
            shift += CHUNK_BITS
        return ids

    def run(self, start: int, stop: int) -> np.ndarray:
        """The tokens of a range: on each level they are a range too, so two ranks a level are enough."""
        ids, todo, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for level, (chunks, words, _) in enumerate(self.levels):
            if start == stop:
                break
            ids[todo] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            first = start // 64
            bits = np.unpackbits(words[first:(stop - 1) // 64 + 1].view(np.uint8), bitorder="little")
            todo = todo[bits[start - 64 * first:stop - 64 * first].astype(bool)]
            start, stop = self._rank(level, np.array([start, stop])).tolist()
            shift += CHUNK_BITS
        return ids


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, keeps_blanks: bool, end: int, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes the ids of all texts, ``end`` behind each, as Parquet rows of one block each, in ascending order of id.

    Columns: part (range of ids, ascending), block (within the part), start (tokens of the part before the block),
    n_tokens, doc_ids, payload (a packed block, not compressed again). A block holds whole documents, BLOCK_TOKENS
    tokens or one document more. Null texts are empty; null ids come first, rows of one id follow by the hash of their text.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(parts(docs.sparkSession), "id").sortWithinPartitions("id", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held_ids, held_counts, held_docs, held = [], [], [], 0
        encoder = ChunkEncoder(tokenizer, keeps_blanks)

        def emit() -> pa.RecordBatch:
            counts = np.concatenate(held_counts)
            payload = pack(np.concatenate(held_ids), np.concatenate([[0], np.cumsum(counts)]))
            doc_ids = pa.concat_arrays(held_docs)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                pa.array([payload], pa.binary())], ["part", "block", "start", "n_tokens", "doc_ids", "payload"])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                ids, counts = encoder.encode(texts[a:b], end)
                held_ids.append(ids)
                held_counts.append(counts)
                held_docs.append(batch.column(0).slice(a, b - a))
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield emit()
                    block, start = block + 1, start + held
                    held_ids, held_counts, held_docs, held = [], [], [], 0
        if held_docs:
            yield emit()
    rows.mapInArrow(run, f"part int, block int, start bigint, n_tokens bigint, doc_ids array<{kind}>, payload binary") \
        .write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


def read_documents(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: ``id_col``, start (tokens of all documents before it), n_tokens, ids_crc32."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per range
    before = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(batch.column(3)[r].as_buffer())
                bounds = block.bounds.tolist()
                raw = block.run(0, bounds[-1]).astype("<u4").tobytes()  # all of it is wanted, so it is read in one go
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds, bounds[1:])]
                own = batch.column(2)[r].values
                yield pa.RecordBatch.from_arrays([
                    own, pa.array([batch.column(0)[r].as_py()] * len(own), pa.int32()),
                    pa.array(np.array(bounds[:-1], np.int64) + batch.column(1)[r].as_py(), pa.int64()),
                    pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())],
                    ["id", "part", "start", "n_tokens", "ids_crc32"])
    docs = files.select("part", "start", "doc_ids", "payload").mapInArrow(
        run, f"id {kind}, part int, start bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(F.broadcast(before), "part").select(
        F.col("id").alias(id_col), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(files: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token of each wanted (``id_col``, at): only the blocks that hold such documents are opened, none is decoded whole."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    spots = files.select("part", "block", F.posexplode("doc_ids").alias("row", "id")).join(
        wanted.select(F.col(id_col).alias("id"), "at"), "id")
    asked = spots.groupBy("part", "block").agg(F.collect_list(F.struct("row", "id", "at")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(batch.column(0)[r].as_buffer())
                asks = [x for x in batch.column(1)[r].as_py()
                        if 0 <= x["at"] < block.bounds[x["row"] + 1] - block.bounds[x["row"]]]
                ids = block.tokens(np.array([block.bounds[x["row"]] + x["at"] for x in asks], np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["id"] for x in asks], batch.schema.field(1).type.value_type.field("id").type),
                    pa.array([x["at"] for x in asks], pa.int64()), pa.array(ids.astype(np.int64), pa.int64())], ["id", "at", "token"])
    return files.join(asked, ["part", "block"]).select("payload", "asked").mapInArrow(
        run, f"id {kind}, at bigint, token bigint").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, name: str, tokenizer: str, keeps_blanks: bool, end: int) -> DataFrame:
    """Writes the files to a new folder of the shared scratch space and opens them."""
    import uuid

    spark = docs.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, keeps_blanks, end)
    return spark.read.parquet(path)
