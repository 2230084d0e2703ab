"""Integer vectors of an embedding table, and sums over all rows that reach the driver as one array."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64  # partial sums that one step adds up


def is_whole(vector: str) -> Column:
    """True for a vector that is there and holds finite entries only."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)), F.lit(False)))
    return F.col(vector).isNotNull() & finite


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * c) of each entry, as longs."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale))


def padded(rows: DataFrame, vector: str, shortest: int = 0) -> tuple[DataFrame, int]:
    """Vectors filled up with zeros to the length of the longest one (``shortest`` at least), and that length."""
    least, most = rows.select(F.min(F.size(vector)), F.max(F.size(vector))).first()
    width = max(most or 0, shortest)
    if least is not None and least < width:
        rows = rows.withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector))))
    return rows, width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def added(rows: DataFrame, vector: str, width: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``partial`` over all rows; None without rows. Tasks add up their rows, then FAN tasks' sums at a time.

    ``partial`` gives an array of one shape and dtype for any number of rows, so a sum's size does not grow with them.
    """
    kind: dict[str, object] = {}
    sample = partial(np.zeros((0, width), np.int64))
    kind["shape"], kind["dtype"] = sample.shape, sample.dtype

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = partial(matrix(batch.column(0), width))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0):
                own = np.frombuffer(part.as_buffer(), kind["dtype"])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.select(vector).mapInArrow(first, "part binary")
    n = rows.rdd.getNumPartitions()
    while n > FAN:
        n = math.ceil(n / FAN)
        parts = parts.repartition(n).mapInArrow(again, "part binary")
    found = [np.frombuffer(r["part"], kind["dtype"]).reshape(kind["shape"]) for r in parts.collect()]
    return sum(found[1:], found[0]) if found else None
