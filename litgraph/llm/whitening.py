"""Operator 11, embedding whitening: Chebyshev-filtered subspace iteration over distributed centred products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import staged
from litgraph.llm.vectors import added, integers, is_whole, matrix, padded

LONG = 2**63 - 1


@dataclass
class Whitening:
    """Unit eigenvectors (columns of ``basis``) of the covariance of ``n`` distinct vectors with sums ``sums``."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0
    certified: bool = True
    history: list[float] = field(default_factory=list)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) ** 2, exact; None where it does not fit a long."""
        if not x.size:
            return [0] * len(x)
        most = self.n * int(max(x.max(), -int(x.min()))) + max(map(abs, self.sums))
        if most * most * x.shape[1] <= LONG:
            apart = self.n * x - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v <= LONG else None for v in exact]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension. Entries are added in halves of 32 bits, so no sum of a task overflows."""
    def partial(x: np.ndarray) -> np.ndarray:
        high, low = x >> 32, x & 0xFFFFFFFF
        return np.concatenate([[len(x)], high.sum(axis=0), low.sum(axis=0)])
    total = added(fit, "x", width, partial)
    if total is None:
        return 0, []
    total = [int(v) for v in total]
    return total[0], [(h << 32) + low for h, low in zip(total[1:width + 1], total[width + 1:])]


def _filtered(product, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of the covariance times ``q``: under 1 on [low, high], growing steeply above.

    The recurrence is scaled by its growth at ``top``, so that nothing overflows.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - middle)
    before, now = q, (product(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (product(now) - middle * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def fit_components(
    fit: DataFrame, width: int, components: int = 4, guards: int = 20, degree: int = 10, tolerance: float = 1e-13, rounds: int = 40,
) -> Whitening | None:
    """Leading eigenpairs of the covariance of ``fit`` (x: array of ``width`` longs); None without variance.

    A block of ``components + guards`` columns is filtered by a Chebyshev polynomial of the covariance, whose unwanted
    part reaches from 0 to the block's least Ritz value, then orthonormalised (QR) and rotated to its Ritz vectors.
    Each product with the covariance is one pass: tasks add up (x - mean)' ((x - mean) Q) of their rows, and the driver
    gets width x columns numbers. The rounds end when all wanted residuals |V q - e q| are at most ``tolerance`` of the
    largest eigenvalue: then each value is that near to an eigenvalue, each vector within residual / gap of its own, and
    the guards, whose Ritz values are smaller, show that none was passed over. If a round gains little (a flat
    spectrum), the block grows; a block as wide as the space needs no filter. ``certified`` is false if neither the
    tolerance nor a standstill at rounding (a hundred times it) was reached.
    """
    n, sums = _sums(fit, width)
    if n == 0 or width == 0:
        return None
    mean = np.array([s / n for s in sums])
    passes = 0

    def spread(x: np.ndarray) -> np.ndarray:
        return np.array([np.square(x - mean).sum()])
    trace = float(added(fit, "x", width, spread)[0]) / n
    if trace <= 0:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def partial(x: np.ndarray) -> np.ndarray:
            apart = x - mean
            return apart.T @ (apart @ q)
        return added(fit, "x", width, partial) / n

    chance = np.random.default_rng(11)
    columns = min(width, components + guards)
    block = np.linalg.qr(chance.standard_normal((width, columns)))[0]
    history: list[float] = []
    for turn in range(rounds):
        image = product(block)
        inner = block.T @ image
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        block, image = block @ turned, image @ turned
        wanted = min(components, columns)
        residuals = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0)
        worst = float(residuals.max() / values[0])
        history.append(worst)
        stands = worst <= 100 * tolerance and len(history) > 1 and worst > history[-2] / 4
        if worst <= tolerance or stands or columns == width:
            break
        if len(history) > 1 and worst > history[-2] / 100:
            more = min(width, 2 * columns) - columns
            block = np.concatenate([block, chance.standard_normal((width, more))], axis=1)
            columns += more
            values = np.append(values, [max(values[-1], 0.0)] * more)
        high = max(float(values[-1]), 1e-6 * float(values[0]))
        if columns < width and float(values[wanted - 1]) > high:
            block = _filtered(product, block, degree, 0.0, high, float(values[0]))
        block = np.linalg.qr(block)[0]
    kept = values[:wanted] > width * np.finfo(float).eps * trace
    basis, values, residuals = block[:, :wanted][:, kept], values[:wanted][kept], residuals[kept]
    model = Whitening(n, sums, basis, values, trace, residuals, passes, history=history)
    model.certified = columns == width or worst <= 100 * tolerance

    def squares(x: np.ndarray) -> np.ndarray:
        white = model.whiten(x)
        return white.T @ white
    model.identity_error = float(np.abs(added(fit, "x", width, squares) / n - np.eye(len(values))).max())
    return model


def whiten(
    table: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per remaining input row and component: ``id_col``, component, n, deviation, whitened, explained, identity_error.

    Rows without a vector or with null or infinite entries and NaN are left out. Entries become x = floor(scale * c).
    The mean, covariance and components (see ``fit_components``) are those of the distinct vectors x. Vectors shorter
    than the longest one are filled up with zeros. Components without variance have no rows; so a table of one vector,
    or an empty one, gives none. Repeated rows and null ids are returned each. A deviation beyond a long is null.
    Other columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(is_whole("v")).select("id", integers("v", scale).alias("x"))
    rows, width = padded(rows, "x")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit_components(staged(rows.select("x").distinct(), "distinct-vectors"), width, components) if width else None
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(model)  # width x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        k = len(found.values)
        share = found.values / found.trace
        for batch in batches:
            x, m = matrix(batch.column(1), width), batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, found.n), pa.int64()),
                pa.array(found.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(found.whiten(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, found.identity_error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
