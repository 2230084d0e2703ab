"""Numeric expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity of two float arrays, in double."""
    return dot(a, b) / (norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    """F19."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def geomean(values: Column, floor: float = 0.01) -> Column:
    """geometric mean of an array whose values are lifted to ``floor``."""
    logs = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.log(F.greatest(v, F.lit(floor))))
    return F.exp(logs / F.size(values))


def crossings(ops: Column) -> Column:
    """How often neighbouring, known operations of a path differ."""
    steps = F.zip_with(
        F.slice(ops, F.lit(1), F.greatest(F.size(ops) - 1, F.lit(0))),
        F.slice(ops, F.lit(2), F.greatest(F.size(ops) - 1, F.lit(0))),
        lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0)),
    )
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def distinct_known(items: Column) -> Column:
    return F.size(F.array_distinct(F.array_compact(items)))


def short_id(text: Column) -> Column:
    """first twelve hex digits of the SHA-1 of the folded text."""
    return F.substring(F.sha1(F.trim(F.lower(text)).cast("binary")), 1, 12)


def graph_id(text: Column) -> Column:
    """``short_id`` of 24 digits: among tens of millions of claims some share their first twelve."""
    return F.substring(F.sha1(F.trim(F.lower(text)).cast("binary")), 1, 24)
