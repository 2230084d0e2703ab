"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litgraph.plans.derive import Tables, with_ctes

CASES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register a query over ``Tables``; ``sql`` may name the ``fx_`` derivations."""

    def add(fn: Callable[[Tables], DataFrame]):
        CASES[name] = fn
        if sql:
            SQL[name] = with_ctes(sql)
        return fn

    return add


def bound(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
