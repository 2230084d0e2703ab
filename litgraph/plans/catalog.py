"""All registered queries."""

from __future__ import annotations

import importlib

from litgraph.plans.registry import CASES, SQL, bound

for _part in ("catalog_reports", "catalog_graph", "catalog_sources"):
    importlib.import_module(f"litgraph.plans.{_part}")


def queries():
    return {name: bound(fn) for name, fn in CASES.items()}


def oracle_sql():
    return dict(SQL)
