"""Of extractions, only counts of nested fields travel to where the latest one is sought."""

from __future__ import annotations

import pytest

from litgraph.operators import joins, reports
from litgraph.plans import catalog


@pytest.mark.parametrize("name, module", [("P11_data_quality", joins), ("A18_critique_candidates", reports)])
def test_nested_fields_stay(spark, monkeypatch, name, module):
    seen, real = [], joins.latest_extraction
    monkeypatch.setattr(module, "latest_extraction", lambda df: seen.append(set(df.columns)) or real(df))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and not seen[0] & {"entities", "claims", "mechanisms", "methods", "key_findings"}
