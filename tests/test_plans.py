"""Plan invariants for every registered query: no Python evaluation nodes and
no single-partition exchange that carries fact rows (only partial-aggregate
buffers, aggregated rows or top-k candidates may be gathered)."""
import os
import sys

import pytest

from conftest import SF_SMALL
from vacanta.plans import catalog

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_audit import audit  # noqa: E402

QUERIES = catalog.queries()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_invariants(spark, key):
    r = audit(QUERIES[key](spark, SF_SMALL))
    assert r["python"] == 0, r
    assert "fact-rows" not in r["single_partition"], r
