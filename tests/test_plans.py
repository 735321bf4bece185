"""Plans of the search queries: no nested-loop or cartesian joins, and texts
are read when a query prepares its vectors, not again by its plan."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_audit import audit  # noqa: E402

from tenderlake.plans.registry import REGISTRY  # noqa: E402


@pytest.mark.parametrize("name", ["search_documents", "search_conversations", "j1_limit_100", "search_stored_corpus", "b9_hybrid_search", "b17_cross_collection"])
def test_search_plans(spark, sf, name):
    plan = REGISTRY[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoopJoin|CartesianProduct", plan)
    scans = audit(plan).get("scanned more than once", {})
    assert all(scans.get(t, 0) <= 2 for t in ("documents", "conversations"))
    assert not re.search(r"Scan parquet[^\n]*\b(documents|conversations)\.parquet", plan)
