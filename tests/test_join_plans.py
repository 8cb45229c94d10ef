"""Join partners that grow with the input are dealt by key, not sent through the driver."""

from __future__ import annotations

import pytest

from skuloom.registry import all_queries


@pytest.mark.parametrize("name, small", [("page_images", 0), ("select_best_image", 0), ("spec_links", 0), ("score_pages", 1)])
def test_page_tables_are_not_broadcast(spark, name, small):
    """``small`` counts the brand table, which does not grow with the pages."""
    df = all_queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= small
