"""Views whose rules run on every row of a small file are dealt over all cores."""

from __future__ import annotations

import pytest

from skuloom.registry import source


@pytest.mark.parametrize("name", ["product_pages", "search_results", "transcripts", "quote_cells", "quote_lines", "intake"])
def test_small_files_are_dealt_out(spark, name):
    rows = source(spark, "/root/testdata/sf0.001", name)
    cores = spark.sparkContext.defaultParallelism
    assert f"RoundRobinPartitioning({cores})" in rows._jdf.queryExecution().executedPlan().toString()
