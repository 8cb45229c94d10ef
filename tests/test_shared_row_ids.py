"""Rows that share a row id take their results once each: no row is multiplied."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skuloom.plans import state
from skuloom.registry import source


@pytest.mark.parametrize("run", [state.accept_result, state.join_result_by_row_id])
def test_two_rows_of_one_id(spark, run):
    one = source(spark, "/root/testdata/sf0.001", "intake_wide").filter("row_id % 20 = 4").limit(50).localCheckpoint()
    other = one.withColumn("category", F.when(F.col("category") == "", F.lit("sofa")).otherwise(F.lit("")))
    apart = sorted(map(str, run(one).collect() + run(other).collect()))
    assert sorted(map(str, run(one.unionByName(other)).collect())) == apart
