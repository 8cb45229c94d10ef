"""Representatives get their own results in the step that hands them to the other rows: no second join of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.operators import enrich
from skuloom.registry import source


def test_representatives_take_their_own_results(spark):
    rows = source(spark, "/root/testdata/sf0.001", "intake_wide").limit(400).localCheckpoint()
    reps = enrich.elect(enrich.qualification(rows).filter("qualifies")).localCheckpoint()
    reps = reps.withColumns({"dimensions": F.when(F.col("row_id") % 4 > 0, F.concat(F.lit("new "), "dimensions")), "image_url": F.lit("")}).localCheckpoint()
    got = {r.row_id: r for r in enrich.propagate(rows, reps, own=("dimensions", "image_url")).select("row_id", "dimensions", "image_url").collect()}
    plain = {r.row_id: r for r in enrich.propagate(rows, reps).select("row_id", "dimensions", "image_url").collect()}
    results = {r.row_id: r for r in reps.select("row_id", "dimensions", "image_url").collect()}
    assert results and len(got) == 400
    for row_id, r in got.items():
        if row_id in results:
            before = results[row_id].dimensions
            assert (r.dimensions, r.image_url) == (plain[row_id].dimensions if before is None else before, "")
        else:
            assert r == plain[row_id]
