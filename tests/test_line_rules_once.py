"""Line rules are evaluated once per row: no filter repeats them."""

from __future__ import annotations

from skuloom.operators import documents as doc


def test_filters_read_computed_columns(spark):
    lines = spark.range(5).selectExpr("id AS doc_id", "CAST(id AS int) AS line_no", "concat('Wolf range Model: WR', id, ' Qty 2') AS text")
    plan = doc.lines_to_rows(lines)._jdf.queryExecution().optimizedPlan().toString()
    lowest = plan[plan.rindex("Filter") :].lower()
    assert "regexp" not in lowest and "rlike" not in lowest
