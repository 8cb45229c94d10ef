"""Dimension texts are parsed once per row, with the results of the two separate rules."""

from __future__ import annotations

from skuloom.functions import dims


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dimension_text_is_parsed_once(spark):
    """the reason of a refusal and the text shown come from the same parsed axes."""
    rows = spark.range(3).selectExpr("concat(id, '\"W x 3\"H x 4\"D') AS d", "'other' AS c")
    both = rows.select(dims.export_dims(rows.d, rows.c).alias("x"))
    apart = rows.select(dims.export_text(rows.d, dims.sanity_reason(rows.d, rows.c)).alias("x"))
    assert 2 * _plan(both).count("[Hh]") <= _plan(apart).count("[Hh]")


def test_dimension_text_has_the_same_result(spark):
    texts = ["", None, '36 1/2"W x 38"H x 24"D', '1/2"W x 3"H x 2752"D', "Width 5, Height: 6, Depth is 7", "CARTON 3 x 4", "Rough-In 9W 9H 9D",
             "12 x 14", '0"W x 3"H x 4"D', '4"W x 4"H x 4"D', "Karton 5W 6H 7D", "pacKage 5W 6H 7D"]
    rows = spark.createDataFrame([(t, c) for t in texts for c in ("appliance", "other", None)], "d string, c string")
    got = rows.select("d", dims.export_dims(rows.d, rows.c).alias("x"), dims.export_text(rows.d, dims.sanity_reason(rows.d, rows.c)).alias("y")).collect()
    assert all(r.x == r.y for r in got)
    shown = {r.d: r.x for r in got}
    assert shown['36 1/2"W x 38"H x 24"D'] == '36 1/2"W x 38"H x 24"D' and shown["12 x 14"] == "12 x 14"
    assert shown["CARTON 3 x 4"] == shown["Rough-In 9W 9H 9D"] == shown["pacKage 5W 6H 7D"] == shown['1/2"W x 3"H x 2752"D'] == ""
