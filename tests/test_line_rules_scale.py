"""Rules of document lines and dimension texts read a text as few times as they can, with the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import dims
from skuloom.operators import documents as doc


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_and_brands_are_searched_once(spark):
    """the label of a model is found once for its test, its number and its name."""
    rows = spark.createDataFrame([("Wolf oven Model: AB-1200, Qty 2",)], "text string")
    model = rows.select(doc.model_of_line(F.col("text"), doc.known_brand(F.col("text"))).alias("m"))
    assert _plan(model).count("serial") <= 2
    assert model.first().m == ("AB-1200", "Model")


def test_line_classes(spark):
    want = {
        "": "empty", "Total $5.00": "skip", "Service  Plan 2": "skip", "f&h 3": "skip", "sub-total": "skip", "Balance due": "skip", "Warranty": "skip",
        "row 5. $3.00 ": "charge", "$285.97": "charge", "$3.00 row 5": "charge", "5 \u0085$3.00": "product", "Row $5.00x": "product",
        "Page 3": "header", "Sales Person: A": "header", "Colour": "header", "E-Mail": "header", "a@b.com": "header", "tel 416-555-0199": "header",
        "Wolf oven Model: AB1200": "product", "Model: AB1200 oven": "product", "Model oven": "header", "Wolf model (416) 555-0199": "header",
        "models": "product", "taxi": "product",
    }
    rows = spark.createDataFrame([(t,) for t in want], "text string")
    brand = rows.withColumn("t", F.trim("text")).withColumn("b", doc.known_brand(F.col("t")))
    got = {r.text: (r.x, r.y) for r in brand.select("text", doc.line_class(F.col("text")).alias("x"), doc.line_class(F.col("t"), F.col("b")).alias("y")).collect()}
    assert got == {k: (v, v) for k, v in want.items()}


def test_brands_and_models(spark):
    texts = {"fisher & paykel and GE": "GE", "FISHER & PAYKEL": "Fisher and Paykel", "lg, wolf": "Wolf", "sub-zero": "Sub-Zero", "wolfs": "", "ge": "GE"}
    rows = spark.createDataFrame([*[(t,) for t in texts], (None,)], "text string")
    got = {r.text: r.b for r in rows.select("text", doc.known_brand(F.col("text")).alias("b")).collect()}
    assert got == {**texts, None: ""}
    lines = {
        "S/N: 123, x": ("123", "S/N"), "Item # total": ("", ""), "oven AB-1200 CD3400": ("AB-1200", "model token"), "color QUOTE1 AB12": ("", ""),
        "sku a@b.com": ("", ""), "part 416-555-0199": ("", ""), "oven": ("", ""), "Model: $5": ("", ""),
    }
    rows = spark.createDataFrame([*[(t,) for t in lines], (None,)], "text string")
    got = {r.text: tuple(r.m) for r in rows.select("text", doc.model_of_line(F.col("text"), F.lit("")).alias("m")).collect()}
    assert got == {**lines, None: ("", "")}


def test_axes(spark):
    texts = ['36"W x 38"H x 24"D', "Width 3, Height is 4, depth: 5", "3 in W 4inches H 5 ' d", "36 inW", "W3", "no size", "3Wx", "1/2 \" w", "long 4 1/2", "7.5l", "high", "5 x 6", ""]
    rows = spark.createDataFrame([*[(t,) for t in texts], (None,)], "t string")
    axes = {a: dims.axis_text(F.trim("t"), a) for a in dims.AXES}
    got = rows.select("t", dims.parse_dims(F.col("t")).alias("p"), dims.has_complete_3d(F.col("t")).alias("full"), F.struct(*[v.alias(a) for a, v in axes.items()]).alias("q")).collect()
    assert all(r.p == r.q for r in got)
    assert all(r.full == (r.q.width != "" and r.q.height != "" and r.q.depth != "") for r in got)
