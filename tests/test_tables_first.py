"""Table rows are made once, and lines of their pages are left out before the line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.operators import documents as doc


def test_lines_of_table_pages_are_left_out_before_the_rules(spark):
    """line rules run on pages without table rows only, and the table rows are made once."""
    tables = spark.createDataFrame([(1, 1, 3, "Oven", "M1"), (1, 1, 2, "oven ", "m1")], "doc_id long, page int, row_no int, product_name string, model_sku string")
    lines = spark.createDataFrame([(1, 1, 1, "never"), (1, 2, 4, "Sink"), (2, 1, 5, "Oven"), (None, 1, 6, "Tap")], "doc_id long, page int, row_no int, text string")

    def to_rows(rest):
        name = F.when(F.col("text") == "never", F.raise_error(F.lit("a line of a table page"))).otherwise(F.col("text"))
        return rest.select("doc_id", "page", "row_no", name.alias("product_name"), F.lit("").alias("model_sku"))

    got = doc.prefer_tables(tables, lines, to_rows)
    assert any("/table-rows-" in f for f in got.inputFiles())
    want = {(1, 1, 2, "oven ", "m1"), (1, 2, 4, "Sink", ""), (2, 1, 5, "Oven", ""), (None, 1, 6, "Tap", "")}
    assert {tuple(r) for r in got.collect()} == want
