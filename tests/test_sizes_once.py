"""Sizes are read once per row and representative, links and sizes without searching the same letters again."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from skuloom.functions import dims, rules, urls
from skuloom.operators import enrich, export


def test_completeness_is_found_once_when_results_are_copied(spark):
    """the columns that ask for complete sizes share one search per row and one per representative."""
    texts = ("dimensions", "image_url", "product_url", *enrich.FORCED, *enrich.IF_BLANK, "budget_spent", "brand", "model_sku")
    blank = {"brand": "'B'", "model_sku": "'M'", "dimensions": "IF(id = 0, '1\"W x 2\"H x 3\"D', IF(id = 1, '4 wide', ''))"}
    df = spark.range(3).selectExpr("id AS row_id", *[f"{blank.get(c, repr(''))} AS {c}" for c in texts])
    reps = enrich.with_product_key(df).filter("row_id = 0")
    out = enrich.propagate(df, reps).select("row_id", "dimensions", "copied", "is_duplicate", "avoided")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("width|wide|w") <= 2
    size = '1"W x 2"H x 3"D'
    assert {tuple(r) for r in out.collect()} == {(0, size, "", False, 0), (1, size, "Dimensions", True, 1), (2, size, "Dimensions", True, 1)}
    assert not [c for c in enrich.propagate(df, reps).columns if c.startswith("_") or c in ("rep_full", "rep_budget")]


def test_long_runs_of_digits(spark):
    """F8: a run of digits is read once, not from each of its digits and for each of its lengths."""
    rows = spark.range(1).select(F.concat(F.repeat(F.lit("1"), F.lit(60000)), F.lit(' x 12/34/56"W, 2 7/8 in H')).alias("t"))
    start = time.time()
    got = rows.select(dims.parse_dims(F.col("t")).alias("p"), dims.has_complete_3d(F.col("t")).alias("f")).first()
    assert tuple(got.p) == ("34/56", "2 7/8", "", "") and not got.f
    assert time.time() - start < 30


def test_plain_links_are_not_split(spark):
    """F8: a plain link needs none of the parts that the reasons look at; others have the same reasons as before."""
    want = {
        "https://a.example.com": "", "http://a.b/x?y#z": "", " https://a.b ": "", "https://a.b/x y": "malformed URL: contains whitespace", "": "empty URL",
        "HTTPS://A.B/": "", "https://localhost/x": "", "https://10.0.0.1": "", "https://host/x": "malformed domain: host", "https://[bad": "Invalid IPv6 URL: Invalid IPv6 URL",
        "ftp://a.b": "malformed URL: unsupported scheme ftp", "https://a_b.c": "malformed domain: a_b.c", "https:///x": "malformed URL: missing host",
        "https://a.b:80/": "", "https://u@a.b/": "",
    }
    rows = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.p for r in rows.select("u", urls.url_problem(F.col("u")).alias("p")).collect()} == want
    plain = rows.filter("u = 'https://a.example.com'").select(F.when(urls.url_problem(F.col("u")) == "", F.lit(1)).alias("x"))
    assert "^https?://[a-z0-9-]+" in plain._jdf.queryExecution().optimizedPlan().toString()


def test_key_tokens_are_made_once(spark):
    """F2, F8: brand and model of a product key are normalised once each."""
    rows = spark.createDataFrame([("Sub-Zero", "A 1"), ("", "A"), (None, "A"), ("-", "-"), ("B", "")], "brand string, model_sku string")
    made = rows.select("brand", rules.product_key(rows.brand, rows.model_sku).alias("k"), export.identity(rows).alias("i"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+") <= 4
    got = {r.brand: (r.k, r.i) for r in made.collect()}
    assert got == {"Sub-Zero": ("subzero_a1", "subzero_a1"), "": ("_a", None), None: (None, None), "-": (None, None), "B": ("b_", None)}


def test_names_in_capitals(spark):
    """F8: names with a small letter at the beginning of a word earn no points for capitals."""
    names = {"Oven Big": 11, "Oven big": 8, "O'Neil 2Nd": 13, "2nd Oven": 8, "ÉTÉ": 3, "Été": 6, "4": 4, "": 0}
    fields = ("dimensions", "brand", "model_sku", "room", "supplier", "category", "finish_color", "material", "notes", "image_url", "product_url", "source_type")
    rows = spark.createDataFrame([(n,) for n in names], "product_name string").selectExpr("*", *[f"'' AS {c}" for c in fields])
    got = {r.product_name: r.x for r in rows.select("product_name", export.richness(rows, F.lit("")).alias("x")).collect()}
    assert got == names
    assert "(?<!" in rows.select(export.richness(rows, F.lit("")))._jdf.queryExecution().analyzed().toString()
