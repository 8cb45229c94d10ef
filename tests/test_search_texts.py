"""The lookup texts of a row are built once, in a column, and only then exploded."""

from __future__ import annotations

from skuloom.operators import candidates as cand


def test_list_is_built_outside_the_generator(spark):
    df = spark.createDataFrame([(1, "Wolf", "DEC 30 R/L", " Oven ", "appliance")], "row_id long, brand string, model_sku string, product_name string, category string")
    sites = spark.createDataFrame([("wolf", 0, "maker.example.com")], "brand_key string, site_rank int, domain string")
    out = cand.work_list(df, sites)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(queries" in plan and plan.count('"Width" "Height" "Depth"') == 1
    got = [r.query for r in out.orderBy("position").collect()]
    assert len(got) == len(set(got)) and got[1] == 'site:maker.example.com "DEC 30 R/L" product'
    assert got[0].startswith('site:maker.example.com ("DEC 30 R/L" OR "DEC30R/L" OR "DEC30RL"')
