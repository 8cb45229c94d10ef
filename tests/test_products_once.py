"""Products of the lookup rounds are elected once, although every round reads them several times."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.operators import budget
from skuloom.plans import state
from skuloom.registry import source


def test_rounds_read_the_written_products(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(budget, "spend_rounds", lambda products, *rest: seen.append(products))
    state._spent(source(spark, "/root/testdata/sf0.001", "intake_wide").limit(300), source(spark, "/root/testdata/sf0.001", "product_cache"))
    files = seen[0].inputFiles()
    assert files and all("/budget-products-" in f for f in files)
    assert seen[0].filter(F.startswith("product_key", F.lit("~"))).isEmpty()
