"""Queries whose input was filtered before read all of it."""

from skuloom.operators import documents as doc
from skuloom.plans.documents import _cells
from skuloom.registry import all_queries
from skuloom.sources.sample_views import table, view

SF = "/root/testdata/sf0.001"


def test_dims_best_keeps_every_part(spark):
    want = sorted(r[0] for r in table(spark, SF, "part").select("p_partkey").collect())
    assert sorted(r["p_partkey"] for r in all_queries()["dims_best"](spark, SF).collect()) == want


def test_preferred_domain_hint_reads_the_memory_of_every_brand(spark):
    known = {r[0] for r in view(spark, SF, "source_memory").select("normalized_brand").collect()}
    got = {r["brand_key"]: r["hint"] for r in all_queries()["preferred_domain_hint"](spark, SF).collect()}
    assert any(b.endswith("3") for b in known)
    assert {got[b] for b in known} == {"maker.example.com"}


def test_first_seen_per_doc_reads_all_cells_and_lines(spark):
    names = ("doc_id", "product_name", "model_sku")
    cells = doc.cells_to_rows(_cells(view(spark, SF, "quote_cells"))).select(*names).collect()
    lines = doc.lines_to_rows(view(spark, SF, "quote_lines")).select(*names).collect()
    with_table = {r["doc_id"] for r in cells}
    want = {(r[0], r[1].strip().lower(), r[2].strip().lower()) for r in [*cells, *(x for x in lines if x["doc_id"] not in with_table)]}
    got = [tuple(r) for r in all_queries()["first_seen_per_doc"](spark, SF).select(*names).collect()]
    assert len(got) == len(want)
    assert {(d, n.strip().lower(), m.strip().lower()) for d, n, m in got} == want
