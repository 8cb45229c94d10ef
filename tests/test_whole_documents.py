"""Queries that group intake rows by document read the document's rows together."""

from collections import Counter, defaultdict

import pytest

from skuloom.functions import rules
from skuloom.operators import documents as doc
from skuloom.plans.documents import _sides
from skuloom.registry import all_queries
from skuloom.sources.sample_views import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def intake(spark):
    return view(spark, SF, "intake_wide")


@pytest.fixture(scope="module")
def orders(spark):
    """Order keys with lines, read from the table itself."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    return {r[0] for r in lines.select("l_orderkey").distinct().collect()}


def test_needs_ai_parse_sees_the_rows_of_a_document(spark, intake, orders):
    lowest = defaultdict(lambda: 100)
    for row_id, score in intake.select("row_id", rules.parse_confidence(intake)).collect():
        lowest[row_id // 100000190] = min(lowest[row_id // 100000190], score)
    assert set(lowest) == orders
    got = {r["doc_id"]: r for r in all_queries()["needs_ai_parse"](spark, SF).collect()}
    assert {d for d, r in got.items() if r["reason"] != "deterministic parser returned no rows"} == orders
    assert all(got[d]["needs_parse"] == (lowest[d] < 90) for d in orders)


def test_merge_parser_ai_numbers_the_rows_of_a_document(spark, intake, orders):
    rows = intake.select("row_id", rules.norm_token(intake.model_sku)).collect()
    size = Counter((row_id // 100000190, key) for row_id, key in rows if key)
    got = all_queries()["merge_parser_ai"](spark, SF).collect()
    assert {r["doc_id"] for r in got} <= orders
    assert Counter((r["doc_id"], r["model_key"]) for r in got) == size
    assert len({d for d, _ in size}) < len(got)


def test_merge_parser_ai_pairs_leaves_no_row_out(spark, intake, orders):
    ids = {r[0] for r in intake.select("row_id").collect()}
    got = all_queries()["merge_parser_ai_pairs"](spark, SF).collect()
    left = [r["p_position"] for r in got if r["p_position"] is not None]
    right = [r["m_position"] for r in got if r["m_position"] is not None]
    assert sorted(left) == sorted(ids) and sorted(right) == sorted(i for i in ids if i % 3 > 0)
    assert {r["doc_id"] for r in got} == orders
    assert all(p // 100000190 == r["doc_id"] for r in got for p in (r["p_position"], r["m_position"]) if p is not None)
    assert any(r["p_position"] != r["m_position"] for r in got if r["p_position"] is not None and r["m_position"] is not None)


def test_sides_of_one_document(spark):
    """Four parser rows of one model in one order, of which the model saw three: the k-th meets the k-th."""
    starts = [(7 * 10 + line) * 10000019 for line in (1, 2, 2, 3)]
    ids = [s + 3 * k + (rest - s) % 3 for k, (s, rest) in enumerate(zip(starts, (0, 1, 2, 1), strict=True))]
    blank = ", ".join(f"'' AS {c}" for c in ("dimensions", "supplier", "category", "finish_color", "price", "notes"))
    df = spark.createDataFrame([(i,) for i in ids], "row_id bigint").selectExpr(
        "row_id", "'Sink' AS product_name", "'Wolf' AS brand", "'M-1' AS model_sku", "2L AS quantity", *blank.split(", ")
    )
    parsed, model = _sides(df)
    seen = sorted(i for i in ids if i % 3 > 0)
    got = sorted((r["doc_id"], r["nth"], r["p_position"], r["m_position"]) for r in doc.merge_by_model(parsed, model).collect())
    assert got == [(7, k + 1, p, seen[k] if k < len(seen) else None) for k, p in enumerate(sorted(ids))]
    assert len(seen) == 3
