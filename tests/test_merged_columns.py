"""joins of parser and model rows move the columns that are asked for, not whole rows."""

from __future__ import annotations

from skuloom.operators import documents as doc

COLUMNS = ("product_name", "brand", "model_sku", "dimensions", "supplier", "category", "notes")


def test_columns_that_nobody_asks_for_are_not_joined(spark):
    texts = [f"concat('{c} ', id) AS {c}" for c in COLUMNS]
    parsed = spark.range(4).selectExpr("id % 2 AS doc_id", "id AS position", *texts, "CAST(id AS INT) AS quantity", "repeat('x', 5) AS left_aside")
    model = spark.range(3).selectExpr("id % 2 AS doc_id", "id AS position", *texts, "CAST(id AS INT) AS quantity", "repeat('y', 5) AS right_aside")
    merged = doc.merge_rows(parsed, model)
    narrow = merged.select("doc_id", "p_position", "m_position", "product_name", "ai_used")
    assert "aside" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in narrow.collect()} == {
        (0, 0, 0, "product_name 0", True), (0, 2, 2, "product_name 2", True), (1, 1, 1, "product_name 1", True), (1, 3, None, "product_name 3", False),
    }
    whole = {r.p_position: r for r in merged.collect()}
    assert whole[3].left_aside == "xxxxx" and whole[3].right_aside is None and whole[1].right_aside == "yyyyy"
    assert merged.columns[:3] == ["doc_id", "p_position", "m_position"] and not [c for c in merged.columns if c.startswith("_")]
