"""The items of an answer are read once, in a column, and only then exploded."""

from __future__ import annotations

from skuloom.operators import documents as doc


def test_answer_is_read_outside_the_generator(spark):
    df = spark.createDataFrame([(1, 'x ```json\n[{"room":"bar – maybe"},{“room”:"den"}]\n```'), (2, "none"), (3, "[]"), (4, None)], "doc_id long, answer string")
    out = doc.items_of(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(_items" in plan and plan.count("from_json") == 1
    assert [(r.doc_id, r.position, r.item.room) for r in out.orderBy("position").collect()] == [(1, 0, "bar – maybe"), (1, 1, "den")]
    rows = doc.item_rows(out).orderBy("position").collect()
    assert [(r.room, r.confidence_score) for r in rows] == [("Bar", 35), ("Den", 50)]
