"""The kind of an answer's JSON is found once, although three forms ask for it."""

from __future__ import annotations

from skuloom.operators import documents as doc


def test_kind_is_found_once(spark):
    texts = ['x {"rows":[{"row_id":"1"},{"row_id":"2"}]} y', '[{"row_id":"3"}', '{"row_id":"4"}', '{"image_url":"https://a\\/b", "reason":"cut', "} none {", None, '{"image_url":"a\tb", "reason":"']
    out = doc.result_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, answer string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("schemaofvariant(") == 1
    got = [(r.doc_id, r.position, r.parse_status, r.result_row_id, r.result_image_url) for r in out.orderBy("doc_id", "position").collect()]
    assert got == [
        (0, 0, "strict_json", "1", None), (0, 1, "strict_json", "2", None), (1, 0, "json_repaired", "3", None), (2, 0, "strict_json", "4", None),
        (3, 0, "partial_recovery", None, "https://a/b"), (4, 0, "partial_recovery", None, None), (5, 0, "partial_recovery", None, None),
        (6, 0, "partial_recovery", None, "a\tb"),
    ]
