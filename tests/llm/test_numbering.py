"""The pipeline's verdicts hit the rows they were found for, even if the input is split anew between two jobs."""

import pytest
from pyspark.sql import functions as F

from skuloom.llm import pipeline
from skuloom.llm.common import stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("repeats", [1, 2])
def test_verdicts_hit_their_rows(spark, monkeypatch, repeats):
    rows = [(i // repeats, f"{'bad' if i % 3 else 'good'} text {i}", "en", "s", 12) for i in range(120)]
    docs = stored(spark.createDataFrame(rows, SCHEMA).repartition(12), "many-files")

    def verdicts(rows):
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        first = F.when(F.startswith("text", F.lit("good")), F.col("doc_id")).otherwise(-1)
        found = stored(rows.select("doc_id", first.alias("component_id")), "verdicts")
        spark.conf.set("spark.sql.files.minPartitionNum", "100")
        return found

    monkeypatch.setattr(pipeline, "ngram_join", verdicts)
    try:
        got = pipeline.dedupe_stage(spark, docs, "").select("text").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r[0] for r in got) == sorted(t for _, t, *_ in rows if t.startswith("good"))
