"""The stages of the corpus pipeline: quality rules, near-duplicate join, decontamination, secret redaction, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  ``run`` writes each stage's result as Parquet in the shared folder and reads it for the next.

Only the near-duplicate stage must tell equal rows apart and stores a numbered copy of its input.  The other verdicts depend on a
row's text alone (and its group's thresholds), so they are found again in the row itself or by the hash of its text: no
second copy of the texts is written.  Stage results stay in the shared folder until the caller clears it, since a lost executor may
make Spark read them again.

Defined results: equal rows get equal verdicts in all stages but the near-duplicate one, which keeps one of them; null texts fail the
quality rules; an empty table stays empty; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.llm.common import read_table, stored
from skuloom.llm.decontaminate import decontaminate
from skuloom.llm.mixing import mix
from skuloom.llm.ngram_join import ngram_join
from skuloom.llm.quality_rules import quality_filter
from skuloom.llm.secret_scan import may_hold, redacted, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_text(docs: DataFrame) -> DataFrame:
    """The documents with the hash of their text in place of their number."""
    return docs.select(*COLUMNS).withColumn("doc_id", F.sha2("text", 256))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs.select(*COLUMNS))


def dedupe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the first row stays.

    The numbers depend on how the input is split among tasks, so the numbered table is written once: the verdict and the
    rows it applies to must come from the same numbering.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    verdict = ngram_join(rows.withColumn("doc_id", F.col("row_id"))).filter("doc_id = component_id")
    return rows.join(verdict.select(F.col("doc_id").alias("row_id")), "row_id", "left_semi").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    verdict = decontaminate(by_text(docs), read_table(spark, sf_dir, "benchmark")).filter("contaminated")
    found = stored(verdict.select(F.col("doc_id").alias("hash")).distinct(), "contaminated")
    return docs.select(*COLUMNS).join(found, F.sha2("text", 256) == F.col("hash"), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All reported spans are masked in the text; rows without any sign of a secret are not shuffled."""
    docs = docs.select(*COLUMNS)
    signs = may_hold(F.coalesce(F.col("text"), F.lit("")))
    spans = secret_scan(by_text(docs.filter(signs)).withColumn("repository", F.col("doc_id")), repository="repository")
    spans = spans.filter(F.size("spans") > 0).groupBy(F.col("doc_id").alias("hash")).agg(F.first("spans").alias("spans"))
    some = docs.filter(signs).withColumn("hash", F.sha2("text", 256)).join(stored(spans, "spans"), "hash", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("spans")))
    masked = some.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*COLUMNS).unionByName(docs.filter(~signs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The account of the mix: how often each document's words are taken."""
    _, account = mix(docs)
    return account.select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", dedupe_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
