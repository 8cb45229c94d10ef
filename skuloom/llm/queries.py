"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.llm.common import read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.decontaminate import decontaminate

    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.warc import archive_round_trip

    return archive_round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture"
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.mixing import mix

    _, account = mix(read_table(spark, sf_dir, "documents"))
    return account.select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.ngram_join import ngram_join

    return ngram_join(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that stand in another document as well."""
    from skuloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words",
        F.aggregate("passages", F.lit(0).cast("bigint"), lambda a, p: a + p["end"] - p["start"]).alias("n_repeated"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("passages"),
    )


# Fixed rules of the URL filter: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no page labels, so a page takes the quality label of the document of its number."""
    from skuloom.llm.url_reputation import judge_urls

    outcomes = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(read_table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _held_out(docs: DataFrame, parts: int, part: int) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    return docs.withColumn("held_out", F.coalesce(remainder == part, F.lit(False)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.language_id import learn, predict

    docs = _held_out(read_table(spark, sf_dir, "documents"), 3, 1)
    return predict(docs, learn(docs.filter("NOT held_out")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.toxicity import fit, sample, toxicity

    docs = _held_out(read_table(spark, sf_dir, "documents"), 5, 0)
    return toxicity(docs, fit(*sample(docs.filter("NOT held_out"), read_table(spark, sf_dir, "labels"))))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.secret_scan import counts, secret_scan, span_text

    out = secret_scan(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", *counts(F.col("base")), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.quality_classifier import fit, quality, sample

    docs = _held_out(read_table(spark, sf_dir, "documents"), 4, 2)
    labels = _held_out(read_table(spark, sf_dir, "labels"), 4, 2)
    return quality(docs, fit(sample(docs.filter("NOT held_out"), labels.filter("NOT held_out"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skuloom.llm.conversation_repair import damaged, repair

    return repair(damaged(read_table(spark, sf_dir, "conversations")))[1]


VOCABULARIES = "/opt/tokenizers"


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str, vocabularies: str = VOCABULARIES) -> DataFrame:
    from skuloom.llm.token_alignment import align

    return align(read_table(spark, sf_dir, "documents"), f"{vocabularies}/byte_bpe_50k.json", f"{vocabularies}/piece_bpe_32k.model")[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_warc_index_merge, op3_mix_sources, op4_ngram_jaccard_join, op5_quality_rules,
        op6_url_reputation, op7_language_id, op8_toxicity, op9_secret_scan, op10_suffix_array_dedup,
        op11_quality_classifier, op12_conversation_repair, op13_cross_tokenizer_alignment,
    )
}
