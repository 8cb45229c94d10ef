"""Review checks, eligibility split and review reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.functions import rules
from skuloom.functions.text import distinct_ci, looks_like_notes, strip


def apply_checks(df: DataFrame, target: str = "Import") -> DataFrame:
    """Score, review flag, missing fields and action; ignored rows are switched off."""
    rows = df.withColumn("_complete", rules.complete_dims(df)).withColumn("_score", rules.confidence_score(df))
    rows = rows.withColumn("_missing", rules.missing_fields(rows, F.col("_complete")))
    ignored = rules.is_ignored(rows)
    status = (
        F.when(ignored, F.lit("Ignored"))
        .when(rules.manual_gap(rows, F.col("_complete")), F.lit("Needs Enrichment"))
        .otherwise(F.col("status"))
    )
    return rows.withColumns(
        {
            "include": F.when(ignored, F.lit(False)).otherwise(F.col("include")),
            "status": status,
            "confidence_score": F.col("_score"),
            "review_required": rules.review_required(rows, F.col("_score"), F.col("_missing"), F.col("_complete")),
            "missing_fields": F.array_join("_missing", ", "),
            "suggested_action": rules.suggested_action(rows, F.col("_missing"), F.col("_complete"), target),
        }
    ).drop("_complete", "_score", "_missing")


def split_description(df: DataFrame) -> DataFrame:
    """Operational text moves from description and details to the notes, each text once."""
    description, details = strip(F.col("description")), strip(F.col("product_details"))
    to_notes, also = looks_like_notes(description), looks_like_notes(details)
    parts = F.array(
        strip(F.col("notes")), F.when(to_notes, description), F.when(also, details)
    )
    kept = F.filter(F.array_compact(parts), lambda p: p != "")
    return df.withColumns(
        {
            "clean_description": F.when(to_notes, F.lit("")).otherwise(description),
            "clean_details": F.when(also, F.lit("")).otherwise(details),
            "combined_notes": F.array_join(distinct_ci(kept), "\n\n"),
        }
    )


def with_eligibility(df: DataFrame, allow_blank: bool = False) -> DataFrame:
    """Add ``issues``; rows without issues may be sent."""
    if allow_blank:
        open_gate = {c: df[c] for c in df.columns} | {"review_required": F.lit(False)}
        issues = rules.eligibility_issues(open_gate, F.lit(True))
        gate = F.array_intersect(issues, F.array(F.lit("Not included"), F.lit("Ignored or excluded")))
        issues = F.when(rules.is_photo_only(df), issues).otherwise(gate)
    else:
        issues = rules.eligibility_issues(df, rules.complete_dims(df))
    return df.withColumn("issues", issues)


def split_eligible(df: DataFrame, allow_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    marked = with_eligibility(df, allow_blank)
    return marked.filter(F.size("issues") == 0).drop("issues"), marked.filter(F.size("issues") > 0)


def review_summary(df: DataFrame) -> DataFrame:
    """Counters of the review screen in one pass."""
    missing = rules.review_missing_fields(df, rules.complete_dims(df))
    rows = df.withColumn("_photo", rules.is_photo_only(df)).withColumn("_gaps", F.size(missing) > 0)
    active = F.col("include") & ~F.col("_photo")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(active & ~F.col("_gaps")).alias("ready"),
        F.count_if(active & F.col("_gaps")).alias("needs_review"),
        F.count_if(~F.col("include")).alias("ignored"),
        F.count_if("_photo").alias("photo_only"),
        F.coalesce(
            F.bround(F.avg(F.when(active, F.col("confidence_score"))), 0), F.lit(0.0)
        ).cast("int").alias("avg_confidence"),
        F.count_if(F.col("include") & F.contains(F.lower("source_type"), F.lit("enrich"))).alias("enriched"),
        F.count_if(F.col("include") & (strip(F.col("image_url")) != "")).alias("with_images"),
        F.count_if(F.col("include") & (strip(F.col("dimensions")) != "")).alias("with_dimensions"),
        F.count_if(F.col("include") & F.col("_gaps")).alias("open_rows"),
    )


def blocked_reasons(df: DataFrame) -> DataFrame:
    """Included rows that may not be sent, counted per reason class."""
    blockers = rules.send_blockers(df, rules.complete_dims(df))
    rows = df.filter("include").select(blockers.alias("blockers")).filter(F.size("blockers") > 0)
    known = F.array_intersect("blockers", F.array(F.lit("Missing dimensions"), F.lit("No category")))
    classes = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("other")))
    return rows.select(F.explode(classes).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def send_paths(df: DataFrame) -> DataFrame:
    """Sendable rows by path: link import or schedule entry."""
    ok = df.filter(F.size(rules.send_blockers(df, rules.complete_dims(df))) == 0)
    return ok.agg(
        F.count("*").alias("sendable"),
        F.count_if(rules.is_link_row(ok)).alias("link_rows"),
        F.count_if(~rules.is_link_row(ok)).alias("schedule_rows"),
    )


def parse_batches(rows: DataFrame, documents: DataFrame, doc: str) -> DataFrame:
    """Documents that need the model pass: no rows, or any row parsed below 90."""
    per_doc = rows.groupBy(doc).agg(F.min(rules.parse_confidence(rows)).alias("lowest"))
    return documents.join(per_doc, doc, "left").select(
        doc,
        (F.col("lowest").isNull() | (F.col("lowest") < 90)).alias("needs_parse"),
        F.when(F.col("lowest").isNull(), F.lit("deterministic parser returned no rows"))
        .when(F.col("lowest") < 90, F.lit("deterministic parse missing critical fields"))
        .otherwise(F.lit("deterministic parse complete"))
        .alias("reason"),
    )
