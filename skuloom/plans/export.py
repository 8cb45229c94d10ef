"""Export and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import rules, urls
from skuloom.operators import export, runlog, scoring
from skuloom.registry import query
from skuloom.sources import sinks
from skuloom.sources.sample_views import order_of


@query("intake_wide")
def weak_product_url(df):
    from skuloom.operators.candidates import weak_page_reason

    return df.select(
        "row_id",
        weak_page_reason(df.product_url).alias("enrichment_reason"),
        urls.export_url_problem(df.product_url, df.model_sku).alias("export_reason"),
    )


@query("intake_wide")
def source_notes_block(df):
    return export.with_source_block(df, "block").select("row_id", "block")


@query("intake_wide")
def export_dedupe(df):
    return export.mark_duplicates(df).select("row_id", "richness", "removed", "kept_row_id")


@query("intake_wide")
def export_row(df):
    return export.import_rows(export.prepare(df))


@query("intake_wide")
def sink_import_csv(df):
    """The import file as a table: 21 columns under their display names."""
    return sinks.import_table(export.import_rows(export.prepare(df)))


@query("intake_wide")
def export_debug(df):
    """All debug columns; those that the intake view lacks are derived from its row number, the last one is missing."""
    n = F.col("row_id")
    rows = df.withColumns({
        "category_confidence": F.when(n % 3 == 0, F.lit("high")).otherwise(F.lit("")), "category_source": F.lit("rules"),
        "local_image_path": F.when(n % 4 == 0, F.concat(F.lit("/images/"), n.cast("string"))).otherwise(F.lit("")),
        "image_filename": F.concat(n.cast("string"), F.lit(".jpg")), "dimension_lookup_status": F.col("dimensions_status"),
        "enrichment_error": F.when(n % 5 == 0, F.lit("timeout")),
    })
    return export.debug_rows(export.prepare(rows))


@query("intake_wide")
def export_qa_summary(df):
    return export.qa_summary(df)


@query("intake_wide")
def export_qa_issues(df):
    return export.qa_issues(df)


@query("intake_wide")
def section_counts(df):
    return export.section_counts(export.prepare(df))


@query("intake_wide")
def missing_field_histogram(df):
    return export.missing_histogram(export.prepare(df))


@query("intake_wide")
def image_manifest(df):
    return export.image_manifest(export.prepare(df))


@query("intake_wide")
def restore_order(df):
    """Rows back in input order after duplicate removal: a global range sort at the sink only."""
    return export.prepare(df).select("row_id", "product_name", "room").sort("row_id")


@query("intake_wide")
def split_eligible(df):
    marked = scoring.with_eligibility(df)
    return marked.select("row_id", (F.size("issues") == 0).alias("eligible"), rules.list_text(F.col("issues")).alias("issues"))


@query("intake_wide")
def split_eligible_blank_ok(df):
    marked = scoring.with_eligibility(df, allow_blank=True)
    return marked.select("row_id", rules.list_text(F.col("issues")).alias("issues"))


@query("intake_wide")
def send_blockers(df):
    return df.select("row_id", F.array_join(rules.send_blockers(df, rules.complete_dims(df)), "; ").alias("blockers"))


@query("intake_wide")
def review_summary(df):
    return scoring.review_summary(df)


@query("intake_wide")
def blocked_reason_counts(df):
    return scoring.blocked_reasons(df)


@query("intake_wide")
def send_path(df):
    return scoring.send_paths(df)


@query("intake_wide", "orders")
def needs_ai_parse(df, orders):
    rows = df.withColumn("doc_id", order_of("row_id"))
    return scoring.parse_batches(rows, orders.select(F.col("o_orderkey").alias("doc_id")), "doc_id")


@query("intake_wide", "region")
def section_exists(df, region):
    needed = df.select(F.col("category").alias("section"))
    existing = region.select(
        F.element_at(F.array(*[F.lit(x) for x in ("Appliance!", "CHAIR", "Other", "rugs", "Stone Tile")]), (F.col("r_regionkey") + 1).cast("int")).alias("section")
    )
    return runlog.missing_sections(needed, existing)


@query("events")
def run_log_stats(df):
    return runlog.run_stats(df.select(F.col("event_type").alias("status"), (F.col("user_id") % 3).alias("path_no"), F.col("value").alias("seconds")))


@query("events")
def failure_reasons(df):
    rows = df.select(F.concat(F.col("event_type"), F.lit(": code "), (F.col("user_id") % 7).cast("string")).alias("reason"))
    return runlog.most_common(rows, "reason")
