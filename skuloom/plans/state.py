"""Enrichment-state queries: representatives, propagation, budgets, acceptance, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import rules
from skuloom.operators import enrich as en
from skuloom.registry import query


@query("intake_wide")
def elect_representative(df):
    return en.elect(df).select("product_key", "row_id", "effort")


@query("intake_wide")
def propagate_to_duplicates(df):
    return en.propagate(df, en.elect(df)).select(
        "row_id", "rep_id", "is_duplicate", "dimensions", "image_url", "product_url", "dimension_confidence",
        "category", "material", "copied", "avoided",
    )


@query("intake_wide")
def duplicate_metrics(df):
    return en.duplicate_metrics(df)


def _spent(df, cache):
    """Two rounds of 0.006 USD searches under a cap of 0.25 USD; products in the cache need no paid search."""
    from skuloom.functions import dims
    from skuloom.functions.text import has
    from skuloom.operators.budget import Round, spend_rounds
    from skuloom.operators.groups import stored

    # Rows without brand or model are products of their own that never qualify; the rounds read the products many times.
    keyed = df.filter(has(df["brand"]) & has(df["model_sku"]))
    products = en.ranked(en.qualification(en.elect(keyed)).filter("qualifies"))
    products = stored(products.select("product_key", "accessory", "effort", "dimensions").withColumn("tries", F.lit(0)), "budget-products")
    known = cache.select("product_key", F.col("dimensions").alias("cached"))

    def outcome(granted):
        found = granted.join(known, "product_key", "left")
        full = dims.has_complete_3d(F.coalesce(F.col("cached"), F.lit("")))
        return found.select(
            "product_key", F.when(F.col("cached").isNull(), 1).otherwise(0).alias("searches"),
            F.when(full, F.col("cached")).alias("dimensions"), (F.col("tries") + 1).alias("tries"),
        )

    rounds = [
        Round("manufacturer_spec", lambda p: F.lit(True)),
        Round("dimension_retry", lambda p: ~dims.has_complete_3d(p["dimensions"])),
    ]
    return spend_rounds(products, rounds, 0.25, 0.006, outcome, [F.asc("accessory"), F.desc("effort")])


@query("intake_wide", "product_cache")
def budget_rounds(df, cache):
    """Round one: as many searches as the cap pays for."""
    return _spent(df, cache)[0].filter("round = 0").select("product_key", "accessory", "effort", "granted")


@query("intake_wide", "product_cache")
def budget_rounds_retry(df, cache):
    """Round two: what the ledger has left, for products still without dimensions."""
    return _spent(df, cache)[0].filter("round = 1").select("product_key", "effort", "granted")


@query("intake_wide", "product_cache")
def budget_ledger(df, cache):
    return _spent(df, cache)[1]


@query("intake_wide")
def budget_greedy_skip(df):
    from skuloom.operators.budget import greedy_budget

    items = df.filter(en.needs_further(df)).select(
        (F.col("row_id") % 5).alias("run_id"),
        F.col("row_id").alias("ordinal"),
        en.prompt_cost(F.length("product_name") * 40 + F.length("notes")).alias("cost"),
    )
    return greedy_budget(items, 0.25, 0.0016).filter("granted").select("run_id", "ordinal")


@query("intake_wide")
def needs_further(df):
    return df.select(
        "row_id",
        en.needs_further(df).alias("needs"),
        en.needs_further(df, 100).alias("needs_scaled"),
        F.array_join(en.further_gaps(df), ", ").alias("gaps"),
    )


@query("intake_wide")
def confidence_text(df):
    value = F.when(df.row_id % 4 == 0, F.concat((df.row_id % 120).cast("string"), F.lit("%"))).when(
        df.row_id % 4 == 1, F.lit("0.7")
    ).when(df.row_id % 4 == 2, F.lit("Medium")).otherwise(F.lit("about right"))
    return df.select("row_id", en.confidence_text(value).alias("label"))


@query("intake")
def further_cost(df):
    return df.select(
        "row_id",
        F.round(en.prompt_cost(F.length("product_name") + F.col("quantity")), 9).alias("prompt_cost"),
        F.round(en.screen_cost(df.row_id % 60, F.lit(0.25)), 9).alias("screen_cost"),
    )


def _results(df):
    """One extraction result for two of three row ids, as the model pass would store it; rows that share an id share it."""
    n = df.row_id
    return df.filter(n % 3 > 0).select("row_id").distinct().select(
        "row_id",
        F.when(n % 4 == 0, F.lit("high")).when(n % 4 == 1, F.lit("0.7")).otherwise(F.lit("low")).alias("res_confidence"),
        F.when(n % 8 == 1, F.lit("92%")).otherwise(F.lit("")).alias("res_dimension_confidence"),
        (n % 11 > 0).alias("res_safe_to_write"),
        F.when(n % 5 == 0, F.lit("cutout")).otherwise(F.lit("overall")).alias("res_dimension_type"),
        F.when(n % 2 == 0, F.lit('10"W x 20"H x 30"D')).otherwise(F.lit("")).alias("res_dimensions"),
        F.when(n % 7 > 1, F.lit("https://cdn.example.com/new.jpg")).otherwise(F.lit("http://x")).alias("res_image_url"),
        F.lit("https://maker.example.com/p/new").alias("res_product_page_url"),
        F.when(n % 2 == 1, F.lit("https://maker.example.com/s.pdf")).otherwise(F.lit("")).alias("res_spec_sheet_url"),
    )


@query("intake_wide")
def accept_result(df):
    joined = df.join(_results(df), "row_id", "left")
    return en.accept_result(joined, 100).select(
        "row_id", "dimensions", "image_url", "product_url", "spec_sheet_url", "filled", "recovered", "result_status"
    )


@query("intake_wide")
def join_result_by_row_id(df):
    """Category suggestions joined by row id, applied to blank categories."""
    got = df.filter((F.col("category") == "") & (F.col("row_id") % 2 == 0)).select(
        "row_id", F.lit("Seating").alias("new_category"), (F.col("row_id") % 100).cast("int").alias("new_confidence")
    ).distinct()
    j = df.join(got, "row_id", "left")
    hit = F.col("new_category").isNotNull() & (F.col("category") == "")
    weak = hit & (F.col("new_confidence") < 75)
    return j.select(
        "row_id",
        F.when(hit, F.col("new_category")).otherwise(F.col("category")).alias("category"),
        F.when(hit, F.col("new_confidence")).otherwise(F.lit(0)).alias("ai_category_confidence"),
        F.when(hit, F.lit("AI Suggested")).otherwise(F.lit("Unknown")).alias("category_source"),
        (F.col("review_required") | weak).alias("review_required"),
    )


@query("intake_wide")
def apply_extracted(df):
    n = df.row_id
    rows = df.withColumns(
        {
            "ext_dimensions": F.when(n % 4 == 0, F.lit('10"W x 20"H x 30"D')).when(n % 4 == 1, F.lit('10"W x 20"H')).when(n % 4 == 2, F.lit('10"W')).otherwise(F.lit("")),
            "ext_materials": F.when(n % 3 == 0, F.lit("Brass")).otherwise(F.lit("")),
            "ext_finish": F.lit("Nickel"),
            "ext_name": F.lit("Found name"),
            "ext_category": F.lit("sofa"),
            "ext_url": F.lit("https://maker.example.com/e"),
            "ext_score": (n % 100).cast("int"),
        }
    )
    return en.apply_extracted(rows).select(
        "row_id", "dimensions", "dimension_confidence", "product_name", "finish_color", "category", "product_url", "notes",
        "source_type", "review_required",
    )


@query("intake_wide")
def fill_from_page(df):
    n = df.row_id
    rows = df.withColumns(
        {
            "pg_name": F.lit("Page name"), "pg_brand": F.when(n % 2 == 0, F.lit("Page brand")).otherwise(F.lit("")),
            "pg_finish": F.lit("Chrome"), "pg_material": F.lit(""), "pg_category": F.lit("Seating"),
            "pg_description": F.lit("A long text"), "pg_url": F.lit("https://maker.example.com/page"),
            "pg_confidence": F.when(n % 3 == 0, F.lit("medium")).otherwise(F.lit("high")),
        }
    )
    return en.fill_from_page(rows).select(
        "row_id", "product_name", "brand", "finish_color", "material", "category", "notes", "product_url", "source_type", "review_required", "page_filled"
    )


@query("intake_wide")
def mark_failed(df):
    reason = F.when(df.row_id % 3 == 0, F.lit("")).when(df.row_id % 3 == 1, F.lit("no confident source found")).otherwise(F.lit("HTTP 404"))
    return en.mark_failed(df, reason).select("row_id", "notes", "review_required", "suggested_action", "status", "enrichment_status", "enrichment_error")


@query("intake_wide")
def preserve_audit(df):
    rows = df.withColumn("new_source", F.when(df.row_id % 2 == 0, F.lit("https://new.example.com")).otherwise(F.lit(" ")))
    kept = en.keep_audit(rows, {"dimension_source_url": "new_source"})
    stage = F.when(F.col("row_id") % 2 == 0, F.lit("page_fetch")).otherwise(F.lit("complete"))
    return kept.select("row_id", "dimension_source_url", en.add_stage(F.col("stage_log"), stage).alias("stage_log"))


@query("intake_wide")
def enrichment_status(df):
    return en.status_columns(df).select(
        "row_id", "dimensions_status", "image_status", "source_status", "product_component_type", "enrichment_status", "retry"
    )


@query("intake_wide")
def status_badges(df):
    return df.select("row_id", F.array_join(en.badges(df), ", ").alias("badges"))


@query("intake_wide")
def enrichment_summary(df):
    return en.enrichment_summary(df)


@query("intake_wide")
def product_groups(df):
    return en.product_groups(df)


@query("intake_wide")
def product_group_members(df):
    return en.group_members(df)


@query("intake_wide")
def debug_report_sections(df):
    return en.debug_report(df)


@query("intake_wide")
def dimension_diagnostics(df):
    return en.distinct_diagnostics(df).select("product_key", "enrichment_status", "dimension_source_url", "dimensions_status", "row_id")


@query("intake_wide")
def charge_rows(df):
    return df.filter(rules.is_charge(df)).select("row_id", "price", "import_type")
