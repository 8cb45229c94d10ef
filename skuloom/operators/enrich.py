"""Enrichment state: qualification, representatives, propagation, budgets, result acceptance, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.functions import dims, rules, urls
from skuloom.functions.text import add_points, flags_to_list, has, staged, strip
from skuloom.operators.candidates import query_gaps, weak_page_reason
from skuloom.operators.keyed import attach, first_per, number_within, own_key, top_per


def qualification(df: DataFrame) -> DataFrame:
    """Add ``qualifies``, the gap list and the three skip flags."""
    gaps = F.array_join(query_gaps(df), ", ")
    rows = df.withColumn("gaps", gaps).withColumn(
        "_recover", ~dims.has_complete_3d(F.col("dimensions")) | ~urls.is_https(F.col("image_url"))
    )
    done = F.endswith(strip(F.col("source_type")), F.lit("_Enriched"))
    no_brand, no_model = strip(F.col("brand")) == "", strip(F.col("model_sku")) == ""
    return rows.withColumns(
        {
            "qualifies": ~no_brand & ~no_model & F.when(done, F.col("_recover")).otherwise(F.col("gaps") != ""),
            "skip_source_type": done & ~F.col("_recover"),
            "skip_no_brand": no_brand,
            "skip_no_model": no_model,
        }
    ).drop("_recover")


def source_links(c, extra_json: Column) -> Column:
    """First four distinct usable links of a row: fields first, then the stored JSON links."""
    fields = [c[x] for x in ("product_url", "selected_product_url", "dimension_source_url", "spec_sheet_url", "image_source_url")]
    stored = F.transform(
        F.coalesce(F.from_json(extra_json, "array<struct<url:string>>"), F.array().cast("array<struct<url:string>>")),
        lambda e: e["url"],
    )
    every = F.concat(F.array(*[strip(x) for x in fields]), stored)
    return F.slice(F.array_distinct(F.filter(every, lambda u: u.isNotNull() & urls.is_fetchable(u))), 1, 4)


def dimension_confidence(axes: Column, manufacturer: Column, exact_model: Column) -> Column:
    return (
        F.when((axes >= 3) & manufacturer & exact_model, F.lit("high"))
        .when(axes >= 3, F.lit("medium"))
        .when(axes >= 1, F.lit("low"))
        .otherwise(F.lit("none"))
    )


def model_confidence(variant: Column, model: Column, manufacturer: Column) -> Column:
    """Exact spelling: high for the manufacturer, else medium; same letters: medium; else low."""
    a, b = F.lower(strip(variant)), F.lower(strip(model))
    return (
        F.when(a == b, F.when(manufacturer, F.lit("high")).otherwise(F.lit("medium")))
        .when(F.regexp_replace(a, r"[\s-]+", "") == F.regexp_replace(b, r"[\s-]+", ""), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def confidence_text(value: Column) -> Column:
    """Words, fractions and percentages to high / medium / low; unreadable text stays."""
    text = F.lower(strip(value))
    number = F.rtrim(text, F.lit("%")).try_cast("double")
    share = F.when(number > 1, number / 100).otherwise(number)
    return (
        F.when(text.isin("", "high", "medium", "low", "none") | number.isNull(), text)
        .when(share >= 0.8, F.lit("high"))
        .when(share >= 0.6, F.lit("medium"))
        .when(share > 0, F.lit("low"))
        .otherwise(text)
    )


LABELS = ("dimension_confidence", "image_confidence", "selected_product_url_confidence")


def low_confidence(c, score_scale: float = 1.0) -> Column:
    """Any label low or none.  Scores are compared with 0.75 on ``score_scale`` (1 as read, 100 intended)."""
    labels = urls.any_of([confidence_text(c[x]).isin("low", "none") for x in LABELS])
    score = F.coalesce(c["confidence_score"], F.lit(0)) / F.lit(score_scale)
    return labels | ((score > 0) & (score < 0.75))


def further_gaps(c, score_scale: float = 1.0) -> Column:
    return flags_to_list(
        [
            (~dims.has_complete_3d(c["dimensions"]), "dimensions"),
            (~urls.is_https(c["image_url"]), "image"),
            (strip(c["product_url"]) == "", "product_page_url"),
            (strip(c["spec_sheet_url"]) == "", "spec_sheet_url"),
            (low_confidence(c, score_scale), "low_confidence"),
        ]
    )


def needs_further(c, score_scale: float = 1.0) -> Column:
    return (
        c["include"]
        & ~rules.is_charge(c)
        & (
            ~dims.has_complete_3d(c["dimensions"])
            | ~urls.is_https(c["image_url"])
            | low_confidence(c, score_scale)
        )
    )


# Token prices and output cap of the cost estimate.
INPUT_PER_1K, OUTPUT_PER_1K, OUTPUT_TOKENS = 0.00015, 0.00060, 2200


def prompt_cost(characters: Column) -> Column:
    tokens = F.greatest(F.lit(1), F.ceil(characters / 4))
    return tokens / 1000 * F.lit(INPUT_PER_1K) + F.lit(OUTPUT_TOKENS / 1000 * OUTPUT_PER_1K)


def screen_cost(candidates: Column, cap: Column) -> Column:
    raw = F.least(cap, F.greatest(F.lit(0.0025), F.lit(0.006) * candidates + F.lit(0.004)))
    return F.when(candidates == 0, F.lit(0.0)).otherwise(raw)


# ------------------------------------------------------------------ representatives


def effort_richness(c) -> Column:
    return add_points(
        [
            (has(c[x]), 1)
            for x in (
                "product_url", "image_url", "dimensions", "product_name", "supplier", "room", "finish_color", "material",
            )
        ]
    ) + F.when(dims.has_complete_3d(c["dimensions"]), 3).otherwise(0) - F.when(
        weak_page_reason(c["product_url"]) != "", 2
    ).otherwise(0)


def with_product_key(df: DataFrame) -> DataFrame:
    """Key of the enrichment group; rows without brand or model form their own."""
    both = has(df["brand"]) & has(df["model_sku"])
    key = F.when(both, rules.product_key(df["brand"], df["model_sku"]))
    return df.withColumn("product_key", own_key(key, F.col("row_id")))


def elect(df: DataFrame) -> DataFrame:
    """One representative per product: most complete row, first on ties."""
    rows = with_product_key(df)
    rows = rows.withColumn("effort", effort_richness(rows))
    return first_per(rows, ["product_key"], [F.desc("effort"), F.asc("row_id")])


FORCED = (
    "dimension_source_url", "dimension_confidence", "dimension_source_type", "image_confidence",
    "image_source_url", "selected_product_url", "selected_product_url_confidence",
)
IF_BLANK = ("category", "finish_color", "material")


def propagate(df: DataFrame, reps: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """Copy each representative's results to the other rows of its product, and those of the columns ``own`` to its own row."""
    cols = ("dimensions", "image_url", "product_url", *FORCED, *IF_BLANK)
    best = reps.select(
        "product_key", F.col("row_id").alias("rep_id"), F.col("budget_spent").alias("rep_budget"),
        dims.has_complete_3d(F.col("dimensions")).alias("rep_full"),
        *[F.col(c).alias(f"rep_{c}") for c in cols],
    )
    # Whether the sizes are complete is found once per representative and once per row: several columns ask for it.
    rows = staged(attach(with_product_key(df), best, ["product_key"]), {"_own_full": dims.has_complete_3d(F.col("dimensions"))})
    other = F.col("rep_id").isNotNull() & (F.col("rep_id") != F.col("row_id"))
    itself = F.coalesce(F.col("rep_id") == F.col("row_id"), F.lit(False))

    def rep(c):
        return F.coalesce(F.col(f"rep_{c}"), F.lit(""))

    own_full = F.col("_own_full")
    take = {
        "dimensions": (rep("dimensions") != "") & (~own_full | F.coalesce("rep_full", F.lit(False))),
        "image_url": (rep("image_url") != "")
        & (~urls.is_https(F.col("image_url")) | (F.col("image_url") != rep("image_url"))),
        "product_url": (rep("product_url") != "") & (F.col("product_url") != rep("product_url")),
    }
    take.update({c: (rep(c) != "") & (F.col(c) != rep(c)) for c in FORCED})
    take.update({c: (rep(c) != "") & (strip(F.col(c)) == "") for c in IF_BLANK})
    filled = [(take["dimensions"] & ~own_full, "Dimensions")]
    filled += [(cond, c) for c, cond in take.items() if c != "dimensions"]
    searches = F.regexp_extract(F.coalesce("rep_budget", F.lit("")), r"searches=(\d+)/", 1).try_cast("int")
    out = rows.withColumn("copied", F.when(other, F.array_join(flags_to_list(filled), ", ")).otherwise(F.lit("")))
    kept = {c: F.when(itself, F.coalesce(f"rep_{c}", c)).otherwise(F.col(c)) if c in own else F.col(c) for c in take}
    out = out.withColumns({c: F.when(other & cond, rep(c)).otherwise(kept[c]) for c, cond in take.items()})
    return out.withColumns(
        {
            "is_duplicate": other,
            "avoided": F.when(other, F.greatest(F.lit(1), F.coalesce(searches, F.lit(0)))).otherwise(F.lit(0)),
        }
    ).drop(*[f"rep_{c}" for c in cols], "rep_budget", "rep_full", "_own_full")


def duplicate_metrics(df: DataFrame) -> DataFrame:
    """Products worked on and duplicate rows saved."""
    rows = qualification(df).filter("qualifies")
    groups = with_product_key(rows).groupBy("product_key").agg(F.count("*").alias("n"))
    return groups.agg(
        F.count("*").alias("products"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )


# ------------------------------------------------------------------ budgets

# Fixed value: words of accessories and components.
ACCESSORY = (
    r"\b(?:trim|panel|kit|blower|filter|accessor(?:y|ies)|component|insert|sleeve|handle|grille)\b"
)


def component_type(c) -> Column:
    text = F.lower(F.concat_ws(" ", c["product_name"], c["notes"], c["category"], c["model_sku"]))
    part = F.rlike(text, F.lit(ACCESSORY)) | F.rlike(strip(c["model_sku"]), F.lit(r"^\d{4,7}$"))
    return F.when(part, F.lit("accessory/component")).otherwise(F.lit("primary_product"))


def ranked(reps: DataFrame) -> DataFrame:
    """Products with ``accessory``, by which lookups are ranked: primary products first, then the most complete."""
    return reps.withColumn("accessory", F.when(component_type(reps) == "accessory/component", 1).otherwise(0))


# ------------------------------------------------------------------ results


def accept_result(df: DataFrame, score_scale: float = 1.0) -> DataFrame:
    """Gate and merge an extraction result joined to each row as ``res_*`` columns."""
    conf = confidence_text(F.col("res_confidence"))
    dim_conf = confidence_text(
        F.when(strip(F.col("res_dimension_confidence")) != "", F.col("res_dimension_confidence")).otherwise(F.col("res_confidence"))
    )
    rows = df.withColumns(
        {
            "_conf": conf,
            "_dconf": dim_conf,
            "_own_high": (confidence_text(F.col("dimension_confidence")) == "high")
            | (F.coalesce(F.col("confidence_score"), F.lit(0)) / F.lit(score_scale) >= 0.9),
            "_full": dims.has_complete_3d(F.col("dimensions")),
            "_icur": confidence_text(F.col("image_confidence")),
        }
    )
    safe = F.coalesce(F.col("res_safe_to_write"), F.lit(True))
    product = F.lower(strip(F.col("res_dimension_type"))).isin("", "overall", "product", "unknown", "none")
    ok = {
        "Dimensions": safe
        & (strip(F.col("res_dimensions")) != "")
        & F.col("_dconf").isin("high", "medium")
        & product
        & ~F.col("_own_high")
        & ~F.col("_full"),
        "Image URL": safe
        & urls.is_https(F.col("res_image_url"))
        & F.col("_conf").isin("high", "medium")
        & (~urls.is_https(F.col("image_url")) | F.col("_icur").isin("low", "none")),
        "Product URL": safe & urls.is_https(F.col("res_product_page_url")) & (strip(F.col("product_url")) == ""),
        "spec_sheet_url": safe & urls.is_https(F.col("res_spec_sheet_url")) & (strip(F.col("spec_sheet_url")) == ""),
    }
    ok = {k: F.coalesce(v, F.lit(False)) for k, v in ok.items()}
    targets = {
        "Dimensions": ("dimensions", "res_dimensions"),
        "Image URL": ("image_url", "res_image_url"),
        "Product URL": ("product_url", "res_product_page_url"),
        "spec_sheet_url": ("spec_sheet_url", "res_spec_sheet_url"),
    }
    out = rows.withColumn("filled", F.array_join(flags_to_list([(c, k) for k, c in ok.items()]), ", "))
    out = out.withColumn(
        "recovered",
        F.array_join(
            flags_to_list(
                [
                    (strip(F.col("res_dimensions")) != "", "dimensions"),
                    (strip(F.col("res_image_url")) != "", "image"),
                    (strip(F.col("res_product_page_url")) != "", "product_page_url"),
                    (strip(F.col("res_spec_sheet_url")) != "", "spec_sheet_url"),
                ]
            ),
            ", ",
        ),
    )
    out = out.withColumns(
        {t: F.when(ok[k], strip(F.col(s))).otherwise(F.col(t)) for k, (t, s) in targets.items()}
    )
    status = F.when(F.col("res_confidence").isNull(), F.lit("no_result")).when(
        F.col("filled") != "", F.lit("updated")
    ).otherwise(F.lit("no_verified_fields"))
    return out.withColumn("result_status", status).drop("_conf", "_dconf", "_own_high", "_full", "_icur")


def _marked_source(source: Column) -> Column:
    return (
        F.when(source == "", F.lit("Enriched"))
        .when(F.endswith(source, F.lit("_Enriched")), source)
        .otherwise(F.concat(source, F.lit("_Enriched")))
    )


def apply_extracted(df: DataFrame) -> DataFrame:
    """Blank fields from extracted values (``ext_*``), complete dimensions always, one axis to the notes."""
    dim = strip(F.col("ext_dimensions"))
    rows = df.withColumns(
        {"_new": dims.axis_count(dims.parse_dims(dim)), "_old": dims.axis_count(dims.parse_dims(F.col("dimensions")))}
    )
    full = F.col("_new") >= 3
    part = (F.col("_new") == 2) & (F.col("_old") < 2)
    noted = (dim != "") & ~full & ~part
    note = F.concat(F.lit("[Partial dimension found: "), dim, F.lit("; full W x H x D still needed]"))
    material = strip(F.col("ext_materials"))
    tag = F.concat(F.lit("[Materials: "), material, F.lit("]"))
    finish = F.when(strip(F.col("finish_color")) == "", strip(F.col("ext_finish"))).otherwise(F.col("finish_color"))
    add = F.concat_ws(
        " ",
        F.nullif(strip(F.col("notes")), F.lit("")),
        F.when(noted & ~F.contains(F.col("notes"), note), note),
        F.when((material != "") & ~F.contains(F.lower(finish), F.lower(material)), tag),
    )
    weak = F.col("ext_score") < 60
    return rows.withColumns(
        {
            "dimensions": F.when(full | part, dim).otherwise(F.col("dimensions")),
            "dimension_confidence": F.when(
                full, F.when(F.col("ext_score") >= 80, F.lit("high")).otherwise(F.lit("medium"))
            )
            .when(part, F.lit("medium"))
            .otherwise(F.col("dimension_confidence")),
            "product_name": F.when(strip(F.col("product_name")) == "", strip(F.col("ext_name"))).otherwise(F.col("product_name")),
            "finish_color": finish,
            "category": F.when(
                strip(F.col("category")) == "", rules.normalize_category(F.col("ext_category"))
            ).otherwise(F.col("category")),
            "product_url": F.when(strip(F.col("product_url")) == "", F.col("ext_url")).otherwise(F.col("product_url")),
            "notes": add,
            "source_type": _marked_source(strip(F.col("source_type"))),
            "review_required": F.col("review_required") | weak,
        }
    ).drop("_new", "_old")


def fill_from_page(df: DataFrame) -> DataFrame:
    """Verified-page fields (``pg_*``) into blanks; a weak or blank link is replaced by the page."""
    pairs = (("product_name", "pg_name"), ("brand", "pg_brand"), ("finish_color", "pg_finish"), ("material", "pg_material"), ("category", "pg_category"))
    use = {t: (strip(F.col(t)) == "") & (strip(F.col(s)) != "") for t, s in pairs}
    noted = (strip(F.col("pg_description")) != "") & (strip(F.col("notes")) == "")
    link = weak_page_reason(F.col("product_url")) != ""
    names = {"product_name": "Product Name", "brand": "Brand", "finish_color": "Finish / Color", "material": "Material", "category": "Product Category"}
    filled = [(use[t], names[t]) for t, _ in pairs] + [(noted, "Notes"), (link, "Product URL")]
    out = df.withColumn("page_filled", F.array_join(flags_to_list(filled), ", "))
    out = out.withColumns({t: F.when(use[t], strip(F.col(s))).otherwise(F.col(t)) for t, s in pairs})
    return out.withColumns(
        {
            "notes": F.when(noted, F.concat(F.lit("[Description: "), F.left("pg_description", F.lit(500)), F.lit("]"))).otherwise(F.col("notes")),
            "product_url": F.when(link, F.col("pg_url")).otherwise(F.col("product_url")),
            "source_type": _marked_source(strip(F.col("source_type"))),
            "review_required": F.col("review_required") | (F.col("pg_confidence") == "medium"),
        }
    )


def mark_failed(df: DataFrame, reason: Column) -> DataFrame:
    """Failure tag in the notes once, forced review, status and error columns."""
    why = F.when(strip(reason) == "", F.lit("no verified product match")).otherwise(strip(reason))
    tag = F.concat(F.lit("[ENRICHMENT_FAILED: "), why, F.lit("]"))
    legacy = F.lit("[Enrichment: no confident source found]")
    old = F.contains(F.lower(why), F.lit("no confident source"))
    notes = F.concat_ws(
        " ",
        F.nullif(strip(F.col("notes")), F.lit("")),
        F.when(~F.contains(F.col("notes"), tag), tag),
        F.when(old & ~F.contains(F.col("notes"), legacy), legacy),
    )
    return df.withColumns(
        {
            "notes": notes,
            "review_required": F.lit(True),
            "suggested_action": F.concat(F.lit("ENRICHMENT_FAILED: "), why),
            "status": F.when(strip(F.col("status")) == "", F.lit("Needs Review")).otherwise(F.col("status")),
            "enrichment_status": F.lit("failed"),
            "enrichment_error": why,
        }
    )


def keep_audit(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """New audit values, or the earlier ones where the new run left a blank."""
    return df.withColumns(
        {old: F.coalesce(F.nullif(strip(F.col(new)), F.lit("")), F.col(old)) for old, new in pairs.items()}
    )


def add_stage(log: Column, stage: Column) -> Column:
    """Stage log with a new stage, each stage once."""
    parts = F.filter(F.transform(F.split(log, ";"), strip), lambda p: p != "")
    return F.array_join(F.array_distinct(F.array_append(parts, stage)), "; ")


# ------------------------------------------------------------------ status


def status_columns(df: DataFrame) -> DataFrame:
    """Enrichment, dimension, image, source and component status plus the retry hint."""
    full = dims.has_complete_3d(F.col("dimensions"))
    image = urls.is_https(F.col("image_url"))
    page = F.when(strip(F.col("selected_product_url")) != "", F.col("selected_product_url")).otherwise(F.col("product_url"))
    kind = F.lower(F.col("dimension_source_type"))
    maker = urls.domain_below(urls.site(page), F.lower(F.col("manufacturer_domain_used")))
    some = urls.any_of([has(F.col(x)) for x in ("product_url", "image_url", "dimensions")])
    rows = df.withColumns(
        {
            "dimensions_status": F.when(full, F.lit("complete"))
            .when(has(F.col("dimensions")), F.lit("partial"))
            .otherwise(F.lit("missing")),
            "image_status": F.when(image, F.lit("found"))
            .when(has(F.col("image_source_url")), F.lit("fallback"))
            .otherwise(F.lit("missing")),
            "source_status": F.when(F.contains(kind, F.lit("manufacturer")) | maker, F.lit("manufacturer"))
            .when(F.contains(kind, F.lit("retailer")), F.lit("dealer"))
            .when(strip(page) != "", F.lit("fallback"))
            .otherwise(F.lit("manual")),
            "product_component_type": component_type(df),
            "enrichment_status": F.when(~has(F.col("brand")) | ~has(F.col("model_sku")), F.lit("needs_review"))
            .when(full & image, F.lit("complete"))
            .when(some, F.lit("partially_enriched"))
            .otherwise(F.lit("needs_review")),
        }
    )
    hint = (
        F.when(F.col("dimensions_status").isin("missing", "partial"), F.lit("dimension-focused retry"))
        .when(F.col("image_status").isin("missing", "failed"), F.lit("image-only retry"))
        .otherwise(F.lit(""))
    )
    return rows.withColumn("retry", hint)


def badges(c) -> Column:
    """Distinct badges of a row, in order."""
    full, image = dims.has_complete_3d(c["dimensions"]), has(c["image_url"])
    partial = F.lower(c["dimensions_status"]) == "partial"
    spare = F.lower(c["image_status"]) == "fallback"
    return flags_to_list(
        [
            (full, "Complete dimensions"),
            (~full & partial, "Partial dimensions"),
            (~full & ~partial, "Missing dimensions"),
            (image, "Image found"),
            (~image & spare, "Fallback image"),
            (~image & ~spare, "Missing image"),
            (c["budget_blocked"], "Skipped due to budget"),
            (F.contains(F.lower(c["product_component_type"]), F.lit("accessory")), "Accessory/component"),
            (c["source_status"] == "manufacturer", "Manufacturer source"),
            (c["source_status"] == "dealer", "Dealer source"),
            (F.contains(F.lower(c["enrichment_status"]), F.lit("review")), "Needs review"),
        ]
    )


# ------------------------------------------------------------------ reports


def confidence_value(c) -> Column:
    """0.95 / 0.72 / 0.35 or a number; first filled of the label columns."""

    def one(col: Column) -> Column:
        text = F.lower(strip(col))
        number = text.try_cast("double")
        return (
            F.when(text == "high", F.lit(0.95))
            .when(text == "medium", F.lit(0.72))
            .when(text == "low", F.lit(0.35))
            .when(number > 1, number / 100)
            .otherwise(number)
        )

    return F.coalesce(*[one(c[x]) for x in ("selected_product_url_confidence", "dimension_confidence", "image_confidence")])


def enrichment_summary(df: DataFrame, cost: float = 0.006, cap: float = 0.25) -> DataFrame:
    """Counters, mean confidence, cost and yield of an enrichment run."""
    rows = df.filter(F.col("include") & ~rules.is_charge(df))

    def spent(kind: str) -> Column:
        n = F.regexp_extract("budget_spent", rf"{kind}=(\d+)/\d+", 1).try_cast("long")
        return F.coalesce(F.sum(n), F.lit(0))

    fields = F.size(F.filter(F.split("fields_filled", r"\s*,\s*"), lambda x: x != ""))
    some = urls.any_of(
        [has(F.col(x)) for x in ("fields_filled", "selected_product_url", "product_url", "dimensions", "image_url")]
    )
    full = dims.has_complete_3d(F.col("dimensions"))
    t = rows.agg(
        F.count("*").alias("rows_considered"),
        F.count_if(some).alias("rows_enriched"),
        F.count_if(~full).alias("rows_missing_dimensions"),
        F.count_if(~has(F.col("image_url"))).alias("rows_missing_images"),
        F.count_if(F.col("dimensions_status") == "partial").alias("rows_partial_dimensions"),
        F.count_if(F.col("enrichment_status").isin("skipped_budget_cap", "skipped_per_item_budget_cap")).alias("rows_budget_skipped"),
        F.coalesce(F.round(F.avg(confidence_value(rows)), 3), F.lit(0.0)).alias("average_confidence"),
        spent("searches").alias("searches_used"),
        spent("fetches").alias("fetches_used"),
        F.count_if(F.col("cache_hit").isin("full", "partial", "duplicate_model")).alias("cache_hits"),
        F.count_if("duplicate_model_skipped").alias("duplicates_skipped"),
        F.coalesce(F.sum("searches_avoided"), F.lit(0)).alias("searches_avoided"),
        F.coalesce(F.sum(fields), F.lit(0)).alias("useful_fields"),
        F.count_if(full).alias("dimensions_present"),
        F.count_if(has(F.col("image_url"))).alias("images_present"),
    )
    money = F.col("searches_used") * F.lit(cost)

    def per(top: Column, bottom: Column, places: int) -> Column:
        return F.when(bottom > 0, F.round(top / bottom, places)).otherwise(F.lit(0.0))

    return t.withColumns(
        {
            "estimated_cost": F.round(money, 4),
            "budget_remaining": F.round(F.greatest(F.lit(0.0), F.lit(cap) - money), 4),
            "cost_per_field": per(money, F.col("useful_fields"), 4),
            "cost_per_dimension": per(money, F.col("dimensions_present"), 4),
            "dimensions_per_dollar": per(F.col("dimensions_present"), money, 2),
            "images_per_dollar": per(F.col("images_present"), money, 2),
        }
    )


def _grouped(df: DataFrame) -> DataFrame:
    """Rows with the key of their product; a row without model is a product of its own."""
    brand = F.coalesce(F.nullif(rules.norm_token(df["brand"]), F.lit("")), F.lit("missingbrand"))
    model = F.coalesce(
        F.nullif(rules.norm_token(df["model_sku"]), F.lit("")), F.concat(F.lit("missingmodel"), df["row_id"].cast("string"))
    )
    return df.withColumn("product_key", F.concat(brand, F.lit("_"), model))


def product_groups(df: DataFrame) -> DataFrame:
    """Unique products with row counts; a row without model is a product of its own."""
    return _grouped(df).groupBy("product_key").agg(
        F.count("*").alias("rows"), F.min("row_id").alias("first_row"), (F.count("*") - 1).alias("duplicates")
    )


def group_members(df: DataFrame) -> DataFrame:
    """(product_key, member, row_id): the rows of every product, numbered in order; a row per member, so no product is held whole."""
    return number_within(_grouped(df).select("product_key", "row_id"), ["product_key"], "row_id", "member")


def debug_report(df: DataFrame) -> DataFrame:
    """Long report (product, label, value) of each product's representative."""
    reps = status_columns(elect(df))
    lines = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.when(strip(value) == "", F.lit("none")).otherwise(strip(value)).alias("value"))
            for label, value in (
                ("Brand", F.col("brand")),
                ("Model", F.col("model_sku")),
                ("Dimensions", F.col("dimensions")),
                ("Image URL", F.col("image_url")),
                ("Product URL", F.col("product_url")),
                ("Status", F.col("enrichment_status")),
                ("Retry", F.col("retry")),
            )
        ]
    )
    return reps.select("product_key", F.explode(lines).alias("l")).select("product_key", "l.label", "l.value")


def distinct_diagnostics(df: DataFrame) -> DataFrame:
    """First row per (product, status, source, reason)."""
    keyed = with_product_key(df)
    return first_per(
        keyed, ["product_key", "enrichment_status", "dimension_source_url", "dimensions_status"], [F.asc("row_id")]
    )


def top_images(df: DataFrame, k: int = 3) -> DataFrame:
    return top_per(df, ["page_id"], [F.desc("score"), F.asc("position")], k, "rank")


