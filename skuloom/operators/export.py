"""Export: duplicate removal, clean-up, import rows, quality summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.functions import dims, rules, urls
from skuloom.functions.text import (
    add_points,
    clean,
    clean_notes,
    flags_to_list,
    has,
    is_blank,
    keep_first,
    let,
    material_tag,
    norm_token,
    strip,
    title_case,
)
from skuloom.operators.groups import stored
from skuloom.operators.keyed import own_key

IMPORT_COLUMNS = (
    "section", "product_name", "brand", "sku", "model", "dimensions", "width_in", "height_in",
    "depth_in", "length_in", "quantity", "price", "supplier", "product_url", "image_url",
    "finish", "color", "material", "lead_time", "notes", "location",
)

DEBUG_COLUMNS = (
    "confidence_score", "source_type", "category_confidence", "category_source", "local_image_path", "image_filename",
    "dimension_source_url", "dimension_confidence", "dimension_source_type", "dimension_lookup_status", "enrichment_status",
    "enrichment_error", "stage_log", "debug_traceback",
)


def identity(df: DataFrame) -> Column:
    """``brand_sku`` when both are present, else null."""
    tokens = F.struct(norm_token(df["brand"]).alias("b"), norm_token(df["model_sku"]).alias("m"))
    return let(tokens, lambda t: F.when((t["b"] != "") & (t["m"] != ""), F.concat(t["b"], F.lit("_"), t["m"])))


def richness(c, reason: Column) -> Column:
    """How complete a row is for export."""
    name = clean(c["product_name"])
    source = F.lower(clean(c["source_type"]))
    # A word that begins with a small letter is found without building the title-cased name.
    titled = (name != "") & ~F.rlike(name, F.lit(r"(?<!\p{L})[a-z]")) & (name == title_case(name))
    named = F.least(F.length(name), F.lit(20)) + F.when(titled, 3).otherwise(0)
    size = F.when(has(c["dimensions"]) & (reason == ""), F.when(rules.complete_dims(c), 16).otherwise(7)).otherwise(0)
    return (
        named
        + size
        + add_points(
            [
                (has(c["brand"]), 10),
                (has(c["model_sku"]), 10),
                (has(c["room"]), 10),
                (has(c["supplier"]), 8),
                (has(c["category"]), 8),
                (has(c["finish_color"]), 6),
                (has(c["material"]), 6),
                (has(c["notes"]), 3),
                (urls.is_image_url(c["image_url"]), 14),
                (
                    has(c["product_url"]) & (urls.export_url_problem(c["product_url"], c["model_sku"]) == ""),
                    10,
                ),
                (F.contains(source, F.lit("enrich")) | F.contains(source, F.lit("ai")), 6),
            ]
        )
    )


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Add ``removed`` and ``kept_row_id``.

    Rows of one (brand, sku) fall into buckets: one per room when the key has more
    than one room (rows without room join the richest room), else one bucket.  A
    row is removed when its richness is below its bucket's best.  The best row per
    (key, room) is found by partial aggregation, buckets are worked out on that
    small table, and only then joined back.  The scored rows are written once, since
    both sides of that join read them.
    """
    scored = df.withColumn("dim_reason", dims.sanity_reason(df["dimensions"], df["category"]))
    scored = scored.withColumn("richness", richness(scored, F.col("dim_reason")))
    key = F.when(scored["include"], identity(scored))
    scored = scored.withColumn("_key", own_key(key, F.col("row_id"))).withColumn(
        "_room", rules.section_key(F.col("room"))
    )
    scored = stored(scored, "scored")

    per_room = scored.groupBy("_key", "_room").agg(
        F.max(F.struct(F.col("richness"), (-F.col("row_id")).alias("minus_id"))).alias("best")
    )
    by_key = Window.partitionBy("_key")
    named = F.when(F.col("_room") != "", F.struct(-F.col("best.richness"), F.col("_room")))
    rooms = per_room.withColumn(
        "_many", F.sum(F.when(F.col("_room") != "", 1).otherwise(0)).over(by_key) > 1
    ).withColumn("_top_room", F.min(named).over(by_key)["_room"])
    bucket = F.when(
        F.col("_many"), F.when(F.col("_room") == "", F.col("_top_room")).otherwise(F.col("_room"))
    ).otherwise(F.lit(""))
    by_bucket = Window.partitionBy("_key", "_bucket")
    bests = (
        rooms.withColumn("_bucket", bucket)
        .withColumn("_best", F.max("best").over(by_bucket))
        .select(
            "_key",
            "_room",
            F.col("_best.richness").alias("_best_score"),
            (-F.col("_best.minus_id")).alias("_best_id"),
        )
    )
    joined = scored.join(bests, ["_key", "_room"])
    removed = F.col("richness") < F.col("_best_score")
    return (
        joined.withColumn("removed", removed)
        .withColumn("kept_row_id", F.when(removed, F.col("_best_id")))
        .drop("_key", "_room", "_best_score", "_best_id")
    )


def prepare(df: DataFrame) -> DataFrame:
    """Duplicates out, implausible dimensions and weak URLs blanked, reasons kept."""
    rows = mark_duplicates(df).filter(~F.col("removed")).drop("removed", "kept_row_id")
    return (
        rows.withColumn("raw_dimensions", F.col("dimensions"))
        .withColumn("raw_product_url", F.col("product_url"))
        .withColumn("url_reason", urls.export_url_problem(F.col("product_url"), F.col("model_sku")))
        .withColumn("dimensions", F.when(F.col("dim_reason") != "", F.lit("")).otherwise(F.col("dimensions")))
        .withColumn("product_url", F.when(F.col("url_reason") != "", F.lit("")).otherwise(F.col("product_url")))
    )


# ------------------------------------------------------------------ notes

# Fixed value: words of a manual or archive document.
ARCHIVE_WORDS = r"(?i)\b(?:manual|archive|manuals|install|installation|guide|document)\b"
# Source types that carry no information for the reader.
PLAIN_TYPES = ("manufacturer page", "manufacturer pdf", "retailer page", "retailer pdf")


def source_kind(url: Column, maker_domain: Column, hint: Column) -> Column:
    """Label of a source link; shops are never called manufacturers."""

    def says(words):
        return F.rlike(hint, F.lit(f"(?i){words}"))

    def judge(site: Column) -> Column:
        by_site = (
            F.when(urls.in_domains(site, urls.RETAILERS), F.lit("Retailer"))
            .when(urls.domain_below(site, F.lower(clean(maker_domain))), F.lit("Manufacturer"))
            .when(says("manufacturer"), F.lit("Manufacturer"))
            .otherwise(F.lit("Unknown"))
        )
        return F.when(says("retailer"), F.lit("Retailer")).otherwise(by_site)

    pdf = F.when(F.rlike(url, F.lit(ARCHIVE_WORDS)), F.lit("Manual/archive")).otherwise(F.lit("Spec sheet PDF"))
    return (
        F.when(urls.is_pdf(url), pdf)
        .when(says("manual|archive|installation"), F.lit("Manual/archive"))
        .when(says("spec|pdf"), F.lit("Spec sheet PDF"))
        .otherwise(let(urls.strip_www(urls.host(url)), judge))
    )


def _label(url: Column, maker_domain: Column, hint: Column, confidence: Column | None = None) -> Column:
    """`` (kind, confidence)`` or blank."""
    text = F.lit("") if confidence is None else strip(F.translate(clean(confidence), "_", " "))
    low = F.lower(text)
    shown = (
        F.when(low.isin("", *PLAIN_TYPES), F.lit(None))
        .when(low.isin("high", "medium", "low"), F.concat(low, F.lit(" confidence")))
        .otherwise(text)
    )

    def compose(kind: Column) -> Column:
        known = F.nullif(kind, F.lit("Unknown"))
        extra = F.when(F.lower(shown) != F.lower(kind), shown)
        return F.when(known.isNotNull() | extra.isNotNull(), F.concat(F.lit(" ("), F.concat_ws(", ", known, extra), F.lit(")"))).otherwise(
            F.lit("")
        )

    return let(source_kind(url, maker_domain, hint), compose)


def with_source_block(df: DataFrame, name: str = "source_block") -> DataFrame:
    """Add up to six labelled source lines, or the sentence that nothing was verified.

    The links are worked out stage by stage so that no expression is repeated.
    """
    maker = F.col("manufacturer_domain_used")
    rows = df.withColumns(
        {
            "_du": urls.first_url(F.col("dimension_source_url")),
            "_iu": urls.first_url_of(F.col("image_source_url"), F.col("image_url")),
            "_p": urls.first_url(F.col("product_url")),
            "_sel": urls.first_url(F.col("selected_product_url")),
            "_su": urls.first_url(F.col("spec_sheet_url")),
            "_full": rules.complete_dims(df),
            "_shown": urls.is_image_url(F.col("image_url")),
        }
    )
    blank = F.lit("")
    page = F.when(F.col("_p") != "", F.col("_p")).otherwise(F.col("_sel"))
    rows = rows.withColumn("_pu", page)
    weak = (urls.export_url_problem(F.col("_pu"), F.col("model_sku")) != "") | urls.is_pdf(F.col("_pu"))
    spec = F.when(F.col("_su") != "", F.col("_su"))
    for link in ("_du", "_p", "_sel"):
        spec = spec.when(urls.is_pdf(F.col(link)), F.col(link))
    rows = rows.withColumns({"_pu": F.when(weak, blank).otherwise(F.col("_pu")), "_su": spec.otherwise(blank)})

    def pick(*cols):
        return F.coalesce(*[F.nullif(F.col(x), blank) for x in cols], blank)

    domain = F.btrim(F.regexp_replace(F.lower(clean(maker)), r"^https?://", ""), F.lit("/"))
    home = F.when(
        F.contains(domain, F.lit(".")) & ~F.rlike(domain, F.lit(r"\s")), F.concat(F.lit("https://"), domain)
    )
    rows = rows.withColumns(
        {
            "_dl": F.when(F.col("_full"), F.col("_du")).otherwise(pick("_du", "_su", "_pu")),
            "_il": F.when(F.col("_shown"), F.col("_iu")).otherwise(pick("_iu", "_pu")),
            "_home": F.coalesce(home, blank),
        }
    )

    def line(head: Column, link: str, label: Column) -> Column:
        return F.when(F.col(link) != "", F.concat(head, F.col(link), label))

    lines = F.array_distinct(
        F.array_compact(
            F.array(
                line(
                    F.when(F.col("_full"), F.lit("Dimensions source: ")).otherwise(F.lit("Dimensions missing — check source: ")),
                    "_dl",
                    _label(F.col("_dl"), maker, F.col("dimension_source_type"), F.col("dimension_confidence")),
                ),
                line(
                    F.when(F.col("_shown"), F.lit("Image source: ")).otherwise(F.lit("Image missing — check source: ")),
                    "_il",
                    _label(F.col("_il"), maker, F.lit("image"), F.col("image_confidence")),
                ),
                line(
                    F.lit("Product page: "),
                    "_pu",
                    _label(F.col("_pu"), maker, F.lit("product_page"), F.col("selected_product_url_confidence")),
                ),
                line(F.lit("Spec sheet: "), "_su", _label(F.col("_su"), maker, F.lit("spec_sheet"))),
                F.when(
                    F.col("_home") != "",
                    F.concat(source_kind(F.col("_home"), maker, F.lit("manufacturer_url")), F.lit(": "), F.col("_home")),
                ),
            )
        )
    )
    text = let(
        lines,
        lambda ls: F.when(F.size(ls) > 0, F.concat(F.lit("Source links:\n"), F.array_join(ls, "\n"))).otherwise(
            F.lit("No verified source found during enrichment.")
        ),
    )
    return rows.withColumn(name, text).drop("_du", "_iu", "_p", "_sel", "_su", "_full", "_shown", "_pu", "_dl", "_il", "_home")


def export_notes(c, block: Column) -> Column:
    """Cleaned notes, dimension remarks, source block."""
    raw = clean(c["notes"])
    length = dims.axis_text(strip(c["dimensions"]), "length")
    remarks = flags_to_list(
        [
            (
                length != "",
                F.concat(
                    F.lit("Additional dimension noted: Length "),
                    length,
                    F.lit(" kept out of W x H x D field."),
                ),
            ),
            (
                c["dim_reason"] != "",
                F.concat(F.lit("Dimensions rejected before export: "), c["dim_reason"], F.lit(".")),
            ),
        ]
    )
    fresh = F.filter(remarks, lambda r: ~F.contains(raw, r))
    text = clean_notes(F.concat_ws(" ", F.nullif(raw, F.lit("")), F.nullif(F.array_join(fresh, " "), F.lit(""))))
    return let(text, lambda t: F.when(t != "", F.concat(t, F.lit("\n\n"), block)).otherwise(block))


# ------------------------------------------------------------------ rows


def quantity_text(quantity: Column) -> Column:
    text = clean(quantity.cast("string"))
    number = text.try_cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(text)


def import_rows(prepared: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The 21 import columns of every exportable row (plus row_id and ``extra``)."""
    rows = prepared.filter(rules.is_exportable(prepared))
    text = dims.export_dims(rows["dimensions"], rows["category"])
    rows = with_source_block(rows.withColumn("_dims", text), "_block")
    rows = rows.withColumn("_parsed", dims.parse_dims(F.col("_dims")))
    blank = F.lit("")
    values = {
        "section": rules.normalize_section(rows["category"]),
        "product_name": clean(rows["product_name"]),
        "brand": clean(rows["brand"]),
        "sku": F.regexp_replace(clean(rows["model_sku"]), r"\s+", ""),
        "model": blank,
        "dimensions": F.col("_dims"),
        "width_in": F.col("_parsed.width"),
        "height_in": F.col("_parsed.height"),
        "depth_in": F.col("_parsed.depth"),
        "length_in": blank,
        "quantity": quantity_text(rows["quantity"]),
        "price": clean(rows["price"]),
        "supplier": clean(rows["supplier"]),
        "product_url": clean(rows["product_url"]),
        "image_url": F.when(urls.is_image_url(rows["image_url"]), clean(rows["image_url"])).otherwise(blank),
        "finish": clean(rows["finish_color"]),
        "color": clean(rows["color"]),
        "material": F.coalesce(F.nullif(clean(rows["material"]), blank), material_tag(rows["notes"])),
        "lead_time": blank,
        "notes": export_notes(rows, F.col("_block")),
        "location": clean(rows["room"]),
    }
    return rows.select(
        "row_id", *[values[n].alias(n) for n in IMPORT_COLUMNS], *[F.col(x).cast("string").alias(x) for x in extra]
    )


# ------------------------------------------------------------------ quality summary


def readiness_checks(c, parsed_text: Column) -> list[tuple[str, Column]]:
    source = urls.first_url_of(
        c["product_url"],
        c["selected_product_url"],
        c["dimension_source_url"],
        c["spec_sheet_url"],
        c["image_source_url"],
    )
    return [
        ("dimensions", dims.has_complete_3d(parsed_text)),
        ("image", urls.is_image_url(c["image_url"])),
        ("product URL/source", source != ""),
        ("SKU/model", has(c["model_sku"])),
        ("supplier", has(c["supplier"])),
        ("room/location", has(c["room"])),
    ]


def with_flags(prepared: DataFrame) -> DataFrame:
    """Prepared rows plus the flags that the summary, issue and count reports share."""
    c = prepared
    out = c.withColumn(
        "_export_dims",
        dims.export_dims(c["dimensions"], c["category"]),
    )
    out = out.withColumn("_named", c["include"] & has(c["product_name"])).withColumn(
        "_image", urls.is_image_url(c["image_url"])
    )
    out = out.withColumn("_photo", rules.is_photo_only(c, rules.EXPORT_PHOTO_TYPES))
    out = out.withColumn("_exported", F.col("_named") & (~F.col("_photo") | F.col("_image")))
    checks = readiness_checks(out, F.col("_export_dims"))
    return (
        out.withColumn("_no_dims", ~checks[0][1])
        .withColumn("_missing", flags_to_list([(~ok, name) for name, ok in checks]))
        .withColumn("_section", rules.normalize_section(F.col("category")))
        .withColumn(
            "_needs",
            F.col("_exported") & ~F.col("_photo") & (F.col("_no_dims") | ~F.col("_image")),
        )
    )


def qa_summary(df: DataFrame, checks: int = 6) -> DataFrame:
    """One row of counters, readiness score and status."""
    source = mark_duplicates(df)
    removed = F.col("removed")
    flagged = with_flags(
        source.withColumn("url_reason", urls.export_url_problem(F.col("product_url"), F.col("model_sku")))
        .withColumn("_raw_url", F.col("product_url"))
        .withColumn("product_url", F.when(F.col("url_reason") != "", F.lit("")).otherwise(F.col("product_url")))
        .withColumn("dimensions", F.when(F.col("dim_reason") != "", F.lit("")).otherwise(F.col("dimensions")))
    )
    kept = ~removed
    exported = kept & F.col("_exported")
    named = kept & F.col("_named")

    def n(cond):
        return F.count_if(cond)

    photo_lost = named & F.col("_photo") & ~F.col("_image")
    totals = flagged.agg(
        n(F.lit(True)).alias("parsed_rows"),
        n(removed).alias("duplicate_rows_removed"),
        n(kept & F.col("include")).alias("included_rows"),
        n(kept & F.col("include") & ~F.col("_named")).alias("nameless_rows"),
        n(named).alias("image_url_total"),
        n(named & F.col("_image")).alias("image_url_present"),
        n(exported).alias("export_count"),
        n(exported & ~F.col("_needs")).alias("ready_count"),
        n(exported & F.col("_needs")).alias("needs_enrichment"),
        n(exported & F.col("_no_dims")).alias("missing_dimensions"),
        n(exported & is_blank(F.col("product_url"))).alias("missing_product_url"),
        n((exported & ~F.col("_image")) | photo_lost).alias("missing_image_url"),
        n(exported & is_blank(F.col("category"))).alias("missing_section"),
        n(kept & (F.col("dim_reason") != "")).alias("dimensions_rejected"),
        n(kept & (F.col("url_reason") != "")).alias("product_urls_rejected"),
        n(kept & (F.col("url_reason") == "") & urls.is_pdf(F.col("_raw_url"))).alias("pdf_product_urls"),
        n(rules.is_charge(flagged)).alias("charge_rows"),
        n(F.col("include") & (rules.identity_problem(flagged) != "")).alias("missing_identity"),
        n(rules.contamination(flagged) != "").alias("contaminated_rows"),
        F.coalesce(
            F.sum(F.when(exported, F.lit(checks) - F.size("_missing"))), F.lit(0)
        ).alias("readiness_points"),
        F.count_distinct(F.when(exported, F.col("_section"))).alias("unique_sections"),
    )
    total = F.col("export_count") * checks
    score = F.when(
        total > 0, F.bround(F.lit(100.0) * F.col("readiness_points") / total, 0)
    ).otherwise(F.lit(0.0))
    all_ready = F.col("ready_count") == F.col("included_rows")
    status = keep_first(
        [
            (F.col("included_rows") == 0, "Manual review"),
            ((F.col("missing_dimensions") > 0) | (F.col("missing_image_url") > 0), "Needs enrichment"),
            (
                all_ready & ((F.col("missing_product_url") > 0) | (F.col("missing_section") > 0)),
                "Ready with warnings",
            ),
            (all_ready, "Ready"),
            (F.lit(True), "Manual review"),
        ]
    )
    return (
        totals.withColumn("readiness_score", score.cast("int"))
        .withColumn("readiness_status", status)
        .withColumn("too_many_sections", F.col("unique_sections") > 10)
    )


def qa_issues(df: DataFrame) -> DataFrame:
    """Long table of flagged rows: kind, row, reason."""
    marked = mark_duplicates(df)
    prepared = (
        marked.withColumn("url_reason", urls.export_url_problem(F.col("product_url"), F.col("model_sku")))
        .withColumn("_raw_url", F.col("product_url"))
        .withColumn("dimensions", F.when(F.col("dim_reason") != "", F.lit("")).otherwise(F.col("dimensions")))
        .withColumn("product_url", F.when(F.col("url_reason") != "", F.lit("")).otherwise(F.col("product_url")))
    )
    flagged = with_flags(prepared)
    kept = ~F.col("removed")
    exported = kept & F.col("_exported")
    need = F.concat_ws(
        "; ",
        F.when(F.col("_no_dims"), F.lit("missing full W x H x D dimensions")),
        F.when(~F.col("_image"), F.lit("missing or invalid Image URL")),
    )
    raw_section = clean(F.col("category"))
    rules_ = [
        ("duplicate", F.col("removed"), F.lit("duplicate brand/SKU/location; kept richer row")),
        ("dimensions_rejected", kept & (F.col("dim_reason") != ""), F.col("dim_reason")),
        ("product_url_rejected", kept & (F.col("url_reason") != ""), F.col("url_reason")),
        (
            "pdf_product_url",
            kept & (F.col("url_reason") == "") & urls.is_pdf(F.col("_raw_url")),
            F.lit("raw PDF/spec sheet used as Product URL"),
        ),
        ("charge_row", rules.is_charge(flagged), F.lit("blank/price-only quote row")),
        (
            "missing_identity",
            F.col("include") & (rules.identity_problem(flagged) != ""),
            rules.identity_problem(flagged),
        ),
        ("contamination", rules.contamination(flagged) != "", rules.contamination(flagged)),
        ("skipped", kept & F.col("include") & ~F.col("_named"), F.lit("(no name)")),
        (
            "skipped",
            kept & F.col("_named") & F.col("_photo") & ~F.col("_image"),
            F.lit("missing or invalid Image URL"),
        ),
        ("missing_section", exported & (raw_section == ""), F.lit("missing section")),
        (
            "section_equals_name",
            exported
            & (raw_section != "")
            & (rules.section_key(raw_section) == rules.section_key(F.col("product_name"))),
            raw_section,
        ),
        ("section_too_long", exported & (F.length(raw_section) > 30), raw_section),
        ("needs_enrichment", exported & F.col("_needs"), need),
    ]
    found = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(kind).alias("kind"), reason.alias("reason")))
                for kind, cond, reason in rules_
            ]
        )
    )
    return flagged.select("row_id", F.explode(found).alias("issue")).select(
        "issue.kind", "row_id", "issue.reason"
    )


def section_counts(prepared: DataFrame) -> DataFrame:
    rows = prepared.filter(rules.is_exportable(prepared))
    return rows.groupBy(rules.normalize_section(rows["category"]).alias("section")).agg(
        F.count("*").alias("products")
    )


def missing_histogram(prepared: DataFrame) -> DataFrame:
    """Readiness gaps of exported rows, counted per field: one aggregate, then its six columns turned into rows."""
    rows = prepared.filter(rules.is_exportable(prepared)).withColumn(
        "_export_dims",
        dims.export_dims(prepared["dimensions"], prepared["category"]),
    )
    checks = readiness_checks(rows, F.col("_export_dims"))
    counts = rows.agg(*[F.count_if(~ok).alias(f"n{i}") for i, (_, ok) in enumerate(checks)])
    pairs = F.array(
        *[F.struct(F.lit(name).alias("field"), F.col(f"n{i}").alias("rows")) for i, (name, _) in enumerate(checks)]
    )
    return counts.select(F.explode(pairs).alias("p")).select("p.field", "p.rows").filter("rows > 0")


def debug_rows(prepared: DataFrame) -> DataFrame:
    """The import columns and the debug columns; debug columns that the rows do not have are blank."""
    absent = {c: F.lit("") for c in DEBUG_COLUMNS if c not in prepared.columns}
    return import_rows(prepared.withColumns(absent) if absent else prepared, DEBUG_COLUMNS)


def image_manifest(prepared: DataFrame) -> DataFrame:
    """Image work list: deterministic file names, repeated names numbered _2, _3, ..."""
    from skuloom.operators.keyed import number_within

    rows = prepared.filter(rules.is_exportable(prepared))
    brand, sku, name = clean(rows["brand"]), clean(rows["model_sku"]), clean(rows["product_name"])
    second = F.when(sku != "", sku).otherwise(name)
    raw = F.concat_ws("_", F.nullif(brand, F.lit("")), F.nullif(second, F.lit("")))
    slug = F.btrim(
        F.regexp_replace(F.lower(F.when(raw == "", F.lit("product")).otherwise(raw)), "[^a-z0-9]+", "_"),
        F.lit("_"),
    )
    usable = urls.is_image_url(rows["image_url"])
    listed = rows.select(
        "row_id",
        name.alias("product_name"),
        brand.alias("brand"),
        sku.alias("sku"),
        clean(rows["product_url"]).alias("product_url"),
        clean(rows["image_url"]).alias("image_url"),
        F.when(usable, slug).alias("slug"),
    )
    numbered = number_within(listed.filter("slug is not null"), ["slug"], "row_id", "n")
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(F.lit(""))
    with_name = numbered.select(
        "row_id", "product_name", "brand", "sku", "product_url", "image_url",
        F.concat(F.col("slug"), suffix, F.lit(".jpg")).alias("file_name"),
        F.lit("to_download").alias("image_status"),
    )
    without = listed.filter("slug is null").select(
        "row_id", "product_name", "brand", "sku", "product_url", "image_url",
        F.lit("").alias("file_name"), F.lit("missing_image_url").alias("image_status"),
    )
    return with_name.unionByName(without)
