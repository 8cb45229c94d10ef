"""Queries over single rows: sources, predicates, scores, text and URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import dims, rules, urls
from skuloom.functions import text as tx
from skuloom.operators.keyed import first_per
from skuloom.registry import query
from skuloom.sources import intake_sources as src
from skuloom.sources import sinks


@query("intake_wide")
def src_url_list(df):
    lines = df.select("row_id", F.concat(F.lit("  "), F.col("product_url"), F.lit("\t ")).alias("value"))
    return src.conform(src.url_rows(lines, project="Demo", room="Bar")).select(
        "row_id", "product_url", "project", "room", "source_type", "status", "quantity", "include"
    )


@query("documents")
def src_doc_placeholder(df):
    files = df.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.col("source"), F.lit("_quote-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.when(F.col("lang") == "en", F.lit("English")).otherwise(F.lit("")).alias("notes"),
    )
    return src.conform(src.document_rows(files)).select("row_id", "product_name", "notes", "source_type", "status")


def _photos(pages):
    return pages.select(
        F.col("page_id").alias("row_id"),
        F.concat(F.lit("IMG_"), F.col("page_id").cast("string"), F.lit("-front.jpg")).alias("image_filename"),
        F.concat(F.lit("/photos/"), F.col("page_id").cast("string")).alias("local_image_path"),
        F.when(F.col("page_id") % 3 == 0, F.lit("Failed")).otherwise(F.lit("")).alias("image_upload_status"),
    )


@query("pages")
def src_photo_manifest(df):
    return src.photo_rows(_photos(df))


@query("intake_wide")
def src_manual(df):
    out = src.manual_rows(df.withColumn("quantity", F.when(F.col("row_id") % 3 > 0, F.col("quantity") - 25)))
    return out.select("row_id", "product_name", "model_sku", "quantity", "source_type", "status")


@query("intake_wide")
def src_json_rows(df):
    posted = df.select(
        F.col("row_id").alias("batch_id"),
        F.to_json(F.array(F.struct("product_name", "quantity", "include"))).alias("payload"),
    )
    return src.json_rows(posted, "payload", "product_name string, quantity int, include boolean")


@query("intake_wide")
def conform_schema(df):
    sparse = df.select(
        "row_id",
        F.when(F.col("row_id") % 2 == 0, F.col("brand")).alias("brand"),
        F.when(F.col("row_id") % 3 > 0, F.col("quantity")).alias("quantity"),
        F.when(F.col("row_id") % 5 > 0, F.col("include")).alias("include"),
    )
    return src.conform(sparse).select(
        "row_id", "include", "brand", "quantity", "category_source", "photo_only", "ai_category_confidence", "notes"
    )


@query("intake_wide", "documents", "pages")
def union_sources(rows, documents, pages):
    manual = src.conform(rows.filter(F.col("source_type") == "Manual"))
    docs = src.conform(
        documents.select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.lit("").alias("notes")
        ).transform(src.document_rows)
    )
    photos = src.conform(src.photo_rows(_photos(pages)))
    both = src.union_sources(manual.drop("row_id"), docs, photos.drop("row_id"))
    return both.groupBy("source_type", "status", "photo_only").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("total_quantity")
    )


@query("pages")
def sequence_names(df):
    photos = _photos(df).withColumn("ordinal", F.col("row_id")).withColumn("batch", F.col("row_id") % 7)
    named = src.sequence_names(photos, "batch", "generated", "Lamp")
    generated = src.sequence_names(photos, "batch", "generated")
    stems = src.sequence_names(photos, "batch", "file name")
    return (
        named.select("row_id", "position", F.col("product_name").alias("default_name"))
        .join(generated.select("row_id", F.col("product_name").alias("generated_name")), "row_id")
        .join(stems.select("row_id", F.col("product_name").alias("stem_name")), "row_id")
    )


@query("pages")
def stored_photo_join(df):
    photos = _photos(df).drop("image_upload_status")
    uploads = df.filter(F.col("page_id") % 4 > 0).select(
        F.col("page_id").alias("row_id"), F.concat(F.lit(" https://cdn.example.com/"), F.col("page_id").cast("string")).alias("uploaded_url")
    )
    statuses = df.filter(F.col("page_id") % 5 == 0).select(F.col("page_id").alias("row_id"), F.lit("Retry").alias("upload_status"))
    return src.stored_photos(photos, uploads, statuses, ["row_id"]).select(
        "row_id", "image_filename", "image_url", "image_upload_status", "import_type", "quantity"
    )


@query("intake_wide")
def sink_internal_csv(df):
    return sinks.internal_table(df.withColumn("local_image_path", F.lit("/tmp/x"))).select("row_id", "product_name", "notes")


@query("events")
def run_log_sink(df):
    ts = F.col("ts").cast("timestamp")
    entries = df.select(
        ts.alias("timestamp"),
        F.when(F.col("user_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" House "), F.col("user_id").cast("string"))).alias("project"),
        F.lit("").alias("product_name"),
        F.lit("").alias("product_url"),
        F.col("event_type").alias("status"),
        F.lit("").alias("message"),
    )
    return sinks.log_rows(entries).groupBy("project", "status").agg(
        F.count("*").alias("entries"), F.max("timestamp").cast("timestamp_ntz").alias("last_entry")
    )


# ---------------------------------------------------------------- predicates


@query("intake_wide")
def is_ignored(df):
    return df.select("row_id", rules.is_ignored(df).alias("ignored"))


@query("intake_wide")
def is_photo_only(df):
    return df.select(
        "row_id",
        rules.is_photo_only(df).alias("photo_review"),
        rules.is_photo_only(df, rules.EXPORT_PHOTO_TYPES).alias("photo_export"),
    )


@query("intake_wide")
def is_included(df):
    text = F.when(df.row_id % 4 == 0, F.lit(" No ")).when(df.row_id % 4 == 1, F.lit("0")).otherwise(
        df.include.cast("string")
    )
    return df.select(
        "row_id",
        rules.is_included_loose(text).alias("loose"),
        rules.is_included_strict(F.when(df.row_id % 5 > 0, df.include)).alias("strict"),
    )


@query("intake")
def has_complete_3d(df):
    return df.select("row_id", dims.has_complete_3d(df.dimensions).alias("complete"))


@query("intake")
def dims_extract(df):
    parsed = df.select("row_id", dims.parse_dims(df.dimensions).alias("p"))
    return parsed.select("row_id", *[F.col(f"p.{a}").alias(a) for a in dims.AXES])


@query("intake")
def dimension_sanity(df):
    return df.select("row_id", dims.sanity_reason(df.dimensions, df.category).alias("reason"))


@query("intake")
def url_validate(df):
    link = (
        F.when(df.row_id % 6 == 0, F.lit("https://[bad"))
        .when(df.row_id % 6 == 1, F.lit("ftp://files.example.com/x"))
        .when(df.row_id % 6 == 2, F.concat(F.lit("http://localhost:80/"), df.row_id.cast("string")))
        .when(df.row_id % 6 == 3, F.concat(F.lit("https://host"), df.row_id.cast("string")))
        .when(df.row_id % 6 == 4, F.lit("https://10.0.0.1/x y"))
        .otherwise(df.product_url)
    )
    return df.select("row_id", link.alias("url"), urls.url_problem(link).alias("problem"))


@query("intake")
def image_url_ok(df):
    link = F.when(df.row_id % 5 == 0, F.concat(F.lit("https://cdn.example.com/render/"), df.row_id.cast("string"), F.lit("?w=9"))).otherwise(df.image_url)
    return df.select("row_id", urls.is_image_url(link).alias("image_ok"), urls.is_https(link).alias("https_only"))


@query("intake_wide")
def is_exportable(df):
    return df.select("row_id", rules.is_exportable(df).alias("exportable"))


@query("intake_wide")
def identity_issues(df):
    model = F.when(df.row_id % 47 == 0, F.lit("416-555-0100")).otherwise(df.model_sku)
    rows = df.withColumn("model_sku", model)
    return rows.select("row_id", rules.identity_problem(rows).alias("identity"), rules.contamination(rows).alias("contamination"))


@query("intake_wide")
def note_like_text(df):
    return df.select("row_id", tx.looks_like_notes(df.notes).alias("note_like"))


@query("intake")
def valid_phone(df):
    digits = F.lpad((df.row_id % 100000).cast("string"), 9, "2")
    phone = (
        F.when(df.row_id % 5 == 0, F.lit(""))
        .when(df.row_id % 5 == 1, F.lit("911"))
        .when(df.row_id % 5 == 2, F.concat(F.lit(" +1"), digits))
        .when(df.row_id % 5 == 3, F.concat(F.lit("0"), digits))
        .otherwise(F.concat(F.lit("+"), digits, digits))
    )
    return df.select("row_id", tx.phone_problem(phone).alias("problem"))


# ---------------------------------------------------------------- functions


@query("part")
def fraction_to_number(df):
    text = (
        F.when(df.p_partkey % 4 == 0, F.concat(df.p_size.cast("string"), F.lit(" 7/8")))
        .when(df.p_partkey % 4 == 1, F.concat(df.p_size.cast("string"), F.lit("/3")))
        .when(df.p_partkey % 4 == 2, F.concat(df.p_size.cast("string"), F.lit(".25")))
        .otherwise(F.lit("n/a"))
    )
    return df.select(
        "p_partkey",
        F.round(dims.to_number(text), 9).alias("number"),
        dims.decimal_text(text, 6).alias("text6"),
        dims.decimal_text(text, 4).alias("text4"),
    )


@query("part")
def to_inches(df):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("cm", "MM", "inches", "", "″")]), (df.p_partkey % 5 + 1).cast("int"))
    value = df.p_size.cast("string")
    return df.select("p_partkey", dims.unit_name(unit).alias("unit"), dims.inches_text(value, unit).alias("inches"))


@query("intake_wide")
def export_dims_text(df):
    return df.select("row_id", dims.export_dims(df.dimensions, df.category).alias("export_dims"))


@query("intake")
def norm_token(df):
    return df.select(
        "row_id", tx.norm_token(df.model_sku).alias("token"), tx.norm_text(df.room).alias("spaced"),
        tx.norm_text(df.product_name).alias("name_key"),
    )


@query("intake")
def product_key(df):
    return df.select("row_id", rules.product_key(df.brand, df.model_sku).alias("product_key"))


@query("intake")
def normalize_category(df):
    return df.select("row_id", rules.normalize_category(df.category).alias("category"))


@query("intake")
def normalize_section(df):
    label = F.when(df.row_id % 3 == 0, F.concat(df.category, F.lit(" set"))).otherwise(df.category)
    return df.select("row_id", rules.normalize_section(label).alias("section"))


@query("intake")
def normalize_location(df):
    got = df.select("row_id", rules.normalize_location(df.room, F.when(df.row_id % 2 == 0, F.lit("Foyer")).otherwise(F.lit(""))).alias("g"))
    return got.select("row_id", "g.location", "g.score", "g.reason")


@query("intake")
def domain_clean(df):
    raw = F.when(df.row_id % 3 == 0, F.lit("WWW.Maker.Example.com/about")).when(df.row_id % 3 == 1, df.product_url).otherwise(F.lit("not a host"))
    return df.select(
        "row_id",
        urls.clean_domain(raw).alias("strict_domain"),
        urls.memory_domain(raw).alias("memory_domain"),
        urls.site(df.product_url).alias("site"),
    )


@query("intake")
def url_join(df):
    base = F.concat(F.lit("https://www.maker.example.com/p/"), df.row_id.cast("string"))
    raw = F.element_at(
        F.array(*[F.lit(x) for x in ("//cdn.example.com/a.jpg", "/img/b.png", "c.webp", "https://x.example.org/d", "")]),
        (df.row_id % 5 + 1).cast("int"),
    )
    return df.select("row_id", urls.join_url(base, raw).alias("resolved"))


@query("intake_wide")
def confidence_score(df):
    return df.select("row_id", rules.confidence_score(df).alias("score"))


@query("intake_wide")
def missing_fields(df):
    done = rules.complete_dims(df)
    return df.select(
        "row_id",
        rules.list_text(rules.missing_fields(df, done)).alias("missing"),
        rules.list_text(rules.review_missing_fields(df, done)).alias("review_missing"),
    )


@query("intake_wide")
def review_status_action(df):
    from skuloom.operators.scoring import apply_checks

    return apply_checks(df).select(
        "row_id", "include", "status", "confidence_score", "review_required", "missing_fields", "suggested_action"
    )


@query("intake_wide")
def parse_confidence(df):
    return df.select(
        "row_id", rules.parse_confidence(df).cast("int").alias("parse_confidence"),
        rules.list_text(rules.critical_missing(df)).alias("missing"),
    )


@query("intake_wide")
def notes_clean(df):
    return df.select("row_id", tx.clean_notes(df.notes).alias("notes"), tx.material_tag(df.notes).alias("material"))


@query("intake_wide")
def finish_color_split(df):
    return df.select("row_id", tx.strip(df.finish_color).alias("finish"), tx.color_of_finish(df.finish_color).alias("color"))


@query("intake_wide")
def split_notes_description(df):
    from skuloom.operators.scoring import split_description

    rows = df.withColumn(
        "description", F.when(df.row_id % 2 == 0, df.notes).otherwise(F.concat(df.product_name, F.lit(" panel")))
    ).withColumn("product_details", F.when(df.row_id % 3 == 0, F.lower(df.notes)).otherwise(df.finish_color))
    return split_description(rows).select("row_id", "clean_description", "clean_details", "combined_notes")


@query("intake_wide")
def api_fields(df):
    first = tx.first_filled
    return df.select(
        "row_id",
        first(df.product_name).alias("name"),
        first(df.brand).alias("brand_name"),
        first(df.model_sku).alias("sku"),
        first(df.color, df.finish_color).alias("colour"),
        first(df.finish_color).alias("finish"),
        first(df.material).alias("material_name"),
        F.coalesce(F.nullif(tx.strip(df.quantity.cast("string")), F.lit("")), F.lit("0")).alias("quantity_text"),
        first(df.product_url).alias("link"),
        first(df.price).alias("price_text"),
        first(df.supplier).alias("supplier_name"),
    )


@query("documents")
def file_stem_title(df):
    name = F.concat(F.col("source"), F.lit("_item-"), F.col("lang"), F.lit("_o'neil_2nd.jpeg"))
    return df.select("doc_id", tx.file_stem_title(name).alias("title"), tx.file_stem(name).alias("stem"))


@query("intake_wide")
def first_url(df):
    text = F.concat(F.lit("see ("), df.product_url, F.lit("), or "), df.image_url, F.lit("."))
    return df.select("row_id", urls.first_url(text).alias("url"), urls.first_url(df.notes).alias("note_url"))


@query("lineitem")
def first_row_per_line(df):
    """Plain-column form of the duplicate guard in the intake view."""
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")]
    return first_per(df, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
