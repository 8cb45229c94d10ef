"""Sources: link lists, documents, photos, manual entry, posted JSON; the conformed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.functions.text import file_stem, is_blank, strip, tidy
from skuloom.operators.keyed import number_within

# Columns every source is brought to, with type and default.
INTAKE_SCHEMA = (
    ("include", "boolean", True),
    ("project", "string", ""),
    ("room", "string", ""),
    ("product_name", "string", ""),
    ("brand", "string", ""),
    ("dimensions", "string", ""),
    ("finish_color", "string", ""),
    ("color", "string", ""),
    ("material", "string", ""),
    ("model_sku", "string", ""),
    ("category", "string", ""),
    ("quantity", "int", 1),
    ("price", "string", ""),
    ("supplier", "string", ""),
    ("product_url", "string", ""),
    ("notes", "string", ""),
    ("source_type", "string", ""),
    ("status", "string", ""),
    ("import_type", "string", ""),
    ("photo_only", "boolean", False),
    ("ai_category_confidence", "int", 0),
    ("category_source", "string", "Unknown"),
    ("image_url", "string", ""),
    ("local_image_path", "string", ""),
    ("image_filename", "string", ""),
    ("image_upload_status", "string", ""),
)


def conform(df: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Missing columns and nulls get their default; order and types are fixed."""
    cols = []
    for name, kind, default in INTAKE_SCHEMA:
        if name not in df.columns:
            value = F.lit(default).cast(kind)
        elif kind == "string":
            value = tidy(F.coalesce(F.col(name).cast(kind), F.lit(default)))
        else:
            value = F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))
        cols.append(value.alias(name))
    return df.select(*[k for k in keep if k in df.columns], *cols)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Concatenate sources by column name (manual, documents, links, photos)."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def url_rows(lines: DataFrame, text: str = "value", **context: str) -> DataFrame:
    """Text lines to link rows; blank lines are dropped."""
    link = strip(F.col(text))
    rows = lines.filter(link != "").withColumn("product_url", link)
    for name, value in context.items():
        rows = rows.withColumn(name, F.lit(value))
    return rows.withColumn("source_type", F.lit("URL")).withColumn("status", F.lit("Needs Review"))


def read_url_list(spark, path: str, **context: str) -> DataFrame:
    return conform(url_rows(spark.read.text(path), **context))


def document_rows(files: DataFrame, name: str = "name", notes: str = "notes") -> DataFrame:
    """One waiting row per document."""
    file_name = F.col(name)
    title = F.translate(F.regexp_replace(file_name, r"\.pdf$", ""), "_-", "  ")
    origin = F.concat(F.lit("Source: "), file_name)
    note = F.when(F.col(notes) != "", F.concat(origin, F.lit(" | "), F.col(notes))).otherwise(origin)
    return (
        files.withColumn("product_name", title)
        .withColumn("notes", note)
        .withColumn("source_type", F.lit("PDF"))
        .withColumn("status", F.lit("Pending Extraction"))
    )


def read_documents(spark, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Document placeholders from a folder; only the file names are read, not the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("notes"))
    return conform(document_rows(named))


def photo_rows(photos: DataFrame, upload_status: str = "image_upload_status") -> DataFrame:
    """One photo-only row per image; product fields blank, quantity unknown."""
    status = F.col(upload_status)
    return photos.select(
        "row_id",
        F.lit("Photo").alias("source_type"),
        F.lit("Photo Upload").alias("import_type"),
        F.lit(True).alias("photo_only"),
        F.lit("Needs Review").alias("status"),
        F.lit(None).cast("int").alias("quantity"),
        F.col("image_filename"),
        F.col("local_image_path"),
        F.when(status == "", F.lit("Ready")).otherwise(status).alias("image_upload_status"),
    )


PHOTO_NOTE = "Photo-only inventory item."


def sequence_names(photos: DataFrame, batch: str, mode: str, default: str = "", append: bool = True) -> DataFrame:
    """Product names of a photo batch: ``default 001``, ``Photo Item 001`` or the file stem."""
    numbered = number_within(photos, [batch], "ordinal", "position")
    number = F.lpad(F.col("position").cast("string"), 3, "0")
    number = F.when(F.col("position") > 999, F.col("position").cast("string")).otherwise(number)
    stem = F.coalesce(F.nullif(strip(file_stem(F.col("image_filename"))), F.lit("")), F.lit("photo_item"))
    if default.strip():
        base = default.strip()
        name = F.concat(F.lit(base + " "), number) if append else F.lit(base)
    elif mode == "generated":
        name = F.concat(F.lit("Photo Item "), number)
    else:
        name = stem
    return numbered.withColumn("product_name", name)


def stored_photos(photos: DataFrame, uploads: DataFrame, statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Photos joined to uploaded URLs and statuses by position; gaps padded with blank."""
    url = strip(F.coalesce(F.col("uploaded_url"), F.lit("")))
    status = F.coalesce(F.col("upload_status"), F.lit(""))
    shown = (
        F.when(status != "", status)
        .when(url != "", F.lit("Uploaded"))
        .otherwise(F.lit("Missing Image"))
    )
    return (
        photos.join(uploads, keys, "left")
        .join(statuses, keys, "left")
        .withColumn("image_url", url)
        .withColumn("image_upload_status", shown)
        .withColumn("source_type", F.lit("Photo"))
        .withColumn("import_type", F.lit("Photo-only Bulk Import"))
        .withColumn("photo_only", F.lit(True))
        .withColumn("quantity", F.lit(1))
        .withColumn("notes", F.lit(PHOTO_NOTE))
        .drop("uploaded_url", "upload_status")
    )


def manual_rows(df: DataFrame) -> DataFrame:
    """Hand-entered rows: quantity at least 1, status by model and gaps."""
    gaps = (
        is_blank(F.col("product_name")) | is_blank(F.col("brand")) | is_blank(F.col("dimensions"))
        | is_blank(F.col("supplier")) | is_blank(F.col("room")) | is_blank(F.col("category"))
    )
    trimmed = [
        strip(F.col(c)).alias(c) if c in MANUAL_TEXT else F.col(c) for c in df.columns if c != "quantity"
    ]
    qty = F.greatest(F.coalesce(F.col("quantity"), F.lit(1)), F.lit(1)).cast("int")
    status = F.when((strip(F.col("model_sku")) != "") & gaps, F.lit("Needs Enrichment")).otherwise(
        F.lit("Needs Review")
    )
    drop = {"source_type", "status"}
    kept = [c for c, n in zip(trimmed, [x for x in df.columns if x != "quantity"]) if n not in drop]
    return df.select(*kept, qty.alias("quantity"), F.lit("Manual").alias("source_type"), status.alias("status"))


MANUAL_TEXT = (
    "product_name", "brand", "dimensions", "finish_color", "model_sku", "category", "price", "product_url",
)


def json_rows(posted: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows posted as a JSON list."""
    parsed = F.from_json(F.col(payload), f"array<struct<{schema}>>")
    return posted.select("batch_id", F.posexplode(parsed).alias("position", "row")).select(
        "batch_id", "position", "row.*"
    )


def read_json_rows(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
