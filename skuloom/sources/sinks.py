"""Sinks: internal CSV, import CSV, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.functions.text import drop_row_prefix, strip

# Display names of the import file, in order.
IMPORT_HEADER = (
    "Section", "Product Name", "Brand", "SKU", "Model", "Dimensions", "Width (in)", "Height (in)",
    "Depth (in)", "Length (in)", "Quantity", "Price", "Supplier", "Product URL", "Image URL",
    "Finish", "Color", "Material", "Lead Time", "Notes", "Location",
)

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}


def internal_table(df: DataFrame) -> DataFrame:
    """Internal export: no local paths, notes without row label."""
    out = df.drop("local_image_path")
    return out.withColumn("notes", drop_row_prefix(F.col("notes"))) if "notes" in out.columns else out


def write_internal_csv(df: DataFrame, path: str) -> None:
    internal_table(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def import_table(rows: DataFrame) -> DataFrame:
    """Import rows under their display names, without the row id."""
    from skuloom.operators.export import IMPORT_COLUMNS

    return rows.select(*[F.col(c).alias(h) for c, h in zip(IMPORT_COLUMNS, IMPORT_HEADER)])


def write_import_csv(rows: DataFrame, path: str) -> None:
    """Rows in input order across the part files (a range sort, not one task)."""
    import_table(rows.sort("row_id")).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def log_rows(df: DataFrame) -> DataFrame:
    """Run-log entries with a folder-safe project name."""
    project = F.regexp_replace(strip(F.col("project")), " ", "_")
    return df.select(
        "timestamp",
        F.coalesce(F.nullif(project, F.lit("")), F.lit("intake")).alias("project"),
        "product_name",
        "product_url",
        "status",
        "message",
    )


def append_log(df: DataFrame, path: str) -> None:
    log_rows(df).write.mode("append").partitionBy("project").parquet(path)
