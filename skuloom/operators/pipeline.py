"""The enrichment cascade: qualify, elect, cache, memory, pages, propagate, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.functions import dims, urls
from skuloom.functions.rules import product_key
from skuloom.operators import enrich, memory, page_parse, pages
from skuloom.operators.candidates import weak_page_reason
from skuloom.session import work_dir


def open_products(reps: DataFrame) -> DataFrame:
    """Keys of representatives that still lack a size or an image."""
    lacking = ~dims.has_complete_3d(F.col("dimensions")) | ~urls.is_https(F.col("image_url"))
    return reps.filter(lacking).select("product_key").distinct()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: done once, and lost executors re-read it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def page_findings(page_table: DataFrame, wanted: DataFrame | None = None, sizes: bool = True) -> DataFrame:
    """(product_key, page_url, page_dimensions, page_image) of product pages.

    ``page_table`` has page_id, url, html, brand, model_sku and product_name.  Only pages of wanted products reach
    the Python stage, and that stage runs once: its element rows are written before the two extractions read them.
    """
    keyed = page_table.withColumn("product_key", product_key(F.col("brand"), F.col("model_sku")))
    if wanted is not None:
        keyed = keyed.join(wanted, "product_key", "left_semi")
    elements = written(page_parse.page_elements(keyed), "page-elements")
    info = keyed.select("page_id", "product_key", "brand", "model_sku", "product_name", "url")
    images = pages.page_images(elements, info.select("page_id", "url"))
    scored = pages.score_images(images.join(pages.of_page(info.drop("product_key", "url")), "page_id"))
    image = pages.best_image(scored).select("page_id", F.col("image_url").alias("page_image"))
    joined = info.select("page_id", "product_key", "url").join(image, "page_id", "left")
    if sizes:
        size = pages.page_dimensions(elements).select("page_id", F.col("dimensions").alias("page_dimensions"), "axes")
        joined = joined.join(size, "page_id", "left")
    else:
        joined = joined.withColumns({"page_dimensions": F.lit(None).cast("string"), "axes": F.lit(0)})
    best = F.max(
        F.struct(F.coalesce("axes", F.lit(0)), F.col("page_image").isNotNull(), (-F.col("page_id")).alias("n"), "url", "page_dimensions", "page_image")
    )
    return joined.groupBy("product_key").agg(best.alias("b")).select(
        "product_key", F.col("b.url").alias("page_url"), "b.page_dimensions", "b.page_image"
    )


def fill_from_findings(rows: DataFrame, findings: DataFrame) -> DataFrame:
    j = rows.join(findings, "product_key", "left")
    size = F.col("page_dimensions").isNotNull() & ~dims.has_complete_3d(F.col("dimensions"))
    image = F.col("page_image").isNotNull() & ~urls.is_https(F.col("image_url"))
    link = F.col("page_url").isNotNull() & (weak_page_reason(F.col("product_url")) != "")
    return j.withColumns(
        {
            "dimensions": F.when(size, F.col("page_dimensions")).otherwise(F.col("dimensions")),
            "image_url": F.when(image, F.col("page_image")).otherwise(F.col("image_url")),
            "product_url": F.when(link, F.col("page_url")).otherwise(F.col("product_url")),
        }
    ).drop("page_dimensions", "page_image", "page_url")


def enrich_rows(df: DataFrame, cache: DataFrame, source_memory: DataFrame, page_table: DataFrame) -> DataFrame:
    """Each product is worked on once; its results reach all its rows."""
    base = enrich.qualification(df)
    reps = enrich.elect(base.filter("qualifies"))
    reps = memory.apply_cache(reps, cache)
    reps = written(memory.fill_from_memory(memory.lookup_memory(reps, source_memory)), "representatives")
    findings = page_findings(page_table, open_products(reps))
    reps = written(fill_from_findings(reps, findings), "enriched")
    # The representative itself keeps its own results.
    return enrich.status_columns(enrich.propagate(df, reps, own=("dimensions", "image_url", "product_url")))


def recover_images(df: DataFrame, page_table: DataFrame) -> DataFrame:
    """Image pass for rows without a hosted image only."""
    keyed = enrich.with_product_key(df)
    lacking = keyed.filter(~urls.is_https(F.col("image_url")))
    findings = page_findings(page_table, lacking.select("product_key").distinct(), sizes=False).select("product_key", "page_image")
    return lacking.join(findings, "product_key", "left").select(
        "row_id", F.coalesce("page_image", F.col("image_url")).alias("image_url"), F.col("page_image").isNotNull().alias("recovered")
    )
