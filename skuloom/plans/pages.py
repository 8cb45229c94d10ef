"""Page queries: elements, dimensions, images, fields, links, verification, the enrichment cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.operators import candidates as cand
from skuloom.operators import page_parse, pages, pipeline
from skuloom.registry import query


def _products(part):
    return part.select(
        F.col("p_partkey").alias("page_id"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("Maker")).otherwise(F.col("p_brand")).alias("brand"),
        F.concat(F.col("p_type"), F.lit("-"), F.col("p_partkey").cast("string")).alias("model_sku"),
        F.col("p_name").alias("product_name"),
    )


@query("part")
def dims_candidates(part):
    n = F.col("p_size").cast("string")
    text = F.get(
        F.array(
            F.concat(F.lit("Overall dimensions: "), n, F.lit('"W x 20"H x 5"D.')),
            F.concat(F.lit("Size: "), n, F.lit(" x 14, steel")),
            F.concat(F.lit("Cutout dimensions: "), n, F.lit(" x 20 x 10 in")),
            F.lit("The product measures 10 cm x 20 cm x 30 cm overall"),
            F.lit("no size given"),
        ),
        (F.col("p_partkey") % 5).cast("int"),
    )
    return part.select("p_partkey", F.array_join(pages.dimension_candidates(text), " | ").alias("candidates"))


@query("part")
def dims_best(part):
    """Best of three candidate texts per product: most axes, then the earliest."""
    n = F.col("p_size").cast("string")
    texts = F.array(
        F.concat(n, F.lit('"W')),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(n, F.lit('"W x 3"H x 4"D'))).otherwise(F.concat(n, F.lit('"W x 3"H'))),
        F.lit('Width 5 cm, Height: 6, Depth is 7'),
    )
    rows = part.select(
        "p_partkey", F.posexplode(F.when(F.col("p_partkey") % 3 == 0, F.slice(texts, 1, 2)).otherwise(texts)).alias("pos", "candidate")
    )
    return pages.best_candidate(rows, ["p_partkey"], ["pos"])


@query("product_pages")
def page_dimensions(df):
    return pages.page_dimensions(page_parse.page_elements(df))


@query("part")
def text_page_dimensions(part):
    n = F.col("p_size").cast("string")
    rows = part.select(
        (F.col("p_partkey") % 50).alias("doc_id"),
        F.col("p_partkey").alias("page"),
        F.when(F.col("p_partkey") % 100 >= 50, F.concat(F.lit("Product dimensions: "), n, F.lit('"W x 1"H x 2"D')))
        .when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Size: "), n, F.lit('"W')))
        .otherwise(F.lit("nothing"))
        .alias("text"),
    )
    return pages.text_page_dimensions(rows)


@query("product_pages")
def page_images(df):
    return pages.page_images(page_parse.page_elements(df), df).select("page_id", "image_url", "source_type", "alt", "context", "width", "height")


def _scored(df, part):
    found = pages.page_images(page_parse.page_elements(df), df)
    return pages.score_images(found.join(pages.of_page(_products(part)), "page_id"))


@query("product_pages", "part")
def score_images(df, part):
    return _scored(df, part).select("page_id", "image_url", "score", "confidence", "rejection")


@query("product_pages", "part")
def select_best_image(df, part):
    valid = F.col("page_id") % 5 > 0
    return pages.best_image(_scored(df, part), valid | (F.col("source_type") == "og:image")).select(
        "page_id", "image_url", "score", "final_score", "final_confidence"
    )


@query("product_pages", "part")
def top_image_diagnostics(df, part):
    return pages.top_images(_scored(df, part), 2).select("page_id", "place", "image_url", "score")


@query("product_pages")
def page_fields(df):
    return pages.page_fields(page_parse.page_elements(df))


@query("pages")
def page_fields_crawl(df):
    """The same job over the raw web pages of the sample."""
    return pages.page_fields(page_parse.page_elements(df)).select("page_id", "name", "description", "title")


@query("pages")
def page_element_counts(df):
    return page_parse.page_elements(df).groupBy("kind").agg(F.count("*").alias("elements"))


@query("product_pages")
def spec_links(df):
    n = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<a href="/docs/general-manual.pdf#p2">Manual</a><a href="/docs/'), n, F.lit('.pdf">Spec sheet '),
        F.regexp_extract("url", "/p/(.*)$", 1), F.lit('</a><a href="/about.html">About</a><link href="//cdn.example.com/price.pdf">'),
    )
    rows = df.withColumn("html", F.concat("html", extra)).withColumn("model_sku", F.regexp_extract("url", "/p/(.*)$", 1))
    return pages.spec_links(page_parse.page_elements(rows), rows)


@query("product_pages", "part", "brand_sites")
def score_pages(df, part, sites):
    fields = pages.page_fields(page_parse.page_elements(df)).select("page_id", "title", "description")
    rows = cand.with_brand_sites(df.join(pages.of_page(_products(part)), "page_id").join(pages.of_page(fields), "page_id"), sites).withColumn("has_image", F.lit(True))
    return pages.score_pages(rows).select(
        "page_id", "score", "page_confidence", "official_site", "matched_brand", "locations", "rejection"
    )


@query("search_results")
def select_verified_page(results):
    n = F.col("product_id") * 3 + F.col("result_ordinal") * 7
    label = F.when(n % 4 == 0, "high").when(n % 4 == 1, "medium").when(n % 4 == 2, "low").otherwise("none")
    rows = results.select(
        "product_id",
        (F.col("result_ordinal") + 1).alias("position"),
        label.alias("page_confidence"),
        (n % 5 < 2).alias("official_site"),
        (F.lit(60) + n % 40).alias("score"),
    )
    return pages.select_page(rows, 3)


def _page_table(df, part):
    info = part.select(
        F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("brand"),
        F.concat("p_type", F.col("p_partkey").cast("string")).alias("model_sku"), F.col("p_name").alias("product_name"),
    )
    return df.join(pages.of_page(info), "page_id")


@query("intake_wide", "product_cache", "source_memory", "product_pages", "part")
def enrich_pipeline(df, cache, memory, page_df, part):
    return pipeline.enrich_rows(df, cache, memory, _page_table(page_df, part)).select(
        "row_id", "dimensions", "image_url", "product_url", "is_duplicate", "dimensions_status", "image_status", "enrichment_status", "retry"
    )


@query("intake_wide", "product_pages", "part")
def recover_images(df, page_df, part):
    return pipeline.recover_images(df, _page_table(page_df, part))
