"""Views over the sample tables, in SQL that Spark and DuckDB both run.

The sample data has no product-intake table, so each view derives one from the
order lines, parts, suppliers and regions.  They grow with those tables.  The
texts are described in FIXTURES.md; the checks use the same texts in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["intake"] = r"""
SELECT CAST((l.l_orderkey * 10 + l.l_linenumber) * 10000019 + (l.l_partkey * 10007 + l.l_suppkey * 101 + CAST(floor(l.l_quantity) AS BIGINT)) % 10000019 AS BIGINT) AS row_id,
  concat('Project ', CAST(o.o_custkey % 50 AS STRING)) AS project,
  CASE l.l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN 'kitchen' WHEN 2 THEN 'laundry room floor 2 - if we can fit it' WHEN 3 THEN 'bar' ELSE 'pantry - TBD' END AS room,
  CASE WHEN l.l_orderkey % 13 = 0 THEN '' WHEN l.l_orderkey % 29 = 0 THEN 'Delivery and handling' ELSE p.p_name END AS product_name,
  CASE WHEN l.l_orderkey % 11 = 0 THEN '' ELSE p.p_brand END AS brand,
  CASE WHEN l.l_suppkey % 17 = 0 THEN '' WHEN l.l_linenumber % 2 = 0 THEN concat(p.p_type, ' ', CAST(p.p_partkey AS STRING)) ELSE concat(p.p_type, '-', CAST(p.p_partkey AS STRING)) END AS model_sku,
  CASE p.p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(p.p_size AS STRING), '"W x ', CAST(p.p_size + 2 AS STRING), '"H x ', CAST(p.p_size + 4 AS STRING), '"D')
    WHEN 2 THEN concat('Width ', CAST(p.p_size AS STRING), ', Height: ', CAST(p.p_size + 2 AS STRING), ', Depth is ', CAST(p.p_size + 4 AS STRING))
    WHEN 3 THEN concat(CAST(p.p_size AS STRING), ' x ', CAST(p.p_size + 2 AS STRING))
    WHEN 4 THEN concat(CAST(p.p_size AS STRING), ' 1/2"W x ', CAST(p.p_size + 2 AS STRING), '"H x 2752"D')
    ELSE concat('Carton box ', CAST(p.p_size AS STRING), '"W x 10"H x 10"D') END AS dimensions,
  CASE p.p_type WHEN 'PROMO' THEN 'appliance' WHEN 'SMALL' THEN 'Chair' WHEN 'LARGE' THEN 'decorative table lamp' WHEN 'STANDARD' THEN 'Stone/Tile' WHEN 'MEDIUM' THEN '' ELSE 'other' END AS category,
  CAST(floor(l.l_quantity) AS BIGINT) AS quantity, CAST(l.l_extendedprice AS STRING) AS price, s.s_name AS supplier,
  CASE l.l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN concat('https://www.maker.example.com/p/', CAST(p.p_partkey AS STRING)) WHEN 2 THEN 'https://shop.example.org/search?q=x' ELSE concat('https://docs.example.net/', CAST(p.p_partkey AS STRING), '.pdf') END AS product_url,
  CASE l.l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('https://cdn.example.com/i/', CAST(p.p_partkey AS STRING), '.jpg') ELSE 'http://cdn.example.com/page.html' END AS image_url,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'Manual' WHEN 1 THEN 'PDF' WHEN 2 THEN 'URL' ELSE 'PDF_AI' END AS source_type,
  CAST(l.l_shipdate AS TIMESTAMP) AS observed_at
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
"""

VIEWS["source_memory"] = r"""
SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '')) AS normalized_brand, lower(concat(p_type, CAST(p_partkey AS STRING))) AS normalized_model_sku,
  CASE p_partkey % 5 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'spec_sheet' WHEN 2 THEN 'manual' WHEN 3 THEN 'retailer' ELSE 'other' END AS source_type,
  CAST(30 + (p_partkey * 7) % 70 AS INT) AS confidence_score, CAST(p_partkey % 9 AS INT) AS success_count, CAST(p_partkey % 4 AS INT) AS failure_count,
  concat('https://maker.example.com/p/', CAST(p_partkey AS STRING)) AS product_page_url,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(CAST(p_size AS STRING), '"W x 30"H x 20"D') END AS dimensions_text,
  CASE WHEN p_partkey % 4 = 0 THEN 'https://[bad' ELSE concat('https://cdn.example.com/i/', CAST(p_partkey AS STRING), '.jpg') END AS image_url
FROM part WHERE p_partkey % 2 = 0
"""

# The source memory with the remaining columns of a record.
VIEWS["source_memory_wide"] = r"""
SELECT m.*, concat(m.normalized_brand, ':', m.normalized_model_sku) AS memory_id, upper(m.normalized_brand) AS brand, upper(m.normalized_brand) AS display_brand,
  CASE WHEN m.success_count % 2 = 0 THEN concat(CAST(m.confidence_score AS STRING), ' in') ELSE '' END AS width_in, CASE WHEN m.success_count % 3 = 0 THEN '30 in' ELSE '' END AS height_in,
  CASE WHEN m.success_count % 4 = 0 THEN '20 in' ELSE '' END AS depth_in, CASE WHEN m.failure_count = 0 THEN 'https://maker.example.com/' ELSE '' END AS manufacturer_url,
  CASE m.success_count % 3 WHEN 0 THEN '' ELSE 'https://docs.example.net/size.pdf' END AS dimension_source_url, CASE WHEN m.success_count % 2 = 1 THEN 'https://docs.example.net/spec.pdf' ELSE '' END AS spec_sheet_url,
  'https://maker.example.com/gallery/item' AS image_source_url, 'maker.example.com' AS source_domain, CASE m.failure_count WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE '' END AS dimension_confidence,
  CASE WHEN m.confidence_score >= 80 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN m.failure_count = 3 THEN 'low' ELSE '' END AS image_confidence,
  CASE WHEN m.success_count % 2 = 0 THEN 'Checked by phone.' ELSE '' END AS notes
FROM source_memory m
"""

# Brands and categories that ask for a learned domain; the second part has brands without memory.
VIEWS["hint_requests"] = r"""
SELECT DISTINCT p_brand AS brand, 'tables' AS category FROM part
UNION ALL SELECT DISTINCT concat('Brand #', CAST(s_suppkey % 60 AS STRING)), CASE WHEN s_suppkey % 2 = 0 THEN 'Good for brand' ELSE '' END FROM supplier
UNION ALL SELECT DISTINCT concat('Unseen ', p_type), CASE WHEN p_size % 2 = 0 THEN 'good for' ELSE 'chairs' END FROM part
"""

VIEWS["memory_delta"] = r"""
SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '')) AS normalized_brand, lower(concat(p_type, CAST(p_partkey AS STRING))) AS normalized_model_sku,
  CASE p_partkey % 3 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'retailer' ELSE 'other' END AS source_type, CAST(40 + (p_partkey * 11) % 60 AS INT) AS confidence_score,
  1 AS success_count, 0 AS failure_count, concat('https://shop.example.org/', CAST(p_partkey AS STRING)) AS product_page_url, '' AS dimensions_text, '' AS image_url
FROM part WHERE p_partkey % 3 <> 1
"""

VIEWS["search_results"] = r"""
SELECT p.p_partkey AS product_id, r.r_regionkey AS result_ordinal, p.p_brand AS brand, concat(p.p_type, '-', CAST(p.p_partkey AS STRING)) AS model_sku,
  CASE (p.p_partkey + r.r_regionkey) % 6 WHEN 0 THEN concat('https://www.maker.example.com/p/', CAST(p.p_partkey AS STRING)) WHEN 1 THEN 'https://www.amazon.com/dp/x' WHEN 2 THEN 'https://ca.maker.example.com/search?q=x'
    WHEN 3 THEN concat('https://docs.example.net/', lower(p.p_type), CAST(p.p_partkey AS STRING), '.pdf') WHEN 4 THEN 'https://ajmadison.com/collections' ELSE 'https://shop.example.org/item' END AS url,
  CASE WHEN (p.p_partkey + r.r_regionkey) % 2 = 0 THEN concat(p.p_brand, ' ', p.p_type, ' ', CAST(p.p_partkey AS STRING)) ELSE p.p_name END AS title,
  CASE WHEN (p.p_partkey * 2 + r.r_regionkey) % 3 = 0 THEN 'dimensions and specification' ELSE 'overview' END AS description
FROM part p CROSS JOIN region r
"""

VIEWS["quote_lines"] = r"""
SELECT o_orderkey AS doc_id, line_no, text FROM (
  SELECT l_orderkey AS o_orderkey, CAST(l_linenumber AS INT) AS line_no, concat(CAST(l_linenumber AS STRING), '. ', 'Wolf ', p_name, ' Model: ', p_type, CAST(p_partkey AS STRING), ' Qty ', CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), ' $', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), '.00 Kitchen') AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT o_orderkey, 90, 'Subtotal $100.00' FROM orders UNION ALL SELECT o_orderkey, 91, '7. $285.97' FROM orders UNION ALL SELECT o_orderkey, 92, 'Supplier: Example Dealer' FROM orders) q
"""

VIEWS["product_pages"] = r"""
SELECT p_partkey AS page_id, p_partkey AS product_id, concat('https://www.maker.example.com/p/', lower(p_type), CAST(p_partkey AS STRING)) AS url,
  concat('<html><head><title>', p_name, ' | Maker</title><meta property="og:image" content="https://cdn.example.com/i/', CAST(p_partkey AS STRING), '.jpg"></head><body>',
   CASE p_partkey % 4 WHEN 0 THEN concat('<script type="application/ld+json">{"@type":"Product","name":"', p_name, '","width":"', CAST(p_size AS STRING), ' in","height":"30 in","depth":"20 in"}</script>')
     WHEN 1 THEN concat('<table><tr><th>Width</th><td>', CAST(p_size AS STRING), '"</td></tr><tr><th>Height</th><td>30"</td></tr><tr><th>Depth</th><td>20"</td></tr></table>')
     WHEN 2 THEN concat('<p>Product Dimensions: ', CAST(p_size AS STRING), '"W x 30"H x 20"D</p>') ELSE '<p>Shipping dimensions: 40 x 40 x 40 in</p>' END,
   '<img class="logo" src="/logo.png"><img class="gallery" width="600" height="600" src="/img/', lower(p_type), CAST(p_partkey AS STRING), '.jpg" alt="', p_name, '"></body></html>') AS html FROM part
"""

VIEWS["transcripts"] = r"""
SELECT p_partkey AS conv_id, turn, role, text FROM (
  SELECT p_partkey, 0 AS turn, 'assistant' AS role, 'Can you confirm the dimensions?' AS text FROM part
  UNION ALL SELECT p_partkey, 1, 'user', concat('Width ', CAST(p_size AS STRING), ', Height is 84, Depth 24. Finish is brass.') FROM part WHERE p_partkey % 3 <> 2
  UNION ALL SELECT p_partkey, 1, 'user', 'It is thirty-six inches wide, twenty-four inches deep, and eighty-four inches high.' FROM part WHERE p_partkey % 6 = 2
  UNION ALL SELECT p_partkey, 1, 'user', 'The width is forty two, the rest I would have to measure.' FROM part WHERE p_partkey % 6 = 5
  UNION ALL SELECT p_partkey, 2, 'user', 'Sorry, width 99.' FROM part WHERE p_partkey % 3 = 1) q
"""

# The intake rows with the remaining columns of the intake table filled in.
VIEWS["intake_wide"] = """
SELECT i.*,
  i.row_id % 19 <> 0 AS include,
  CASE i.row_id % 7 WHEN 0 THEN '[Materials: brass, glass] Ships  later' WHEN 1 THEN '3. Confirm finish with client'
    WHEN 2 THEN 'Contact sales@dealer.example.com' WHEN 3 THEN 'Call 416-555-0199 for lead time'
    WHEN 4 THEN concat('Keep in storage', chr(10), 'Traceback in httpx', chr(10), 'until spring') ELSE '' END AS notes,
  CASE i.row_id % 5 WHEN 0 THEN 'Matte Black' WHEN 1 THEN '' WHEN 2 THEN 'Walnut' ELSE 'Brass' END AS finish_color,
  CASE WHEN i.row_id % 6 = 0 THEN 'White' ELSE '' END AS color,
  CASE WHEN i.row_id % 4 = 0 THEN 'Oak' ELSE '' END AS material,
  CASE WHEN i.row_id % 31 = 0 THEN 'unresolved_charge' WHEN i.row_id % 37 = 0 THEN 'photo inventory upload'
    WHEN i.row_id % 41 = 0 THEN 'Photo Upload' ELSE '' END AS import_type,
  i.row_id % 43 = 0 AS photo_only,
  CAST(i.row_id % 101 AS INT) AS confidence_score,
  CASE i.row_id % 23 WHEN 0 THEN 'Excluded' WHEN 1 THEN 'Error' ELSE 'Needs Review' END AS status,
  i.row_id % 9 = 0 AS review_required,
  CASE i.row_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('https://docs.example.net/manual/', CAST(i.row_id % 97 AS STRING), '.pdf')
    WHEN 2 THEN 'https://www.wayfair.com/item' ELSE concat('https://www.maker.example.com/spec/', CAST(i.row_id % 97 AS STRING)) END AS dimension_source_url,
  CASE i.row_id % 3 WHEN 0 THEN 'manufacturer_page' WHEN 1 THEN 'retailer' ELSE '' END AS dimension_source_type,
  CASE i.row_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS dimension_confidence,
  CASE i.row_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN '72%' ELSE '' END AS image_confidence,
  CASE WHEN i.row_id % 3 = 0 THEN i.image_url ELSE '' END AS image_source_url,
  CASE WHEN i.row_id % 5 = 0 THEN 'https://www.maker.example.com/p/sel' ELSE '' END AS selected_product_url,
  CASE i.row_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN '0.55' WHEN 2 THEN '81' ELSE '' END AS selected_product_url_confidence,
  CASE WHEN i.row_id % 8 = 0 THEN 'https://docs.example.net/spec-sheet.pdf' ELSE '' END AS spec_sheet_url,
  CASE WHEN i.row_id % 2 = 0 THEN 'maker.example.com' ELSE '' END AS manufacturer_domain_used,
  CASE WHEN i.row_id % 4 = 1 THEN concat('searches=', CAST(i.row_id % 5 AS STRING), '/4; fetches=', CAST(i.row_id % 7 AS STRING), '/8') ELSE '' END AS budget_spent,
  CASE i.row_id % 6 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'duplicate_model' ELSE '' END AS cache_hit,
  CAST(i.row_id % 3 AS INT) AS searches_avoided,
  i.row_id % 6 = 2 AS duplicate_model_skipped,
  CASE i.row_id % 4 WHEN 0 THEN 'Dimensions, Image URL' WHEN 1 THEN 'Dimensions' ELSE '' END AS fields_filled,
  CASE i.row_id % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'complete' ELSE '' END AS dimensions_status,
  CASE i.row_id % 6 WHEN 0 THEN 'fallback' ELSE '' END AS image_status,
  CASE i.row_id % 5 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'dealer' ELSE '' END AS source_status,
  CASE WHEN i.row_id % 10 = 0 THEN 'Accessory kit' ELSE '' END AS product_component_type,
  i.row_id % 17 = 0 AS budget_blocked,
  CASE i.row_id % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'skipped_budget_cap' ELSE '' END AS enrichment_status,
  CASE WHEN i.row_id % 3 = 0 THEN 'cache_lookup; page_fetch' ELSE '' END AS stage_log
FROM intake i
"""

# Product cache: one entry per product key, with blanks, nulls and bad links.
VIEWS["product_cache"] = """
SELECT concat(lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '')), '_', lower(p_type), CAST(p_partkey AS STRING)) AS product_key,
  CASE p_partkey % 5 WHEN 0 THEN 'https://maker.example.com/search' WHEN 1 THEN 'https://[bad' WHEN 2 THEN CAST(NULL AS STRING)
    ELSE concat('https://maker.example.com/p/', CAST(p_partkey AS STRING)) END AS product_url,
  p_name AS product_name, CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'Brass' END AS finish,
  CASE WHEN p_partkey % 2 = 0 THEN 'Steel' ELSE '' END AS material, 'Hardware' AS product_category,
  CASE WHEN p_partkey % 3 = 0 THEN 'ftp://cdn.example.com/x.jpg' ELSE concat('https://cdn.example.com/c/', CAST(p_partkey AS STRING), '.jpg') END AS image_url,
  CASE WHEN p_partkey % 4 = 1 THEN '' ELSE concat(CAST(p_size AS STRING), '"W x 30"H x 20"D') END AS dimensions,
  CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS dimension_confidence,
  CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS general_confidence
FROM part WHERE p_partkey % 7 <> 0
"""

# New findings for the product cache; null means searched without result.
VIEWS["cache_delta"] = """
SELECT concat(lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '')), '_', lower(p_type), CAST(p_partkey AS STRING)) AS product_key,
  CASE p_partkey % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'https://[bad' WHEN 2 THEN '' ELSE concat('https://new.example.com/p/', CAST(p_partkey AS STRING)) END AS product_url,
  CASE p_partkey % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN '' ELSE CAST(NULL AS STRING) END AS finish,
  CASE WHEN p_partkey % 4 = 0 THEN 'HTTP 404' ELSE '' END AS product_url_reason
FROM part WHERE p_partkey % 3 <> 1
"""

# The same findings with sizes of different certainty.
VIEWS["cache_delta_wide"] = """
SELECT d.*, CASE WHEN length(d.product_key) % 5 = 0 THEN CAST(NULL AS STRING) WHEN length(d.product_key) % 5 = 1 THEN '' ELSE '9"W x 9"H x 9"D' END AS dimensions,
  CASE ascii(substring(d.product_key, 7, 1)) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS dimension_confidence, 'Found by phone' AS remark
FROM cache_delta d
"""

# Learned domains, one per supplier, and one increment each.
VIEWS["preferred_domains"] = """
SELECT CASE s_suppkey % 4 WHEN 0 THEN concat('brand', CAST(s_suppkey % 60 AS STRING), '.example.com') WHEN 1 THEN concat('dealer', CAST(s_suppkey AS STRING), '.example.org')
    WHEN 2 THEN concat('docs', CAST(s_suppkey AS STRING), '.example.net') ELSE concat('maker', CAST(s_suppkey AS STRING), '.example.com') END AS domain,
  s_suppkey AS domain_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'retailer' ELSE 'other' END AS source_type,
  CAST(s_suppkey % 9 AS INT) AS success_count, CAST(s_suppkey % 5 AS INT) AS failure_count, s_suppkey % 6 = 0 AS downranked,
  CASE s_suppkey % 10 WHEN 0 THEN concat('good for Brand#', CAST(s_suppkey % 50 AS STRING)) ELSE '' END AS notes
FROM supplier
"""

VIEWS["domain_events"] = """
SELECT CASE l_suppkey % 4 WHEN 0 THEN concat('WWW.brand', CAST(l_suppkey % 60 AS STRING), '.example.com') WHEN 1 THEN concat('https://dealer', CAST(l_suppkey AS STRING), '.example.org/x')
    WHEN 2 THEN 'not a host' ELSE concat('new', CAST(l_suppkey AS STRING), '.example.com') END AS domain,
  CAST(CASE WHEN l_linenumber % 3 > 0 THEN 1 ELSE 0 END AS INT) AS success_count, CAST(CASE WHEN l_linenumber % 3 > 0 THEN 0 ELSE 1 END AS INT) AS failure_count,
  CAST(l_shipdate AS TIMESTAMP) AS happened_at
FROM lineitem
"""

# Brand to domain: user entries, the fixed table, discovered entries.
VIEWS["brand_domains"] = """
SELECT DISTINCT p_brand AS brand, 'user' AS source, 1 AS priority, concat('user-', lower(replace(p_brand, '#', '')), '.example.com') AS domain FROM part WHERE p_brand LIKE '%1'
UNION ALL SELECT DISTINCT p_brand, 'hardcoded', 2, concat('fixed-', lower(replace(p_brand, '#', '')), '.example.com') FROM part WHERE p_brand LIKE 'Brand#2%'
UNION ALL SELECT DISTINCT p_brand, 'discovered', 3, CASE WHEN p_brand LIKE '%4' THEN 'bad domain' ELSE concat('found-', lower(replace(p_brand, '#', '')), '.example.com') END FROM part
"""

# Ranked official sites per brand, as the candidate ranking reads them.
VIEWS["brand_sites"] = """
SELECT DISTINCT lower(replace(p_brand, '#', '')) AS brand_key, 0 AS site_rank, CASE WHEN p_brand LIKE '%3' THEN 'maker.example.com' ELSE 'docs.example.net' END AS domain FROM part
UNION ALL SELECT DISTINCT lower(replace(p_brand, '#', '')), 1, 'shop.example.org' FROM part WHERE p_brand LIKE '%2'
"""

# Table rows of quotes: two header layouts and one without header; cells joined by '|'.
VIEWS["quote_cells"] = """
SELECT o_orderkey AS doc_id, 1 AS page, 0 AS table_no, 0 AS row_no, CASE o_orderkey % 3 WHEN 0 THEN 'Item Description|Model #|Qty|Unit Price|Color'
  WHEN 1 THEN 'Manufacturer|Model|Description|Quantity|Amount' ELSE 'ok|ok' END AS cell_text FROM orders
UNION ALL SELECT l_orderkey, 1, 0, CAST(l_linenumber * 10000019 + (l_partkey * 10007 + l_suppkey * 101 + CAST(floor(l_quantity) AS BIGINT)) % 10000019 AS INT), CASE l_orderkey % 3 WHEN 0 THEN concat(p_name, '|', p_type, CAST(p_partkey AS STRING), '|', CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), ' pcs|$10.00|Brass')
  WHEN 1 THEN concat('Miele|', p_type, CAST(p_partkey AS STRING), '|', p_name, '|', CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), '|$11.00')
  ELSE concat('Wolf ', p_name, ' Model: ', p_type, CAST(p_partkey AS STRING), ' Qty ', CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), '|') END
FROM lineitem JOIN part ON p_partkey = l_partkey
UNION ALL SELECT o_orderkey, 1, 0, 99999999, 'Subtotal|$100.00' FROM orders
"""

# A row_id of ``intake`` is (l_orderkey * 10 + l_linenumber) * 10000019 + a hash below that factor.
IDS_PER_ORDER = 10 * 10000019


def order_of(row_id: str) -> Column:
    """The order key inside a row_id of ``intake``: the document that the line belongs to."""
    return F.expr(f"{row_id} div {IDS_PER_ORDER}")


# Which views a view reads.
NEEDS = {"intake_wide": ("intake",), "source_memory_wide": ("source_memory",), "cache_delta_wide": ("cache_delta",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A sample file of fewer splits than there are cores is dealt out, so that the rules run on all of them; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Tables whose rows a view takes one by one, where these are not the order lines.
ROW_TABLES = {"quote_cells": ("lineitem", "orders"), "quote_lines": ("lineitem", "orders"), "product_pages": ("part",), "search_results": ("part",), "transcripts": ("part",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; only the tables it reads are opened."""
    texts = [VIEWS[dep] for dep in NEEDS.get(name, ())] + [VIEWS[name]]
    words = set(re.findall(r"\w+", " ".join(texts)))
    for t in TABLES:
        if t in words:
            df = table(spark, sf_dir, t)
            (spread(df) if t in ROW_TABLES.get(name, ("lineitem",)) else df).createOrReplaceTempView(t)
    for dep in NEEDS.get(name, ()):
        spark.sql(VIEWS[dep]).createOrReplaceTempView(dep)
    return spark.sql(VIEWS[name])
