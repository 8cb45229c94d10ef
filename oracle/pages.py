"""Statements for the page queries."""

from oracle import frag as f
from oracle.lookup import SITES, place

V = f.with_views
SQL: dict[str, str] = {}

SQL["dims_candidates"] = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '"W x 20"H x 5"D') WHEN 1 THEN concat(p_size, ' x 14, steel') WHEN 3 THEN '3.937"W x 7.874"D x 11.811"H' ELSE '' END AS candidates FROM part"""
SQL["dims_best"] = """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 1 ELSE 2 END AS INT) AS pos,
 CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, '"W x 3"H x 4"D') WHEN p_partkey % 3 = 0 THEN concat(p_size, '"W x 3"H') ELSE 'Width 5 cm, Height: 6, Depth is 7' END AS dimensions,
 CAST(CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 2 ELSE 3 END AS INT) AS axes FROM part"""
SQL["snippet"] = """SELECT p_partkey AS page_id, p_name || ' | Maker ' || CASE p_partkey % 4 WHEN 0 THEN '{"@type":"Product","name":"' || p_name || '","width":"' || p_size || ' in","height":"30 in","depth":"20 in"}'
 WHEN 1 THEN 'Width ' || p_size || '" Height 30" Depth 20"' WHEN 2 THEN 'Product Dimensions: ' || p_size || '"W x 30"H x 20"D' ELSE 'Shipping dimensions: 40 x 40 x 40 in' END AS snippet FROM part"""
SQL["page_dimensions"] = """SELECT p_partkey AS page_id, concat(p_size, '"W x 30"H x 20"D') AS dimensions, CAST(3 AS INT) AS axes,
 CASE p_partkey % 4 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'table_parts' ELSE 'visible_text' END AS method FROM part WHERE p_partkey % 4 < 3"""
SQL["text_page_dimensions"] = """WITH t AS (SELECT p_partkey % 50 AS doc_id, p_partkey AS page, CASE WHEN p_partkey % 100 >= 50 THEN 3 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS axes,
 CASE WHEN p_partkey % 100 >= 50 THEN concat(p_size, '"W x 1"H x 2"D') ELSE concat(p_size, '"W') END AS dimensions FROM part)
 SELECT doc_id, page, CAST(0 AS INT) AS pos, dimensions, CAST(axes AS INT) AS axes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY axes DESC, page) AS rn FROM t WHERE axes > 0) u WHERE rn = 1"""
IMG = """i AS (SELECT p_partkey AS page_id, 'https://cdn.example.com/i/' || p_partkey || '.jpg' AS image_url, 'og:image' AS source_type, '' AS alt, '' AS context, CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height FROM part
 UNION ALL SELECT p_partkey, 'https://www.maker.example.com/logo.png', 'img', '', 'logo', NULL, NULL FROM part
 UNION ALL SELECT p_partkey, 'https://www.maker.example.com/img/' || lower(p_type) || p_partkey || '.jpg', 'img', p_name, 'gallery', 600, 600 FROM part)"""
SQL["page_images"] = f"WITH {IMG} SELECT * FROM i"
HITS = "len(list_filter(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}'), lambda w: w NOT IN ('the','and','with','for','product')), lambda w: contains(lower(image_url || ' ' || alt), w)))"
SCI = f"""WITH {IMG}, s AS (SELECT i.*, p_partkey, CASE WHEN context = 'logo' THEN 'contains logo' ELSE '' END AS rejection, least(18, 6 * {HITS})
  + CASE WHEN source_type = 'og:image' THEN 35 + 5 + 8 ELSE 12 END + CASE WHEN context = 'gallery' THEN 40 + 20 + 15 ELSE 0 END
  + CASE WHEN p_partkey % 2 = 0 AND source_type = 'img' THEN 12 ELSE 0 END - CASE WHEN context = 'logo' THEN 60 ELSE 0 END AS raw FROM i JOIN part ON p_partkey = page_id),
 sc AS (SELECT *, CAST(least(100, greatest(0, raw)) AS INT) AS score FROM s)"""
LAB = "CASE WHEN {0} >= 70 THEN 'high' WHEN {0} >= 45 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'none' END"
SQL["score_images"] = f"{SCI} SELECT page_id, image_url, score, {LAB.format('score')} AS confidence, rejection FROM sc"
SQL["select_best_image"] = f"""{SCI}, b AS (SELECT *, CAST(least(100, score + 10) AS INT) AS final_score FROM sc WHERE rejection = '' AND (page_id % 5 > 0 OR source_type = 'og:image')),
 r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, source_type DESC) AS rn FROM b WHERE final_score >= 45) SELECT page_id, image_url, score, final_score, {LAB.format('final_score')} AS final_confidence FROM r WHERE rn = 1"""
SQL["top_image_diagnostics"] = f"""{SCI}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, source_type DESC) AS INT) AS place FROM sc) SELECT page_id, place, image_url, score FROM r WHERE place <= 2"""
SQL["page_fields"] = """SELECT p_partkey AS page_id, p_name AS name, '' AS brand, '' AS category, '' AS description, '' AS finish, '' AS material, p_name || ' | Maker' AS title FROM part"""
SQL["spec_links"] = """SELECT p_partkey AS page_id, 'https://www.maker.example.com/docs/' || p_partkey || '.pdf' AS link, CAST(3 AS INT) AS score, CAST(1 AS INT) AS place FROM part
 UNION ALL SELECT p_partkey, 'https://www.maker.example.com/docs/general-manual.pdf', 1, 2 FROM part"""
SQL["score_pages"] = f"""{V('brand_sites')}, {SITES}, p AS (SELECT p_partkey AS page_id, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'maker' ELSE lower(replace(p_brand, '#', '')) END AS bk, p_partkey % 2 = 0 AS matched_brand FROM part),
 q AS (SELECT p.*, {place("'maker.example.com'", "coalesce(sites, [])")} IS NOT NULL AS official_site, CASE WHEN len(regexp_extract_all(lower(p_name), '[a-z0-9]{{4,}}')) > 0 THEN 15 ELSE 0 END AS sim FROM p LEFT JOIN bs ON bs.brand_key = bk),
 r AS (SELECT *, CAST(CASE WHEN NOT matched_brand AND NOT official_site THEN 0 ELSE least(100, 50 + CASE WHEN matched_brand THEN 15 ELSE 0 END + CASE WHEN official_site THEN 25 ELSE 0 END + sim + CASE WHEN page_id % 4 = 0 THEN 10 ELSE 0 END + 20) END AS INT) AS score FROM q)
 SELECT page_id, score, CASE WHEN NOT matched_brand AND NOT official_site THEN 'none' WHEN official_site AND score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS page_confidence,
 official_site, matched_brand, 'url,html' AS locations, CASE WHEN NOT matched_brand AND NOT official_site THEN 'brand not found on candidate page' ELSE '' END AS rejection FROM r"""
SQL["select_verified_page"] = f"""{V('search_results')}, c AS (SELECT product_id, result_ordinal + 1 AS position, product_id * 3 + result_ordinal * 7 AS n FROM search_results),
 d AS (SELECT product_id, position, CASE n % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS page_confidence, n % 5 < 2 AS official_site, 60 + n % 40 AS score FROM c WHERE position <= 3),
 e AS (SELECT *, max(CASE WHEN page_confidence = 'high' AND official_site THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d),
 g AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY page_confidence = 'high' DESC, official_site DESC, score DESC, position) AS rn FROM e WHERE coalesce(seen, 0) = 0 AND page_confidence IN ('high', 'medium'))
 SELECT product_id, position, page_confidence, official_site, score FROM g WHERE rn = 1"""
SQL["recover_images"] = f"""{V('intake_wide')}, pg AS (SELECT {f.token('p_brand')} || '_' || lower(p_type) || p_partkey AS pk, 'https://www.maker.example.com/img/' || lower(p_type) || p_partkey || '.jpg' AS img FROM part)
 SELECT row_id, coalesce(img, image_url) AS image_url, img IS NOT NULL AS recovered FROM intake_wide LEFT JOIN pg ON brand <> '' AND model_sku <> '' AND pk = {f.token('brand')} || '_' || {f.token('model_sku')} WHERE NOT {f.https('image_url')}"""
