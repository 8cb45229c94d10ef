"""Statements for the enrichment-state queries."""

from oracle import frag as f
from oracle.export import weak_page

SQL: dict[str, str] = {}
EFFORT = (" + ".join(f"CASE WHEN {c} <> '' THEN 1 ELSE 0 END" for c in ("product_url", "image_url", "dimensions", "product_name", "supplier", "room", "finish_color", "material"))
          + f" + CASE WHEN complete THEN 3 ELSE 0 END - CASE WHEN {weak_page('product_url')} <> '' THEN 2 ELSE 0 END")
PK = f"CASE WHEN brand <> '' AND model_sku <> '' THEN {f.token('brand')} || '_' || {f.token('model_sku')} ELSE '~' || row_id END"
GAPPY = "(product_name = '' OR NOT complete OR finish_color = '' OR category = '' OR product_url = '' OR NOT https_img)"
E = f"""{f.X}, e AS (SELECT *, {PK} AS product_key, CAST({EFFORT} AS INT) AS effort FROM x),
 reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY effort DESC, row_id) AS q FROM e) t WHERE q = 1)"""
SQL["elect_representative"] = f"{E} SELECT product_key, row_id, effort FROM reps"
FORCED = ["dimension_source_url", "dimension_confidence", "dimension_source_type", "image_confidence", "image_source_url", "selected_product_url", "selected_product_url_confidence"]
CP = [("td AND NOT e.complete", "'Dimensions'"), ("ti", "'image_url'"), ("tp", "'product_url'"), *[(f"r.{c} <> '' AND e.{c} <> r.{c}", f"'{c}'") for c in FORCED],
      *[(f"r.{c} <> '' AND e.{c} = ''", f"'{c}'") for c in ("category", "finish_color", "material")]]
CP = [(c.replace("td", "(r.dimensions <> '' AND (NOT e.complete OR r.complete))").replace("ti", "(r.image_url <> '' AND e.image_url <> r.image_url)") if c in ("ti",) or c.startswith("td") else c.replace("tp", "(r.product_url <> '' AND e.product_url <> r.product_url)") if c == "tp" else c, l) for c, l in CP]
CP[1] = ("(r.image_url <> '' AND (NOT e.https_img OR e.image_url <> r.image_url))", "'image_url'")
O = "r.row_id <> e.row_id"
SQL["propagate_to_duplicates"] = f"""{E} SELECT e.row_id, r.row_id AS rep_id, {O} AS is_duplicate,
 CASE WHEN {O} AND r.dimensions <> '' AND (NOT e.complete OR r.complete) THEN r.dimensions ELSE e.dimensions END AS dimensions,
 CASE WHEN {O} AND r.image_url <> '' THEN r.image_url ELSE e.image_url END AS image_url, CASE WHEN {O} AND r.product_url <> '' THEN r.product_url ELSE e.product_url END AS product_url,
 CASE WHEN {O} AND r.dimension_confidence <> '' THEN r.dimension_confidence ELSE e.dimension_confidence END AS dimension_confidence,
 CASE WHEN {O} AND e.category = '' THEN r.category ELSE e.category END AS category, CASE WHEN {O} AND e.material = '' THEN r.material ELSE e.material END AS material,
 CASE WHEN {O} THEN {f.listing(CP)} ELSE '' END AS copied,
 CAST(CASE WHEN {O} THEN greatest(1, CASE WHEN r.budget_spent = '' THEN 0 ELSE CAST(regexp_extract(r.budget_spent, 'searches=(\\d+)', 1) AS INT) END) ELSE 0 END AS INT) AS avoided
 FROM e JOIN reps r ON r.product_key = e.product_key"""
SQL["duplicate_metrics"] = f"""{E} SELECT count(*) AS products, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT product_key, count(*) AS n FROM e WHERE brand <> '' AND model_sku <> '' AND {GAPPY} GROUP BY 1) t"""
PART = "\\b(trim|panel|kit|blower|filter|accessor(y|ies)|component|insert|sleeve|handle|grille)\\b"
ACC = f"(regexp_matches(lower(concat_ws(' ', product_name, notes, category, model_sku)), '{PART}') OR regexp_matches(model_sku, '^\\d{{4,7}}$'))"
R1 = f"""{E.replace(f.X, f.with_views('intake_wide', 'product_cache') + f.X[len(f.with_views('intake_wide')):])}, q1 AS (SELECT *, CASE WHEN {ACC} THEN 1 ELSE 0 END AS accessory FROM reps WHERE brand <> '' AND model_sku <> '' AND {GAPPY}),
 r1 AS (SELECT q1.*, row_number() OVER (ORDER BY accessory, effort DESC, q1.product_key) <= 250000 // 6000 AS granted, c.dimensions AS cached FROM q1 LEFT JOIN product_cache c ON c.product_key = q1.product_key),
 l1 AS (SELECT count(*) AS open, count(*) FILTER (granted) AS granted, count(*) FILTER (granted AND cached IS NULL) AS searches FROM r1),
 r2 AS (SELECT product_key, accessory, effort, cached, row_number() OVER (ORDER BY accessory, effort DESC, product_key) <= (SELECT (250000 - searches * 6000) // 6000 FROM l1) AS granted
  FROM r1 WHERE NOT ({f.complete('dimensions')} OR (granted AND cached IS NOT NULL AND {f.complete('cached')})))"""
SQL["budget_rounds"] = f"{R1} SELECT product_key, accessory, effort, granted FROM r1"
SQL["budget_rounds_retry"] = f"{R1} SELECT product_key, effort, granted FROM r2"
SQL["budget_ledger"] = f"""{R1}, l2 AS (SELECT count(*) AS open, count(*) FILTER (granted) AS granted, count(*) FILTER (granted AND cached IS NULL) AS searches FROM r2)
 SELECT CAST(0 AS INT) AS round, 'manufacturer_spec' AS name, open, granted, searches, searches * 6000 AS spent, 250000 - searches * 6000 AS "left" FROM l1
 UNION ALL SELECT 1, 'dimension_retry', l2.open, l2.granted, l2.searches, l2.searches * 6000, greatest(0, 250000 - (l1.searches + l2.searches) * 6000) FROM l1, l2"""

LOWC = """(dimension_confidence = 'low' OR image_confidence = 'low' OR selected_product_url_confidence = '0.55')"""
SQL["needs_further"] = f"""{f.X}, n AS (SELECT *, {LOWC} AS lc FROM x) SELECT row_id, include AND NOT charge AND (NOT complete OR NOT https_img OR lc) AS needs,
 include AND NOT charge AND (NOT complete OR NOT https_img OR lc OR (confidence_score > 0 AND confidence_score < 75)) AS needs_scaled,
 {f.listing([('NOT complete', "'dimensions'"), ('NOT https_img', "'image'"), ("product_url = ''", "'product_page_url'"), ("spec_sheet_url = ''", "'spec_sheet_url'"), ('lc', "'low_confidence'")])} AS gaps FROM n"""
SQL["budget_greedy_skip"] = f"""WITH RECURSIVE {f.X[5:]}, n AS (SELECT *, {LOWC} AS lc FROM x), items AS (SELECT row_id % 5 AS run_id, row_id AS ordinal,
  CAST(round((greatest(1, ceil((length(product_name) * 40 + length(notes)) / 4.0)) / CAST(1000 AS DOUBLE) * CAST(0.00015 AS DOUBLE) + CAST(0.00132 AS DOUBLE)) * 1000000) AS BIGINT) AS m
  FROM n WHERE include AND NOT charge AND (NOT complete OR NOT https_img OR lc)),
 w AS (SELECT DISTINCT run_id, CAST(250000 AS BIGINT) AS money, CAST(-1 AS BIGINT) AS ordinal FROM items UNION ALL
  SELECT run_id, money - m, o FROM (SELECT w.run_id, money, min(i.ordinal) AS o, arg_min(m, i.ordinal) AS m FROM w JOIN items i ON i.run_id = w.run_id AND i.ordinal > w.ordinal AND m <= money AND m <= 1600 GROUP BY w.run_id, money) t)
 SELECT run_id, ordinal FROM w WHERE ordinal >= 0"""
SQL["confidence_text"] = f"""{f.with_views('intake')} SELECT row_id, CASE row_id % 4 WHEN 0 THEN CASE WHEN s = 0 THEN concat(p, '%') WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END
 WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' ELSE 'about right' END AS label FROM (SELECT row_id, row_id % 120 AS p, CASE WHEN row_id % 120 > 1 THEN (row_id % 120) / 100.0 ELSE row_id % 120 END AS s FROM intake) t"""
SQL["further_cost"] = f"""{f.with_views('intake')} SELECT row_id, round(greatest(1, ceil((length(product_name) + quantity) / 4.0)) / CAST(1000 AS DOUBLE) * CAST(0.00015 AS DOUBLE) + CAST(0.00132 AS DOUBLE), 9) AS prompt_cost,
 CAST(round(CASE WHEN row_id % 60 = 0 THEN 0 ELSE least(0.25, greatest(0.0025, 0.006 * (row_id % 60) + 0.004)) END, 9) AS DOUBLE) AS screen_cost FROM intake"""
CONF = "CASE row_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
SQL["accept_result"] = f"""{f.X}, r AS (SELECT *, row_id % 3 > 0 AS hit, row_id % 11 > 0 AS safe, {CONF} AS rc, CASE WHEN row_id % 8 = 1 THEN 'high' ELSE {CONF} END AS rd,
  CASE WHEN row_id % 2 = 0 THEN '10"W x 20"H x 30"D' ELSE '' END AS rdim, CASE WHEN row_id % 7 > 1 THEN 'https://cdn.example.com/new.jpg' ELSE 'http://x' END AS rimg,
  CASE WHEN row_id % 2 = 1 THEN 'https://maker.example.com/s.pdf' ELSE '' END AS rspec FROM x),
 k AS (SELECT *, hit AND safe AND rdim <> '' AND rd IN ('high','medium') AND row_id % 5 > 0 AND NOT (dimension_confidence = 'high' OR confidence_score >= 90) AND NOT complete AS a,
  hit AND safe AND row_id % 7 > 1 AND rc IN ('high','medium') AND (NOT https_img OR image_confidence = 'low') AS b, hit AND safe AND product_url = '' AS c, hit AND safe AND rspec <> '' AND spec_sheet_url = '' AS d FROM r)
 SELECT row_id, CASE WHEN a THEN rdim ELSE dimensions END AS dimensions, CASE WHEN b THEN rimg ELSE image_url END AS image_url, CASE WHEN c THEN 'https://maker.example.com/p/new' ELSE product_url END AS product_url,
 CASE WHEN d THEN rspec ELSE spec_sheet_url END AS spec_sheet_url, {f.listing([('a', "'Dimensions'"), ('b', "'Image URL'"), ('c', "'Product URL'"), ('d', "'spec_sheet_url'")])} AS filled,
 CASE WHEN hit THEN {f.listing([("rdim <> ''", "'dimensions'"), ('true', "'image'"), ('true', "'product_page_url'"), ("rspec <> ''", "'spec_sheet_url'")])} ELSE '' END AS recovered,
 CASE WHEN NOT hit THEN 'no_result' WHEN a OR b OR c OR d THEN 'updated' ELSE 'no_verified_fields' END AS result_status FROM k"""
SQL["join_result_by_row_id"] = f"""{f.with_views('intake_wide')}, k AS (SELECT *, category = '' AND row_id % 2 = 0 AS hit FROM intake_wide)
 SELECT row_id, CASE WHEN hit THEN 'Seating' ELSE category END AS category, CAST(CASE WHEN hit THEN row_id % 100 ELSE 0 END AS INT) AS ai_category_confidence,
 CASE WHEN hit THEN 'AI Suggested' ELSE 'Unknown' END AS category_source, review_required OR (hit AND row_id % 100 < 75) AS review_required FROM k"""
OLD = "(CASE WHEN w_ <> '' THEN 1 ELSE 0 END + CASE WHEN h_ <> '' THEN 1 ELSE 0 END + CASE WHEN d_ <> '' THEN 1 ELSE 0 END)"
FIN = "CASE WHEN finish_color = '' THEN 'Nickel' ELSE finish_color END"
SQL["apply_extracted"] = f"""{f.X} SELECT row_id, CASE WHEN row_id % 4 = 0 THEN '10"W x 20"H x 30"D' WHEN row_id % 4 = 1 AND {OLD} < 2 THEN '10"W x 20"H' ELSE dimensions END AS dimensions,
 CASE WHEN row_id % 4 = 0 THEN CASE WHEN row_id % 100 >= 80 THEN 'high' ELSE 'medium' END WHEN row_id % 4 = 1 AND {OLD} < 2 THEN 'medium' ELSE dimension_confidence END AS dimension_confidence,
 CASE WHEN product_name = '' THEN 'Found name' ELSE product_name END AS product_name, {FIN} AS finish_color, CASE WHEN category = '' THEN 'Seating' ELSE category END AS category,
 CASE WHEN product_url = '' THEN 'https://maker.example.com/e' ELSE product_url END AS product_url,
 concat_ws(' ', nullif(notes, ''), CASE WHEN row_id % 4 = 2 THEN '[Partial dimension found: 10"W; full W x H x D still needed]' WHEN row_id % 4 = 1 AND {OLD} >= 2 THEN '[Partial dimension found: 10"W x 20"H; full W x H x D still needed]' END,
  CASE WHEN row_id % 3 = 0 AND NOT contains(lower({FIN}), 'brass') THEN '[Materials: Brass]' END) AS notes, source_type || '_Enriched' AS source_type, review_required OR row_id % 100 < 60 AS review_required FROM x"""
WK = f"({weak_page('product_url')} <> '')"
SQL["fill_from_page"] = f"""{f.with_views('intake_wide')} SELECT row_id, CASE WHEN product_name = '' THEN 'Page name' ELSE product_name END AS product_name, CASE WHEN brand = '' AND row_id % 2 = 0 THEN 'Page brand' ELSE brand END AS brand,
 CASE WHEN finish_color = '' THEN 'Chrome' ELSE finish_color END AS finish_color, material, CASE WHEN category = '' THEN 'Seating' ELSE category END AS category,
 CASE WHEN notes = '' THEN '[Description: A long text]' ELSE notes END AS notes, CASE WHEN {WK} THEN 'https://maker.example.com/page' ELSE product_url END AS product_url, source_type || '_Enriched' AS source_type,
 review_required OR row_id % 3 = 0 AS review_required, {f.listing([("product_name = ''", "'Product Name'"), ("brand = '' AND row_id % 2 = 0", "'Brand'"), ("finish_color = ''", "'Finish / Color'"), ("category = ''", "'Product Category'"), ("notes = ''", "'Notes'"), (WK, "'Product URL'")])} AS page_filled FROM intake_wide"""
WHY = "CASE row_id % 3 WHEN 0 THEN 'no verified product match' WHEN 1 THEN 'no confident source found' ELSE 'HTTP 404' END"
SQL["mark_failed"] = f"""{f.with_views('intake_wide')} SELECT row_id, concat_ws(' ', nullif(notes, ''), '[ENRICHMENT_FAILED: ' || {WHY} || ']', CASE WHEN row_id % 3 = 1 THEN '[Enrichment: no confident source found]' END) AS notes,
 true AS review_required, 'ENRICHMENT_FAILED: ' || {WHY} AS suggested_action, status, 'failed' AS enrichment_status, {WHY} AS enrichment_error FROM intake_wide"""
SQL["preserve_audit"] = f"""{f.with_views('intake_wide')} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'https://new.example.com' ELSE dimension_source_url END AS dimension_source_url,
 CASE WHEN stage_log = '' THEN CASE WHEN row_id % 2 = 0 THEN 'page_fetch' ELSE 'complete' END WHEN row_id % 2 = 0 THEN stage_log ELSE stage_log || '; complete' END AS stage_log FROM intake_wide"""
PAGE = "CASE WHEN selected_product_url <> '' THEN selected_product_url ELSE product_url END"
MK = f"({f.no_www(f.netloc(PAGE))} = manufacturer_domain_used AND manufacturer_domain_used <> '')"
ST = f"""CASE WHEN complete THEN 'complete' WHEN dimensions <> '' THEN 'partial' ELSE 'missing' END AS s_dim, CASE WHEN https_img THEN 'found' WHEN image_source_url <> '' THEN 'fallback' ELSE 'missing' END AS s_img,
 CASE WHEN dimension_source_type = 'manufacturer_page' OR {MK} THEN 'manufacturer' WHEN dimension_source_type = 'retailer' THEN 'dealer' WHEN {PAGE} <> '' THEN 'fallback' ELSE 'manual' END AS s_src,
 CASE WHEN {ACC} THEN 'accessory/component' ELSE 'primary_product' END AS s_comp, CASE WHEN brand = '' OR model_sku = '' THEN 'needs_review' WHEN complete AND https_img THEN 'complete'
  WHEN product_url <> '' OR image_url <> '' OR dimensions <> '' THEN 'partially_enriched' ELSE 'needs_review' END AS s_enr"""
RETRY = "CASE WHEN s_dim IN ('missing','partial') THEN 'dimension-focused retry' WHEN s_img IN ('missing','failed') THEN 'image-only retry' ELSE '' END"
SQL["enrichment_status"] = f"""{f.X}, s AS (SELECT row_id, {ST} FROM x) SELECT row_id, s_dim AS dimensions_status, s_img AS image_status, s_src AS source_status, s_comp AS product_component_type, s_enr AS enrichment_status, {RETRY} AS retry FROM s"""
SQL["status_badges"] = f"""{f.X} SELECT row_id, {f.listing([('complete', "'Complete dimensions'"), ("NOT complete AND dimensions_status = 'partial'", "'Partial dimensions'"), ("NOT complete AND dimensions_status <> 'partial'", "'Missing dimensions'"),
 ("image_url <> ''", "'Image found'"), ("image_url = '' AND image_status = 'fallback'", "'Fallback image'"), ("image_url = '' AND image_status <> 'fallback'", "'Missing image'"), ('budget_blocked', "'Skipped due to budget'"),
 ("product_component_type <> ''", "'Accessory/component'"), ("source_status = 'manufacturer'", "'Manufacturer source'"), ("source_status = 'dealer'", "'Dealer source'"), ("enrichment_status = 'needs_review'", "'Needs review'")])} AS badges FROM x"""
CV = "coalesce(CASE selected_product_url_confidence WHEN 'high' THEN 0.95 WHEN '0.55' THEN 0.55 WHEN '81' THEN 0.81 END, CASE dimension_confidence WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.72 WHEN 'low' THEN 0.35 END, CASE image_confidence WHEN 'high' THEN 0.95 END)"
SQL["enrichment_summary"] = f"""{f.X}, i AS (SELECT *, CAST({CV} AS DOUBLE) AS cv, CASE WHEN budget_spent = '' THEN 0 ELSE row_id % 5 END AS se, CASE WHEN budget_spent = '' THEN 0 ELSE row_id % 7 END AS fe,
  CASE row_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS uf FROM x WHERE include AND NOT charge),
 t AS (SELECT count(*) AS rows_considered, count(*) FILTER (fields_filled <> '' OR selected_product_url <> '' OR product_url <> '' OR dimensions <> '' OR image_url <> '') AS rows_enriched,
  count(*) FILTER (NOT complete) AS rows_missing_dimensions, count(*) FILTER (image_url = '') AS rows_missing_images, count(*) FILTER (dimensions_status = 'partial') AS rows_partial_dimensions,
  count(*) FILTER (enrichment_status = 'skipped_budget_cap') AS rows_budget_skipped, round(avg(cv), 3) AS average_confidence, CAST(sum(se) AS BIGINT) AS searches_used, CAST(sum(fe) AS BIGINT) AS fetches_used,
  count(*) FILTER (cache_hit <> '') AS cache_hits, count(*) FILTER (duplicate_model_skipped) AS duplicates_skipped, CAST(sum(searches_avoided) AS BIGINT) AS searches_avoided, CAST(sum(uf) AS BIGINT) AS useful_fields,
  count(*) FILTER (complete) AS dimensions_present, count(*) FILTER (image_url <> '') AS images_present FROM i),
 m AS (SELECT *, searches_used * CAST(0.006 AS DOUBLE) AS money FROM t)
 SELECT * EXCLUDE (money), round(money, 4) AS estimated_cost, round(greatest(0, 0.25 - money), 4) AS budget_remaining, round(money / useful_fields, 4) AS cost_per_field, round(money / dimensions_present, 4) AS cost_per_dimension,
 round(dimensions_present / money, 2) AS dimensions_per_dollar, round(images_present / money, 2) AS images_per_dollar FROM m"""
SQL["product_groups"] = f"""{f.with_views('intake_wide')} SELECT coalesce(nullif({f.token('brand')}, ''), 'missingbrand') || '_' || coalesce(nullif({f.token('model_sku')}, ''), concat('missingmodel', row_id)) AS product_key,
 count(*) AS rows, min(row_id) AS first_row, count(*) - 1 AS duplicates FROM intake_wide GROUP BY 1"""
SQL["product_group_members"] = f"""{f.with_views('intake_wide')}, k AS (SELECT row_id, coalesce(nullif({f.token('brand')}, ''), 'missingbrand') || '_' || coalesce(nullif({f.token('model_sku')}, ''), concat('missingmodel', row_id)) AS product_key FROM intake_wide)
 SELECT product_key, CAST(row_number() OVER (PARTITION BY product_key ORDER BY row_id) AS INT) AS member, row_id FROM k"""
LINES = [("Brand", "brand"), ("Model", "model_sku"), ("Dimensions", "dimensions"), ("Image URL", "image_url"), ("Product URL", "product_url"), ("Status", "s_enr"), ("Retry", RETRY)]
SQL["debug_report_sections"] = f"{E}, s AS (SELECT *, {ST} FROM reps) " + " UNION ALL ".join(f"SELECT product_key, '{l}' AS label, CASE WHEN trim({c}) = '' THEN 'none' ELSE trim({c}) END AS value FROM s" for l, c in LINES)
SQL["dimension_diagnostics"] = f"{E} SELECT product_key, enrichment_status, dimension_source_url, dimensions_status, min(row_id) AS row_id FROM e GROUP BY 1, 2, 3, 4"
SQL["charge_rows"] = f"{f.X} SELECT row_id, price, import_type FROM x WHERE charge"
