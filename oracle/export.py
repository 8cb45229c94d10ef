"""Statements for the export and review queries."""

from oracle import frag as f
from oracle.rows import PARSE, contamination, identity

SQL: dict[str, str] = {}

WEAK_PAGE = f"""CASE WHEN u = '' THEN 'empty URL' WHEN contains({f.netloc('u')}, '[') THEN 'Invalid IPv6 URL: Invalid IPv6 URL' WHEN trim({f.path('u')}, '/') = '' THEN 'homepage'
 WHEN contains({f.path('u')}, 'sitemap') THEN 'sitemap page' WHEN ends_with({f.path('u')}, '.pdf') THEN 'spec PDF, not product page'
 WHEN contains(trim({f.path('u')}, '/'), '/search') OR regexp_matches(u, '[?&]search=[^&]') THEN 'search result page'
 WHEN regexp_matches(trim({f.path('u')}, '/'), '\\b(sitemap|search|category|collections?|browse|tag|blog|support)$') THEN 'category/browse page' ELSE '' END"""


def weak_page(c: str) -> str:
    import re

    return re.sub(r"\bu\b", c, WEAK_PAGE)


SQL["weak_product_url"] = f"{f.X} SELECT row_id, {weak_page('product_url')} AS enrichment_reason, url_reason AS export_reason FROM x"

TITLE_OK = f"(product_name <> '' AND product_name = {f.title('product_name')})"
RICH = f"""least(length(product_name), 20) + CASE WHEN {TITLE_OK} THEN 3 ELSE 0 END
 + CASE WHEN brand <> '' THEN 10 ELSE 0 END + CASE WHEN model_sku <> '' THEN 10 ELSE 0 END + CASE WHEN room <> '' THEN 10 ELSE 0 END
 + CASE WHEN supplier <> '' THEN 8 ELSE 0 END + CASE WHEN category <> '' THEN 8 ELSE 0 END + CASE WHEN finish_color <> '' THEN 6 ELSE 0 END
 + CASE WHEN material <> '' THEN 6 ELSE 0 END + CASE WHEN notes <> '' THEN 3 ELSE 0 END
 + CASE WHEN dimensions <> '' AND reason = '' THEN CASE WHEN complete THEN 16 ELSE 7 END ELSE 0 END
 + CASE WHEN img_ok THEN 14 ELSE 0 END + CASE WHEN product_url <> '' AND url_reason = '' THEN 10 ELSE 0 END
 + CASE WHEN contains(lower(source_type), 'ai') OR contains(lower(source_type), 'enrich') THEN 6 ELSE 0 END"""

# The rule as written: rooms per key, richest room for blank rooms, best score per bucket.
DEDUPE = f"""{f.X}, r AS (SELECT *, CAST({RICH} AS INT) AS richness, {f.token('brand')} AS kb, {f.token('model_sku')} AS km, {f.spaced('room')} AS rk FROM x),
 keyed AS (SELECT * FROM r WHERE include AND kb <> '' AND km <> ''),
 room_best AS (SELECT kb, km, rk, max(richness) AS m FROM keyed WHERE rk <> '' GROUP BY ALL),
 room_n AS (SELECT kb, km, count(*) AS n FROM room_best GROUP BY ALL),
 top_room AS (SELECT kb, km, rk AS top_rk FROM (SELECT *, row_number() OVER (PARTITION BY kb, km ORDER BY m DESC, rk) AS q FROM room_best) t WHERE q = 1),
 b AS (SELECT keyed.*, CASE WHEN coalesce(room_n.n, 0) <= 1 THEN '' WHEN rk = '' THEN top_rk ELSE rk END AS bucket
   FROM keyed LEFT JOIN room_n USING (kb, km) LEFT JOIN top_room USING (kb, km)),
 best AS (SELECT kb, km, bucket, max(richness) AS top FROM b GROUP BY ALL),
 kept AS (SELECT kb, km, bucket, min(row_id) AS kid FROM b JOIN best USING (kb, km, bucket) WHERE richness = top GROUP BY ALL),
 flags AS (SELECT row_id, richness < top AS removed, CASE WHEN richness < top THEN kid END AS kept_row_id FROM b JOIN best USING (kb, km, bucket) JOIN kept USING (kb, km, bucket)),
 m AS (SELECT r.*, coalesce(flags.removed, false) AS removed, flags.kept_row_id FROM r LEFT JOIN flags USING (row_id)),
 p AS (SELECT m.* REPLACE (CASE WHEN reason <> '' THEN '' ELSE dimensions END AS dimensions, CASE WHEN url_reason <> '' THEN '' ELSE product_url END AS product_url),
   product_url AS raw_url, CASE WHEN reason <> '' THEN '' WHEN complete THEN concat(w_, '"W x ', h_, '"H x ', d_, '"D') ELSE dimensions END AS xdims,
   complete AND reason = '' AS xcomplete FROM m)"""

SQL["export_dedupe"] = f"{DEDUPE} SELECT row_id, richness, removed, kept_row_id FROM m"


def first_url(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ", '')"


RETAIL = "ajmadison|appliancesconnection|bestbuy|build|designerappliances|ferguson|homedepot|lowes|perigold|wayfair"
ARCH = "(?i)\\b(manual|archive|manuals|install|installation|guide|document)\\b"


def kind(u: str, hint: str) -> str:
    d = f.no_www(f.host(u))
    return (
        f"CASE WHEN {f.pdf(u)} AND regexp_matches({u}, '{ARCH}') THEN 'Manual/archive' WHEN {f.pdf(u)} THEN 'Spec sheet PDF' "
        f"WHEN contains({hint}, 'manual') OR contains({hint}, 'archive') OR contains({hint}, 'installation') THEN 'Manual/archive' "
        f"WHEN contains({hint}, 'spec') OR contains({hint}, 'pdf') THEN 'Spec sheet PDF' "
        f"WHEN contains({hint}, 'retailer') OR regexp_matches({d}, '(^|\\.)({RETAIL})\\.com$') THEN 'Retailer' "
        f"WHEN manufacturer_domain_used <> '' AND ({d} = manufacturer_domain_used OR ends_with({d}, '.' || manufacturer_domain_used)) THEN 'Manufacturer' "
        f"WHEN contains({hint}, 'manufacturer') THEN 'Manufacturer' ELSE 'Unknown' END"
    )


def label(u: str, hint: str, conf: str = "''") -> str:
    shown = f"CASE WHEN {conf} IN ('high', 'medium', 'low') THEN {conf} || ' confidence' ELSE {conf} END"
    parts = f"concat_ws(', ', nullif({kind(u, hint)}, 'Unknown'), nullif({shown}, ''))"
    return f"CASE WHEN {parts} = '' THEN '' ELSE ' (' || {parts} || ')' END"


def block_ctes(src: str) -> str:
    """Source block; ``src`` has dimensions / product_url as exported plus the wide columns."""
    return f"""n1 AS (SELECT *, dimension_source_url AS du, {first_url('image_source_url', 'image_url')} AS iu, {first_url('product_url', 'selected_product_url')} AS pu0 FROM {src}),
 n2 AS (SELECT *, CASE WHEN {f.export_reason('pu0', 'model_sku')} <> '' OR {f.pdf('pu0')} THEN '' ELSE pu0 END AS pu,
   CASE WHEN spec_sheet_url <> '' THEN spec_sheet_url WHEN {f.pdf('du')} THEN du WHEN {f.pdf('product_url')} THEN product_url WHEN {f.pdf('selected_product_url')} THEN selected_product_url ELSE '' END AS su FROM n1),
 n3 AS (SELECT *, {first_url('du', 'su', 'pu')} AS da, {first_url('iu', 'pu')} AS ia, replace(dimension_source_type, '_', ' ') AS dh FROM n2),
 n4 AS (SELECT *, list_distinct_keep([
   CASE WHEN ncomplete AND du <> '' THEN 'Dimensions source: ' || du || {label('du', 'dh', 'dimension_confidence')} END,
   CASE WHEN NOT ncomplete AND da <> '' THEN 'Dimensions missing — check source: ' || da || {label('da', 'dh', 'dimension_confidence')} END,
   CASE WHEN img_ok AND iu <> '' THEN 'Image source: ' || iu || {label('iu', "'image'", 'image_confidence')} END,
   CASE WHEN NOT img_ok AND ia <> '' THEN 'Image missing — check source: ' || ia || {label('ia', "'image'", 'image_confidence')} END,
   CASE WHEN pu <> '' THEN 'Product page: ' || pu || {label('pu', "'product page'", 'selected_product_url_confidence')} END,
   CASE WHEN su <> '' THEN 'Spec sheet: ' || su || {label('su', "'spec sheet'")} END,
   CASE WHEN manufacturer_domain_used <> '' THEN 'Manufacturer: https://' || manufacturer_domain_used END]) AS lines FROM n3),
 n5 AS (SELECT *, CASE WHEN len(lines) = 0 THEN 'No verified source found during enrichment.' ELSE 'Source links:' || chr(10) || array_to_string(lines, chr(10)) END AS block FROM n4)""".replace(
        "list_distinct_keep([", "list_filter([").replace("]) AS lines", "], lambda v: v IS NOT NULL) AS lines")


SQL["source_notes_block"] = f"{f.X}, x2 AS (SELECT *, complete AS ncomplete FROM x), {block_ctes('x2')} SELECT row_id, block FROM n5"

NOTES = """CASE row_id % 7 WHEN 0 THEN 'Ships later' WHEN 1 THEN 'Confirm finish with client' WHEN 2 THEN 'Contact sales@dealer.example.com'
 WHEN 3 THEN 'Call 416-555-0199 for lead time' WHEN 4 THEN 'Keep in storage until spring' ELSE '' END"""
ROWNOTE = f"""trim(concat_ws(' ', nullif({NOTES}, ''), CASE WHEN reason <> '' THEN 'Dimensions rejected before export: ' || reason || '.' END))"""
# A remark follows the last note line: with note lines removed as noise it follows the kept ones.
IMPORT = f"""{DEDUPE}, e AS (SELECT *, xcomplete AS ncomplete FROM p WHERE NOT removed AND exportable), {block_ctes('e')},
 out AS (SELECT row_id, {f.section('category')} AS section, product_name, brand, replace(model_sku, ' ', '') AS sku, '' AS model, xdims AS dimensions,
 CASE WHEN xdims = '' THEN '' ELSE w_ END AS width_in, CASE WHEN xdims = '' THEN '' ELSE h_ END AS height_in, CASE WHEN xdims = '' THEN '' ELSE d_ END AS depth_in, '' AS length_in,
 CAST(quantity AS VARCHAR) AS quantity, price, supplier, product_url, CASE WHEN img_ok THEN image_url ELSE '' END AS image_url, finish_color AS finish, color,
 CASE WHEN material <> '' THEN material WHEN row_id % 7 = 0 THEN 'brass, glass' ELSE '' END AS material, '' AS lead_time,
 CASE WHEN {ROWNOTE} = '' THEN block ELSE {ROWNOTE} || chr(10) || chr(10) || block END AS notes, room AS location,
 CAST(confidence_score AS VARCHAR) AS confidence_score, source_type, dimension_source_url, dimension_confidence, dimension_source_type, enrichment_status, stage_log FROM n5)"""
COLS = "section, product_name, brand, sku, model, dimensions, width_in, height_in, depth_in, length_in, quantity, price, supplier, product_url, image_url, finish, color, material, lead_time, notes, location"
SQL["export_row"] = f"{IMPORT} SELECT row_id, {COLS} FROM out"
HEAD = ("Section", "Product Name", "Brand", "SKU", "Model", "Dimensions", "Width (in)", "Height (in)", "Depth (in)", "Length (in)", "Quantity", "Price",
        "Supplier", "Product URL", "Image URL", "Finish", "Color", "Material", "Lead Time", "Notes", "Location")
SQL["sink_import_csv"] = IMPORT + " SELECT " + ", ".join(f'{c.strip()} AS "{h}"' for c, h in zip(COLS.split(","), HEAD)) + " FROM out"
SQL["export_debug"] = f"""{IMPORT} SELECT row_id, {COLS}, confidence_score, source_type, CASE WHEN row_id % 3 = 0 THEN 'high' ELSE '' END AS category_confidence, 'rules' AS category_source,
 CASE WHEN row_id % 4 = 0 THEN '/images/' || row_id ELSE '' END AS local_image_path, row_id || '.jpg' AS image_filename, dimension_source_url, dimension_confidence, dimension_source_type,
 CASE row_id % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'complete' ELSE '' END AS dimension_lookup_status, enrichment_status, CASE WHEN row_id % 5 = 0 THEN 'timeout' END AS enrichment_error, stage_log, '' AS debug_traceback FROM out"""

MISS = [("NOT xcomplete", "'dimensions'"), ("NOT img_ok", "'image'"),
        ("product_url = '' AND selected_product_url = '' AND dimension_source_url = '' AND spec_sheet_url = '' AND image_source_url = ''", "'product URL/source'"),
        ("model_sku = ''", "'SKU/model'"), ("supplier = ''", "'supplier'"), ("room = ''", "'room/location'")]
FLAGS = f"""{DEDUPE}, g AS (SELECT *, include AND product_name <> '' AS named, include AND product_name <> '' AND (NOT photo_x OR img_ok) AS exported,
 {f.section('category')} AS sec, list_filter([{', '.join(f"CASE WHEN {c} THEN {l} END" for c, l in MISS)}], lambda v: v IS NOT NULL) AS miss,
 {identity('model_sku')} AS ident, {contamination('model_sku')} AS contam FROM p),
 h AS (SELECT *, exported AND NOT photo_x AND (NOT xcomplete OR NOT img_ok) AS needs FROM g)"""
SQL["export_qa_summary"] = f"""{FLAGS}, t AS (SELECT count(*) AS parsed_rows, count(*) FILTER (removed) AS duplicate_rows_removed,
 count(*) FILTER (NOT removed AND include) AS included_rows, count(*) FILTER (NOT removed AND include AND product_name = '') AS nameless_rows,
 count(*) FILTER (NOT removed AND named) AS image_url_total, count(*) FILTER (NOT removed AND named AND img_ok) AS image_url_present,
 count(*) FILTER (NOT removed AND exported) AS export_count, count(*) FILTER (NOT removed AND exported AND NOT needs) AS ready_count,
 count(*) FILTER (NOT removed AND needs) AS needs_enrichment, count(*) FILTER (NOT removed AND exported AND NOT xcomplete) AS missing_dimensions,
 count(*) FILTER (NOT removed AND exported AND product_url = '') AS missing_product_url,
 count(*) FILTER (NOT removed AND named AND NOT img_ok) AS missing_image_url, count(*) FILTER (NOT removed AND exported AND category = '') AS missing_section,
 count(*) FILTER (NOT removed AND reason <> '') AS dimensions_rejected, count(*) FILTER (NOT removed AND url_reason <> '') AS product_urls_rejected,
 count(*) FILTER (NOT removed AND url_reason = '' AND {f.pdf('raw_url')}) AS pdf_product_urls, count(*) FILTER (charge) AS charge_rows,
 count(*) FILTER (include AND ident <> '') AS missing_identity, count(*) FILTER (contam <> '') AS contaminated_rows,
 CAST(coalesce(sum(6 - len(miss)) FILTER (NOT removed AND exported), 0) AS BIGINT) AS readiness_points, count(DISTINCT sec) FILTER (NOT removed AND exported) AS unique_sections FROM h)
 SELECT *, CAST(CASE WHEN export_count > 0 THEN round_even(100.0 * readiness_points / (6 * export_count), 0) ELSE 0 END AS INT) AS readiness_score,
 CASE WHEN included_rows = 0 THEN 'Manual review' WHEN missing_dimensions > 0 OR missing_image_url > 0 THEN 'Needs enrichment'
  WHEN ready_count = included_rows AND (missing_product_url > 0 OR missing_section > 0) THEN 'Ready with warnings' WHEN ready_count = included_rows THEN 'Ready' ELSE 'Manual review' END AS readiness_status,
 unique_sections > 10 AS too_many_sections FROM t"""
ISSUES = [
    ("duplicate", "removed", "'duplicate brand/SKU/location; kept richer row'"),
    ("dimensions_rejected", "NOT removed AND reason <> ''", "reason"),
    ("product_url_rejected", "NOT removed AND url_reason <> ''", "url_reason"),
    ("pdf_product_url", f"NOT removed AND url_reason = '' AND {f.pdf('raw_url')}", "'raw PDF/spec sheet used as Product URL'"),
    ("charge_row", "charge", "'blank/price-only quote row'"),
    ("missing_identity", "include AND ident <> ''", "ident"),
    ("contamination", "contam <> ''", "contam"),
    ("skipped", "NOT removed AND include AND product_name = ''", "'(no name)'"),
    ("skipped", "NOT removed AND named AND photo_x AND NOT img_ok", "'missing or invalid Image URL'"),
    ("missing_section", "NOT removed AND exported AND category = ''", "'missing section'"),
    ("section_equals_name", f"NOT removed AND exported AND category <> '' AND {f.spaced('category')} = {f.spaced('product_name')}", "category"),
    ("section_too_long", "NOT removed AND exported AND length(category) > 30", "category"),
    ("needs_enrichment", "NOT removed AND needs", f.listing([("NOT xcomplete", "'missing full W x H x D dimensions'"), ("NOT img_ok", "'missing or invalid Image URL'")], "; ")),
]
SQL["export_qa_issues"] = FLAGS + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, row_id, {r} AS reason FROM h WHERE {c}" for k, c, r in ISSUES)
SQL["section_counts"] = f"{FLAGS} SELECT sec AS section, count(*) AS products FROM h WHERE NOT removed AND exportable GROUP BY 1"
SQL["missing_field_histogram"] = f"{FLAGS} SELECT field, count(*) AS rows FROM (SELECT unnest(miss) AS field FROM h WHERE NOT removed AND exported) t GROUP BY 1"
SLUG = "trim(regexp_replace(lower(CASE WHEN sku <> '' AND brand <> '' THEN brand || '_' || sku WHEN sku <> '' THEN sku WHEN brand <> '' THEN brand || '_' || product_name ELSE product_name END), '[^a-z0-9]+', '_', 'g'), '_')"
SQL["image_manifest"] = f"""{DEDUPE}, e AS (SELECT row_id, product_name, brand, model_sku AS sku, product_url, image_url, img_ok FROM p WHERE NOT removed AND exportable),
 s AS (SELECT *, CASE WHEN img_ok THEN {SLUG} END AS slug FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY row_id) AS rn FROM s)
 SELECT row_id, product_name, brand, sku, product_url, image_url, CASE WHEN slug IS NULL THEN '' WHEN rn > 1 THEN concat(slug, '_', rn, '.jpg') ELSE slug || '.jpg' END AS file_name,
 CASE WHEN slug IS NULL THEN 'missing_image_url' ELSE 'to_download' END AS image_status FROM k"""
SQL["restore_order"] = f"{DEDUPE} SELECT row_id, product_name, room FROM p WHERE NOT removed ORDER BY row_id"

COMMON = [("NOT include", "'Not included'"), ("status IN ('Ignored','Excluded','Error')", "'Ignored or excluded'")]
P_ISS = COMMON + [("product_name = ''", "'Missing product name'"), ("category = ''", "'Missing category'"), ("NOT https_img", "'Missing hosted image URL'")]
N_ISS = COMMON + [("review_required", "'Needs review'"), ("product_name = ''", "'Missing product name'"), ("brand = ''", "'Missing brand'"),
                  ("NOT complete", "'Missing full W x H x D dimensions'"), ("quantity < 1", "'Missing quantity'"), ("supplier = ''", "'Missing supplier'"),
                  ("room = ''", "'Missing location'"), ("category = ''", "'Missing category'")]
ISS = f"CASE WHEN photo THEN {f.listing(P_ISS)} ELSE {f.listing(N_ISS)} END"
SQL["split_eligible"] = f"{f.X}, i AS (SELECT row_id, {ISS} AS issues FROM x) SELECT row_id, issues = '' AS eligible, issues FROM i"
SQL["split_eligible_blank_ok"] = f"{f.X} SELECT row_id, CASE WHEN photo THEN {f.listing(P_ISS)} ELSE {f.listing(COMMON)} END AS issues FROM x"
S_COMMON = [("NOT include", "'Include unchecked'"), ("status IN ('Ignored','Excluded','Error')", "'Status: ' || status"), ("product_name = ''", "'No product name'")]
BLOCK = (f"CASE WHEN photo THEN {f.listing(S_COMMON + [('category = ' + repr(''), repr('No category')), ('NOT https_img', repr('No hosted image URL'))], '; ')} ELSE "
         f"{f.listing(S_COMMON + [('quantity < 1', repr('Quantity < 1')), ('category = ' + repr(''), repr('No category')), ('NOT complete', repr('Missing dimensions'))], '; ')} END")
SQL["send_blockers"] = f"{f.X} SELECT row_id, {BLOCK} AS blockers FROM x"
SQL["review_summary"] = f"""{f.X}, m AS (SELECT *, {f.MISSING_REVIEW} <> '' AS gaps FROM x) SELECT count(*) AS total, count(*) FILTER (include AND NOT photo AND NOT gaps) AS ready,
 count(*) FILTER (include AND NOT photo AND gaps) AS needs_review, count(*) FILTER (NOT include) AS ignored, count(*) FILTER (photo) AS photo_only,
 CAST(round_even(avg(confidence_score) FILTER (include AND NOT photo), 0) AS INT) AS avg_confidence, count(*) FILTER (include AND contains(lower(source_type), 'enrich')) AS enriched,
 count(*) FILTER (include AND image_url <> '') AS with_images, count(*) FILTER (include AND dimensions <> '') AS with_dimensions, count(*) FILTER (include AND gaps) AS open_rows FROM m"""
SQL["blocked_reason_counts"] = f"""{f.X}, b AS (SELECT {BLOCK} AS t FROM x WHERE include) SELECT reason, count(*) AS rows FROM (
 SELECT 'Missing dimensions' AS reason FROM b WHERE contains(t, 'Missing dimensions') UNION ALL SELECT 'No category' FROM b WHERE contains(t, 'No category')
 UNION ALL SELECT 'other' FROM b WHERE t <> '' AND NOT contains(t, 'Missing dimensions') AND NOT contains(t, 'No category')) u GROUP BY 1"""
SQL["send_path"] = f"""{f.X}, b AS (SELECT *, {BLOCK} AS t FROM x) SELECT count(*) AS sendable, count(*) FILTER (source_type = 'URL' AND product_url <> '') AS link_rows,
 count(*) FILTER (NOT (source_type = 'URL' AND product_url <> '')) AS schedule_rows FROM b WHERE t = ''"""
SQL["needs_ai_parse"] = f"""{f.with_views('intake_wide')}, c AS (SELECT row_id // 100000190 AS doc_id, min({PARSE}) AS low FROM intake_wide GROUP BY 1)
 SELECT o_orderkey AS doc_id, low IS NULL OR low < 90 AS needs_parse, CASE WHEN low IS NULL THEN 'deterministic parser returned no rows'
 WHEN low < 90 THEN 'deterministic parse missing critical fields' ELSE 'deterministic parse complete' END AS reason FROM orders LEFT JOIN c ON c.doc_id = o_orderkey"""
SQL["section_exists"] = f"""{f.with_views('intake_wide')} SELECT {f.spaced('category')} AS key, min(category) AS section FROM intake_wide
 WHERE {f.spaced('category')} NOT IN ('', 'appliance', 'chair', 'other', 'rugs', 'stone tile') GROUP BY 1"""
SQL["run_log_stats"] = "SELECT user_id % 3 AS path_no, event_type AS status, count(*) AS entries, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1, 2"
SQL["failure_reasons"] = "SELECT concat(event_type, ': code ', user_id % 7) AS reason, count(*) AS times FROM events GROUP BY 1"
