"""Statements for the single-row queries."""

from oracle.frag import *  # noqa: F403
from oracle import frag as f

W = f.with_views
I = W("intake")
WIDE = W("intake_wide")
SQL: dict[str, str] = {}

SQL["src_url_list"] = f"""{WIDE} SELECT row_id, product_url, 'Demo' AS project, 'Bar' AS room, 'URL' AS source_type,
 'Needs Review' AS status, CAST(1 AS INT) AS quantity, true AS include FROM intake_wide WHERE product_url <> ''"""

SQL["src_doc_placeholder"] = """SELECT doc_id AS row_id, concat(replace(replace(source,'_',' '),'-',' '), ' quote ', doc_id) AS product_name,
 concat('Source: ', source, '_quote-', doc_id, '.pdf', CASE WHEN lang = 'en' THEN ' | English' ELSE '' END) AS notes,
 'PDF' AS source_type, 'Pending Extraction' AS status FROM documents"""

SQL["src_photo_manifest"] = """SELECT page_id AS row_id, 'Photo' AS source_type, 'Photo Upload' AS import_type, true AS photo_only,
 'Needs Review' AS status, CAST(NULL AS INT) AS quantity, concat('IMG_', page_id, '-front.jpg') AS image_filename,
 concat('/photos/', page_id) AS local_image_path, CASE WHEN page_id % 3 = 0 THEN 'Failed' ELSE 'Ready' END AS image_upload_status FROM pages"""

SQL["src_manual"] = f"""{WIDE} SELECT row_id, product_name, model_sku,
 CAST(CASE WHEN row_id % 3 > 0 THEN greatest(1, quantity - 25) ELSE 1 END AS INT) AS quantity, 'Manual' AS source_type,
 CASE WHEN model_sku <> '' AND (product_name = '' OR brand = '' OR dimensions = '' OR supplier = '' OR room = '' OR category = '')
   THEN 'Needs Enrichment' ELSE 'Needs Review' END AS status FROM intake_wide"""

SQL["src_json_rows"] = f"""{WIDE} SELECT row_id AS batch_id, CAST(0 AS INT) AS position, product_name, CAST(quantity AS INT) AS quantity, include FROM intake_wide"""

SQL["conform_schema"] = f"""{WIDE} SELECT row_id, CASE WHEN row_id % 5 > 0 THEN include ELSE true END AS include,
 CASE WHEN row_id % 2 = 0 THEN brand ELSE '' END AS brand, CAST(CASE WHEN row_id % 3 > 0 THEN quantity ELSE 1 END AS INT) AS quantity,
 'Unknown' AS category_source, false AS photo_only, CAST(0 AS INT) AS ai_category_confidence, '' AS notes FROM intake_wide"""

SQL["union_sources"] = f"""{WIDE} SELECT source_type, status, photo_only, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM (
 SELECT source_type, status, photo_only, quantity FROM intake_wide WHERE source_type = 'Manual'
 UNION ALL SELECT 'PDF', 'Pending Extraction', false, 1 FROM documents
 UNION ALL SELECT 'Photo', 'Needs Review', true, 1 FROM pages) u GROUP BY ALL"""

SQL["sequence_names"] = """SELECT row_id, position, 'Lamp ' || no AS default_name, 'Photo Item ' || no AS generated_name, stem_name FROM (
 SELECT page_id AS row_id, CAST(rn AS INT) AS position, CASE WHEN rn > 999 THEN CAST(rn AS VARCHAR) ELSE lpad(CAST(rn AS VARCHAR), 3, '0') END AS no,
  concat('IMG_', page_id, '-front') AS stem_name FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS rn FROM pages) a) b"""

SQL["stored_photo_join"] = """SELECT page_id AS row_id, concat('IMG_', page_id, '-front.jpg') AS image_filename,
 CASE WHEN page_id % 4 > 0 THEN concat('https://cdn.example.com/', page_id) ELSE '' END AS image_url,
 CASE WHEN page_id % 5 = 0 THEN 'Retry' WHEN page_id % 4 > 0 THEN 'Uploaded' ELSE 'Missing Image' END AS image_upload_status,
 'Photo-only Bulk Import' AS import_type, CAST(1 AS INT) AS quantity FROM pages"""

SQL["sink_internal_csv"] = f"""{WIDE} SELECT row_id, product_name,
 CASE WHEN row_id % 7 = 1 THEN 'Confirm finish with client' ELSE notes END AS notes FROM intake_wide"""

SQL["run_log_sink"] = """SELECT CASE WHEN user_id % 4 = 0 THEN 'intake' ELSE concat('House_', user_id) END AS project, event_type AS status,
 count(*) AS entries, max(CAST(ts AS TIMESTAMP)) AS last_entry FROM events GROUP BY 1, 2"""

SQL["is_ignored"] = f"{f.X} SELECT row_id, ignored FROM x"
SQL["is_photo_only"] = f"{f.X} SELECT row_id, photo AS photo_review, photo_x AS photo_export FROM x"
SQL["is_included"] = f"""{WIDE} SELECT row_id, CASE WHEN row_id % 4 IN (0, 1) THEN false ELSE include END AS loose,
 CASE WHEN row_id % 5 > 0 THEN include ELSE false END AS strict FROM intake_wide"""
SQL["has_complete_3d"] = f"{f.X} SELECT row_id, complete FROM x"
SQL["dims_extract"] = f"{f.X} SELECT row_id, w_ AS width, h_ AS height, d_ AS depth, l_ AS length FROM x"
SQL["dimension_sanity"] = f"{f.X} SELECT row_id, reason FROM x"
SQL["url_validate"] = f"""{I} SELECT row_id, url, CASE WHEN url = '' THEN 'empty URL' WHEN regexp_matches(url, '\\s') THEN 'malformed URL: contains whitespace'
 WHEN contains({f.netloc('url')}, '[') THEN 'Invalid IPv6 URL: Invalid IPv6 URL'
 WHEN NOT regexp_matches(url, '^https?:') THEN 'malformed URL: unsupported scheme ' || regexp_extract(url, '^([a-z]+):', 1)
 WHEN {f.host('url')} = 'localhost' OR regexp_matches({f.host('url')}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN ''
 WHEN NOT contains({f.host('url')}, '.') THEN 'malformed domain: ' || {f.host('url')} ELSE '' END AS problem FROM (
 SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'https://[bad' WHEN 1 THEN 'ftp://files.example.com/x' WHEN 2 THEN concat('http://localhost:80/', row_id)
  WHEN 3 THEN concat('https://host', row_id) WHEN 4 THEN 'https://10.0.0.1/x y' ELSE product_url END AS url FROM intake) t"""
SQL["image_url_ok"] = f"""{I} SELECT row_id, {f.image_ok('u')} AS image_ok, {f.https('u')} AS https_only FROM (SELECT row_id,
 CASE WHEN row_id % 5 = 0 THEN concat('https://cdn.example.com/render/', row_id, '?w=9') ELSE image_url END AS u FROM intake) t"""
SQL["is_exportable"] = f"{f.X} SELECT row_id, exportable FROM x"

PHONE = "(\\+?1[\\s.-]?)?(\\(?\\d{3}\\)?[\\s.-]?)\\d{3}[\\s.-]?\\d{4}\\b"
MAIL = "\\b[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{2,}\\b"


def contamination(model: str) -> str:
    text = f"concat_ws(' ', product_name, {model}, brand, notes)"
    return (
        f"CASE WHEN regexp_matches({model}, '{PHONE}') OR regexp_matches({model}, '{MAIL}') THEN 'phone/email captured as model' "
        f"WHEN regexp_matches({text}, '{MAIL}') THEN 'email/header text detected' "
        f"WHEN regexp_matches({text}, '{PHONE}') AND NOT ({f.token('brand')} <> '' AND {f.token(model)} <> '') THEN 'phone/header text detected' ELSE '' END"
    )


def identity(model: str) -> str:
    return (
        f"CASE WHEN {f.CHARGE} OR (brand <> '' AND {model} <> '') THEN '' ELSE 'missing ' || "
        + f.listing([("brand = ''", "'manufacturer'"), (f"{model} = ''", "'model'")], " and ")
        + " END"
    )


SQL["identity_issues"] = f"""{WIDE}, m AS (SELECT *, CASE WHEN row_id % 47 = 0 THEN '416-555-0100' ELSE model_sku END AS mm FROM intake_wide)
 SELECT row_id, {identity('mm')} AS identity, {contamination('mm')} AS contamination FROM m"""

MARKERS = ["salesperson", "sales person", "contact", "phone", "email", "@", "transcript", "vendor call", "source", "scraped",
           "extraction", "confidence", "verify", "uncertain", "line 1", "line 2", "http://", "https://"]


def note_like(c: str) -> str:
    hits = " OR ".join(f"contains(lower({c}), '{m}')" for m in MARKERS)
    return f"({c} <> '' AND ({hits} OR len(string_split({c}, chr(10))) > 2 OR length({c}) > 350))"


SQL["note_like_text"] = f"{WIDE} SELECT row_id, {note_like('notes')} AS note_like FROM intake_wide"
SQL["valid_phone"] = f"""{I} SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'Phone number is required.' WHEN 1 THEN 'Emergency numbers cannot be called.'
 WHEN 2 THEN '' ELSE 'Enter a phone number in E.164 format, for example +12223334444.' END AS problem FROM intake"""

SQL["fraction_to_number"] = f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' 7/8') WHEN 1 THEN concat(p_size, '/3')
 WHEN 2 THEN concat(p_size, '.25') ELSE 'n/a' END AS t FROM part), n AS (SELECT *, {f.number('t')} AS v FROM t)
 SELECT p_partkey, round(v, 9) AS number,
 CASE WHEN contains(t, '/') AND v IS NOT NULL THEN rtrim(rtrim(printf('%.6f', v), '0'), '.') ELSE t END AS text6,
 CASE WHEN contains(t, '/') AND v IS NOT NULL THEN rtrim(rtrim(printf('%.4f', v), '0'), '.') ELSE t END AS text4 FROM n"""
SQL["to_inches"] = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'cm' WHEN 1 THEN 'mm' WHEN 3 THEN '' ELSE 'in' END AS unit,
 CASE p_partkey % 5 WHEN 0 THEN rtrim(rtrim(printf('%.3f', CAST(p_size AS DOUBLE) / CAST(2.54 AS DOUBLE)), '0'), '.') WHEN 1 THEN rtrim(rtrim(printf('%.3f', CAST(p_size AS DOUBLE) / CAST(25.4 AS DOUBLE)), '0'), '.')
 ELSE CAST(p_size AS VARCHAR) END AS inches FROM part"""
SQL["export_dims_text"] = f"""{f.X} SELECT row_id, CASE WHEN reason <> '' THEN '' WHEN complete THEN concat(w_, '"W x ', h_, '"H x ', d_, '"D') ELSE dimensions END AS export_dims FROM x"""
SQL["norm_token"] = f"{I} SELECT row_id, {f.token('model_sku')} AS token, {f.spaced('room')} AS spaced, {f.spaced('product_name')} AS name_key FROM intake"
SQL["product_key"] = f"""{I} SELECT row_id, CASE WHEN {f.token('brand')} = '' AND {f.token('model_sku')} = '' THEN NULL ELSE {f.token('brand')} || '_' || {f.token('model_sku')} END AS product_key FROM intake"""
SQL["normalize_category"] = f"{I} SELECT row_id, {f.category('category')} AS category FROM intake"
SQL["normalize_section"] = f"""{I} SELECT row_id, {f.section('label')} AS section FROM (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN category || ' set' ELSE category END AS label FROM intake) t"""
LOC = "(?i)\\s*[-–]\\s*if we can fit it.*|\\s*[-–]\\s*tbd\\b.*"
SQL["normalize_location"] = f"""{I}, t AS (SELECT row_id, room, CASE WHEN row_id % 2 = 0 THEN 'Foyer' ELSE '' END AS fallback, regexp_replace(room, '{LOC}', '') AS kept FROM intake)
 SELECT row_id, CASE WHEN room = '' THEN fallback ELSE {f.title('kept')} END AS location,
 CAST(CASE WHEN room = '' AND fallback <> '' THEN 40 WHEN room = '' THEN 0 WHEN kept <> room THEN 65 ELSE 90 END AS INT) AS score,
 CASE WHEN room = '' AND fallback <> '' THEN 'used default location — verify' WHEN room = '' THEN 'no location found'
  WHEN kept <> room THEN 'location inferred from uncertain note — verify' ELSE 'location extracted from annotation' END AS reason FROM t"""
SQL["domain_clean"] = f"""{I} SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'maker.example.com' WHEN 1 THEN nullif({f.no_www(f.host('product_url'))}, '') END AS strict_domain,
 CASE row_id % 3 WHEN 0 THEN 'maker.example.com' WHEN 1 THEN {f.no_www(f.host('product_url'))} ELSE '' END AS memory_domain,
 {f.no_www(f.netloc('product_url'))} AS site FROM intake"""
SQL["url_join"] = f"""{I} SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'https://cdn.example.com/a.jpg' WHEN 1 THEN 'https://www.maker.example.com/img/b.png'
 WHEN 2 THEN 'https://www.maker.example.com/p/c.webp' WHEN 3 THEN 'https://x.example.org/d' ELSE '' END AS resolved FROM intake"""

SQL["confidence_score"] = f"{f.X} SELECT row_id, CAST({f.SCORE} AS INT) AS score FROM x"
SQL["missing_fields"] = f"{f.X} SELECT row_id, {f.MISSING} AS missing, {f.MISSING_REVIEW} AS review_missing FROM x"

SENTENCE = """CASE WHEN len(ml) = 1 THEN 'Missing ' || ml[1] WHEN len(ml) = 2 THEN 'Missing ' || ml[1] || ' and ' || ml[2]
 ELSE 'Missing ' || array_to_string(ml[1:len(ml)-1], ', ') || ', and ' || ml[len(ml)] END"""
GAP = f"(source_type = 'Manual' AND model_sku <> '' AND {f.ANY_IMPORTANT})"
CHECKS = f"""{f.X}, s AS (SELECT *, CAST({f.SCORE} AS INT) AS score, {f.MISSING} AS mt, {GAP} AS gap, {f.ANY_IMPORTANT} AS anyimp FROM x),
 s2 AS (SELECT *, CASE WHEN mt = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(mt, ', ') END AS ml FROM s),
 s3 AS (SELECT *, CASE WHEN len(ml) = 0 THEN CASE WHEN source_type = 'URL' THEN 'Ready for Import URL import' ELSE 'Ready for review' END ELSE {SENTENCE} END AS base FROM s2)"""
HINT = "'Enter full W × H × D dimensions before Import upload'"
SQL["review_status_action"] = f"""{CHECKS} SELECT row_id, CASE WHEN ignored THEN false ELSE include END AS include,
 CASE WHEN ignored THEN 'Ignored' WHEN gap THEN 'Needs Enrichment' ELSE status END AS status, score AS confidence_score,
 CASE WHEN photo THEN len(ml) > 0 WHEN ignored THEN false ELSE gap OR score < 75 END AS review_required, mt AS missing_fields,
 CASE WHEN photo THEN CASE WHEN len(ml) > 0 THEN 'Photo-only item missing ' || mt ELSE 'Review AI-generated photo details before Import export' END
  WHEN ignored THEN CASE WHEN product_name <> '' THEN 'Possible subtotal/tax row "' || CASE WHEN length(product_name) > 40 THEN left(product_name, 40) || '…' ELSE product_name END || '" — excluded' ELSE 'Blank or non-product row — excluded' END
  WHEN source_type = 'URL' AND NOT {f.VALID_LINK} THEN 'Invalid or missing URL — please check the link'
  WHEN gap THEN CASE WHEN category = '' THEN 'Use serial/model number to fill missing fields. AI category suggestion needed' ELSE 'Use serial/model number to fill missing fields' END
  WHEN source_type = 'Manual' AND category = '' AND NOT anyimp THEN 'AI category suggestion needed'
  WHEN base = 'Missing Dimensions' THEN {HINT} WHEN list_contains(ml, 'Dimensions') THEN base || '; ' || {HINT} ELSE base END AS suggested_action FROM s3"""
CRIT = [("product_name = ''", "'Product Name'", 20), ("brand = ''", "'Brand'", 15), ("model_sku = ''", "'Model/SKU'", 20), ("dimensions = ''", "'Dimensions'", 10),
        ("supplier = ''", "'Supplier'", 10), ("category = ''", "'Product Category'", 10), ("quantity < 1", "'Quantity'", 10)]
PARSE = f.minus(100, [(c, p) for c, _, p in CRIT])
SQL["parse_confidence"] = f"{WIDE} SELECT row_id, CAST({PARSE} AS INT) AS parse_confidence, {f.listing([(c, l) for c, l, _ in CRIT])} AS missing FROM intake_wide"
NOTES = """CASE row_id % 7 WHEN 0 THEN 'Ships later' WHEN 1 THEN 'Confirm finish with client' WHEN 2 THEN 'Contact sales@dealer.example.com'
 WHEN 3 THEN 'Call 416-555-0199 for lead time' WHEN 4 THEN 'Keep in storage until spring' ELSE '' END"""
SQL["notes_clean"] = f"{WIDE} SELECT row_id, {NOTES} AS notes, CASE WHEN row_id % 7 = 0 THEN 'brass, glass' ELSE '' END AS material FROM intake_wide"
SQL["finish_color_split"] = f"{WIDE} SELECT row_id, finish_color AS finish, CASE WHEN finish_color IN ('Matte Black', 'Brass') THEN finish_color ELSE '' END AS color FROM intake_wide"
SQL["split_notes_description"] = f"""{WIDE}, t AS (SELECT row_id, notes, CASE WHEN row_id % 2 = 0 THEN notes ELSE trim(product_name || ' panel') END AS de,
 CASE WHEN row_id % 3 = 0 THEN lower(notes) ELSE finish_color END AS dt FROM intake_wide),
 u AS (SELECT *, {note_like('de')} AS a, {note_like('dt')} AS b FROM t)
 SELECT row_id, CASE WHEN a THEN '' ELSE de END AS clean_description, CASE WHEN b THEN '' ELSE dt END AS clean_details,
 array_to_string(list_filter([nullif(notes, ''), CASE WHEN a AND lower(de) <> lower(notes) THEN de END, CASE WHEN b AND lower(dt) <> lower(notes) AND NOT (a AND lower(dt) = lower(de)) THEN dt END], lambda v: v IS NOT NULL), chr(10) || chr(10)) AS combined_notes FROM u"""
SQL["api_fields"] = f"""{WIDE} SELECT row_id, product_name AS name, brand AS brand_name, model_sku AS sku, CASE WHEN color <> '' THEN color ELSE finish_color END AS colour,
 finish_color AS finish, material AS material_name, CAST(quantity AS VARCHAR) AS quantity_text, product_url AS link, price AS price_text, supplier AS supplier_name FROM intake_wide"""
SQL["file_stem_title"] = f"""SELECT doc_id, {f.title("replace(replace(stem, '_', ' '), '-', ' ')")} AS title, stem FROM (SELECT doc_id, concat(source, '_item-', lang, '_o''neil_2nd') AS stem FROM documents) t"""
SQL["first_url"] = f"""{WIDE} SELECT row_id, CASE WHEN product_url <> '' THEN product_url ELSE image_url END AS url, '' AS note_url FROM intake_wide"""
SQL["first_row_per_line"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn FROM lineitem) t WHERE rn = 1"""
