"""Statements for the lookup and ranking queries."""

from oracle import frag as f
from oracle.export import weak_page

V = f.with_views
SQL: dict[str, str] = {}

BD = f"""bd AS (SELECT brand, domain AS d, source AS s FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY priority, domain) AS rn FROM brand_domains WHERE domain <> 'bad domain') t WHERE rn = 1)"""
SQL["join_brand_domain"] = f"""{V('intake', 'brand_domains')}, {BD} SELECT row_id, intake.brand, d AS domain, s AS domain_source FROM intake LEFT JOIN bd ON bd.brand = intake.brand"""
SQL["domain_cache_update"] = f"""{V('brand_domains')} SELECT brand, domain, source FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY priority, domain) AS rn FROM brand_domains) t WHERE rn = 1"""
GOOD_IMG = "CASE WHEN contains(image_url, '[') THEN '' ELSE image_url END"
MEM = f"""mem AS (SELECT normalized_brand AS nb, normalized_model_sku AS nm, source_type AS st, confidence_score AS cs, success_count AS sc, {GOOD_IMG} AS img, product_page_url AS pp, dimensions_text AS dt FROM source_memory WHERE confidence_score >= 60)"""
J = f"mem ON mem.nb = {f.token('brand')} AND mem.nm = {f.token('model_sku')} AND mem.nb <> '' AND mem.nm <> ''"
SQL["join_product_memory"] = f"""{V('intake', 'source_memory')}, {MEM} SELECT row_id, st AS memory_source_type, cs AS memory_confidence_score, img AS memory_image_url FROM intake LEFT JOIN {J}"""
SQL["join_product_memory_legacy"] = f"""{V('intake', 'source_memory')}, {MEM} SELECT row_id, st AS memory_source_type, cs AS memory_confidence_score FROM intake LEFT JOIN {J}"""
_FILLS = [("width_in", "Width (in)", "m.width_in"), ("height_in", "Height (in)", "m.height_in"), ("depth_in", "Depth (in)", "m.depth_in"), ("image_url", "Image URL", GOOD_IMG.replace("image_url", "m.image_url")),
 ("product_url", "Product URL", "m.product_page_url"), ("manufacturer_url", "Manufacturer URL", "m.manufacturer_url"),
 ("dimension_source_url", "Dimension Source URL", "coalesce(nullif(m.dimension_source_url, ''), m.spec_sheet_url)"), ("image_source_url", "image_source_url", "m.image_source_url"),
 ("selected_product_url", "selected_product_url", "m.product_page_url"), ("manufacturer_domain_used", "manufacturer_domain_used", "m.source_domain"),
 ("dimension_confidence", "Dimension Confidence", "coalesce(nullif(m.dimension_confidence, ''), m.confidence)"), ("image_confidence", "image_confidence", "coalesce(nullif(m.image_confidence, ''), m.confidence)"),
 ("dimension_source_type", "Dimension Source Type", "m.source_type")]
_ROW = lambda c: "''" if c in ("width_in", "height_in", "depth_in", "manufacturer_url") else f"i.{c}"
SQL["fill_from_memory"] = f"""{V('intake_wide', 'source_memory_wide')}, j AS (SELECT i.row_id, m.memory_id IS NOT NULL AS hit, i.dimensions AS d, {f.complete('i.dimensions')} AS cpl, i.cache_hit AS ch, coalesce(m.dimensions_text, '') AS dt,
 coalesce(nullif(m.product_page_url, ''), nullif(m.manufacturer_url, ''), nullif(m.dimension_source_url, ''), nullif(m.spec_sheet_url, ''), m.image_source_url, '') AS used,
 {', '.join(f"{_ROW(c)} AS o_{c}, coalesce({v}, '') AS v_{c}" for c, _, v in _FILLS)}
 FROM intake_wide i LEFT JOIN source_memory_wide m ON m.confidence_score >= 60 AND m.normalized_brand = {f.token('i.brand')} AND m.normalized_model_sku = {f.token('i.model_sku')} AND m.normalized_brand <> '' AND m.normalized_model_sku <> '')
 SELECT row_id, CASE WHEN hit AND dt <> '' AND NOT cpl THEN dt ELSE d END AS dimensions, {', '.join(f"CASE WHEN hit AND o_{c} = '' AND v_{c} <> '' THEN v_{c} ELSE o_{c} END AS {c}" for c, _, _ in _FILLS)},
 {f.listing([("hit AND dt <> '' AND NOT cpl", "'Dimensions'")] + [(f"hit AND o_{c} = '' AND v_{c} <> ''", f"'{label}'") for c, label, _ in _FILLS])} AS memory_filled, hit AS memory_hit,
 CASE WHEN hit THEN used ELSE '' END AS stored_source_used, CASE WHEN hit THEN 'stored_source' ELSE ch END AS cache_hit FROM j"""
GC, DC = "c.general_confidence IN ('high','medium')", "c.dimension_confidence IN ('high','medium')"
SQL["join_product_cache"] = f"""{V('intake_wide', 'product_cache')}, k AS (SELECT *, {f.token('brand')} || '_' || {f.token('model_sku')} AS pk FROM intake_wide),
 j AS (SELECT k.*, coalesce({GC} AND c.product_url IS NOT NULL AND k.product_url = '' AND {weak_page('c.product_url').replace('c.c.', 'c.')} = '', false) AS u1,
  coalesce({GC} AND k.product_name = '' AND c.product_name IS NOT NULL, false) AS u2, coalesce({GC} AND k.finish_color = '' AND c.finish IS NOT NULL, false) AS u4,
  coalesce({GC} AND k.material = '' AND c.material IS NOT NULL, false) AS u5, coalesce({GC} AND k.category = '' AND c.product_category IS NOT NULL, false) AS u6,
  coalesce({GC} AND k.image_url = '' AND c.image_url IS NOT NULL, false) AS u7, coalesce({DC} AND k.dimensions = '' AND c.dimensions IS NOT NULL, false) AS u8,
  c.product_url AS cu, c.product_name AS cn, c.finish AS cf, c.image_url AS ci, c.dimensions AS cd FROM k LEFT JOIN product_cache c ON c.product_key = pk AND pk <> '_'),
 o AS (SELECT row_id, CASE WHEN u2 THEN cn ELSE product_name END AS product_name, brand, CASE WHEN u8 THEN cd ELSE dimensions END AS dimensions, CASE WHEN u1 THEN cu ELSE product_url END AS product_url,
  CASE WHEN u7 THEN ci ELSE image_url END AS image_url, CASE WHEN u4 THEN cf ELSE finish_color END AS finish_color,
  {f.listing([('u1', "'product_url'"), ('u2', "'product_name'"), ('u4', "'finish'"), ('u5', "'material'"), ('u6', "'product_category'"), ('u7', "'image_url'"), ('u8', "'dimensions'")])} AS cache_filled FROM j)
 SELECT *, {f.listing([('NOT ' + f.complete('dimensions'), "'dimensions'"), ("product_url = ''", "'product_url'")])} AS cache_missing FROM o"""
SQL["cache_sanitize_on_read"] = f"""{V('product_cache')} SELECT product_key, CASE WHEN contains(product_url, '[') THEN NULL ELSE product_url END AS product_url,
 CASE WHEN starts_with(image_url, 'ftp') THEN NULL ELSE image_url END AS image_url,
 {f.listing([("starts_with(image_url, 'ftp')", "'image_url'"), ("contains(product_url, '[')", "'product_url'")], ',')} AS rejected FROM product_cache"""
SQL["memory_sanitize_on_read"] = f"""{V('source_memory')} SELECT normalized_model_sku, product_page_url, {GOOD_IMG} AS image_url,
 CASE WHEN contains(image_url, '[') THEN 'invalid URL removed: image_url=' || image_url ELSE '' END AS rejected_reason FROM source_memory"""
_SURE = "CASE {0} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"
SQL["cache_update"] = f"""{V('product_cache', 'cache_delta_wide')}, j AS (SELECT coalesce(c.product_key, d.product_key) AS product_key, c.product_url AS cu, c.finish AS cf, c.dimensions AS cd, c.dimension_confidence AS cc, c.product_name, c.material,
 c.product_category, c.image_url, c.general_confidence, d.product_key IS NOT NULL AS hit, d.product_url AS du, d.finish AS df, nullif(d.product_url_reason, '') AS why, d.dimensions AS dd, d.dimension_confidence AS dc, d.remark,
 d.product_key IS NOT NULL AND {_SURE.format('d.dimension_confidence')} >= {_SURE.format('c.dimension_confidence')} AS sure FROM product_cache c FULL JOIN cache_delta_wide d ON c.product_key = d.product_key)
 SELECT product_key, CASE WHEN hit AND (du IS NULL OR contains(du, '[')) THEN NULL WHEN hit AND du <> '' THEN du ELSE cu END AS product_url, product_name,
 CASE WHEN hit AND df IS NULL THEN NULL WHEN hit AND df <> '' THEN df ELSE cf END AS finish, material, product_category, image_url, CASE WHEN sure AND dd IS NULL THEN NULL WHEN sure AND dd <> '' THEN dd ELSE cd END AS dimensions,
 CASE WHEN sure THEN dc ELSE cc END AS dimension_confidence, general_confidence, remark,
 concat_ws('; ', CASE WHEN sure AND dd IS NULL THEN 'dimensions=not found' END, CASE WHEN hit AND df IS NULL THEN 'finish=not found' END,
  CASE WHEN hit AND du IS NULL THEN 'product_url=' || coalesce(why, 'not found') WHEN hit AND contains(du, '[') THEN 'product_url=' || coalesce(why, 'invalid URL rejected from cache') END) AS misses FROM j"""
SQL["kb_read"] = f"""{V('source_memory')} SELECT normalized_brand, normalized_model_sku, source_type, confidence_score, success_count FROM source_memory
 WHERE source_type = 'manufacturer' AND contains(lower(concat_ws(' ', normalized_brand, normalized_model_sku, product_page_url)), 'p/1')
 ORDER BY success_count DESC, confidence_score DESC, normalized_brand, normalized_model_sku LIMIT 100"""
SQL["topk_sources"] = f"""{V('source_memory')} SELECT normalized_brand, normalized_model_sku, success_count, confidence_score FROM source_memory
 ORDER BY success_count DESC, confidence_score DESC, normalized_brand, normalized_model_sku LIMIT 9999"""
SQL["domains_read"] = f"""{V('preferred_domains')} SELECT domain, domain_id, success_count, failure_count, downranked FROM preferred_domains WHERE contains(lower(concat_ws(' ', domain, source_type, notes)), 'example')
 ORDER BY downranked, success_count DESC, failure_count, domain DESC, domain_id DESC LIMIT 50"""
SQL["kb_audit"] = f"""{V('source_memory', 'preferred_domains')} SELECT 'stored_sources' AS table_name, count(*) AS rows FROM source_memory UNION ALL SELECT 'preferred_domains', count(*) FROM preferred_domains"""
SQL["usable_source"] = f"""{V('source_memory')} SELECT normalized_model_sku, confidence_score >= 60 AS usable FROM source_memory"""
SQL["confidence_ok"] = f"""{V('product_cache')} SELECT product_key, dimension_confidence IN ('high','medium') AS dimension_ok, general_confidence IN ('high','medium') AS general_ok FROM product_cache"""
SQL["memory_best_per_key"] = f"""{V('source_memory')} SELECT normalized_brand, confidence_score, success_count, product_page_url FROM (SELECT *, row_number() OVER (PARTITION BY normalized_brand
 ORDER BY confidence_score DESC, success_count DESC, product_page_url) AS rn FROM source_memory) t WHERE rn = 1"""
SQL["preferred_domain_hint"] = f"""{V('hint_requests', 'source_memory', 'preferred_domains')}, b AS (SELECT DISTINCT {f.token('brand')} AS brand_key, {f.token('category')} AS category_key FROM hint_requests),
 own AS (SELECT DISTINCT normalized_brand AS brand_key FROM source_memory),
 rel AS (SELECT brand_key, category_key, domain FROM (SELECT brand_key, category_key, domain, row_number() OVER (PARTITION BY brand_key, category_key ORDER BY success_count - failure_count DESC, success_count DESC, failure_count, domain DESC) AS rn
  FROM b JOIN preferred_domains p ON NOT downranked AND (contains({f.token('domain')}, brand_key) OR contains({f.token('notes')}, brand_key) OR (category_key <> '' AND contains({f.token('notes')}, category_key)))) t WHERE rn = 1)
 SELECT brand_key, category_key, CASE WHEN own.brand_key IS NOT NULL THEN 'maker.example.com' ELSE coalesce(rel.domain, '') END AS hint FROM b LEFT JOIN own USING (brand_key) LEFT JOIN rel USING (brand_key, category_key)"""
RANK = "CASE {0} WHEN 'manufacturer' THEN 4 WHEN 'spec_sheet' THEN 3 WHEN 'manual' THEN 2 WHEN 'retailer' THEN 1 ELSE 0 END"
SQL["memory_upsert"] = f"""{V('source_memory', 'memory_delta')}, j AS (SELECT coalesce(a.normalized_brand, b.normalized_brand) AS normalized_brand, coalesce(a.normalized_model_sku, b.normalized_model_sku) AS normalized_model_sku,
 a.source_type AS ast, b.source_type AS bst, a.confidence_score AS acs, b.confidence_score AS bcs, coalesce(a.success_count, 0) + coalesce(b.success_count, 0) AS success_count,
 coalesce(a.failure_count, 0) + coalesce(b.failure_count, 0) AS failure_count, a.product_page_url AS apu, b.product_page_url AS bpu, a.dimensions_text AS adt, b.dimensions_text AS bdt, a.image_url AS aiu, b.image_url AS biu,
 a.normalized_brand IS NOT NULL AS ha, b.normalized_brand IS NOT NULL AS hb FROM source_memory a FULL JOIN memory_delta b ON a.normalized_brand = b.normalized_brand AND a.normalized_model_sku = b.normalized_model_sku),
 k AS (SELECT *, CASE WHEN NOT ha THEN 'new' WHEN NOT hb THEN 'old' WHEN {RANK.format('bst')} > {RANK.format('ast')} OR ({RANK.format('bst')} = {RANK.format('ast')} AND bcs >= acs) THEN 'new'
   WHEN {RANK.format('ast')} > {RANK.format('bst')} AND acs >= bcs THEN 'keep' ELSE 'old' END AS w FROM j)
 SELECT normalized_brand, normalized_model_sku, CASE WHEN w = 'new' THEN bst ELSE ast END AS source_type, CASE WHEN w = 'new' THEN bcs ELSE acs END AS confidence_score, success_count, failure_count,
 CASE w WHEN 'new' THEN bpu WHEN 'keep' THEN coalesce(nullif(apu, ''), bpu) ELSE apu END AS product_page_url, CASE w WHEN 'new' THEN bdt WHEN 'keep' THEN coalesce(nullif(adt, ''), bdt) ELSE adt END AS dimensions_text,
 CASE w WHEN 'new' THEN biu WHEN 'keep' THEN coalesce(nullif(aiu, ''), biu) ELSE aiu END AS image_url FROM k"""
SQL["domain_upsert"] = f"""{V('preferred_domains', 'domain_events')}, e AS (SELECT {f.no_www("lower(CASE WHEN contains(domain, '://') THEN regexp_extract(domain, '://([^/]*)', 1) ELSE domain END)")} AS domain, success_count AS s, failure_count AS f, happened_at FROM domain_events WHERE domain <> 'not a host'),
 d AS (SELECT domain, sum(s) AS s, sum(f) AS f, max(happened_at) FILTER (s > 0) AS ls, max(happened_at) FILTER (f > 0) AS lf, max(CASE WHEN s > 0 THEN 'retailer' END) AS ty, max(CASE WHEN s = 0 THEN 'timeout' END) AS nt FROM e GROUP BY 1),
 b AS (SELECT domain, sum(success_count) AS s, sum(failure_count) AS f, bool_or(downranked) AS dr, max({{'n': success_count, 'i': domain_id, 't': source_type, 'o': notes}}) AS lead FROM preferred_domains GROUP BY 1)
 SELECT coalesce(b.domain, d.domain) AS domain, CAST(coalesce(b.s, 0) + coalesce(d.s, 0) AS BIGINT) AS success_count, CAST(coalesce(b.f, 0) + coalesce(d.f, 0) AS BIGINT) AS failure_count,
 coalesce(dr, false) AS downranked, ls AS last_success_at, lf AS last_failure_at, lead.i AS domain_id, coalesce(ty, lead.t, 'manufacturer') AS source_type, coalesce(nt, lead.o) AS notes FROM b FULL JOIN d ON b.domain = d.domain"""
SQL["memory_counters"] = f"""{V('source_memory', 'memory_delta')} SELECT normalized_brand, normalized_model_sku, CAST(sum(success_count) AS BIGINT) AS success_count, CAST(sum(failure_count) AS BIGINT) AS failure_count FROM (
 SELECT normalized_brand, normalized_model_sku, success_count, failure_count FROM source_memory UNION ALL SELECT normalized_brand, normalized_model_sku, success_count, failure_count FROM memory_delta) u GROUP BY 1, 2"""
SQL["memory_edit"] = f"""{V('source_memory_wide')}, e AS (SELECT *, success_count = 1 AS up FROM source_memory_wide WHERE success_count <> 2)
 SELECT memory_id, CASE WHEN up THEN 'newbrand' ELSE normalized_brand END AS normalized_brand, normalized_model_sku, CASE WHEN up THEN 'New Brand!' ELSE brand END AS brand, CASE WHEN up THEN 'New Brand!' ELSE display_brand END AS display_brand,
 CASE WHEN up THEN '1"W x 2"H x 3"D' ELSE dimensions_text END AS dimensions_text, CASE WHEN up AND failure_count = 0 THEN 'https://new.example.com/p' ELSE product_page_url END AS product_page_url,
 CASE WHEN success_count = 3 THEN 'Marked for manual re-verify.' ELSE notes END AS notes, source_type, confidence_score, success_count, source_domain FROM e"""
SQL["domain_edit"] = f"""{V('preferred_domains')}, e AS (SELECT *, domain_id % 5 = 1 AS up FROM preferred_domains WHERE domain_id % 5 <> 2)
 SELECT CASE WHEN up AND domain_id % 2 = 0 THEN 'new' || domain_id || '.example.com' ELSE domain END AS domain, domain_id, source_type, success_count, failure_count, up OR downranked AS downranked, CASE WHEN up THEN 'Checked.' ELSE notes END AS notes FROM e"""
LAB = "lower(concat_ws(' ', dimension_confidence, selected_product_url_confidence, image_confidence))"
SC = f"CASE WHEN contains({LAB}, 'high') THEN 90 WHEN contains({LAB}, 'medium') THEN 70 WHEN contains({LAB}, 'low') THEN 35 WHEN trim({LAB}) <> '' THEN 60 ELSE 0 END"
_LABEL = "CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END"
QPDF = "ends_with(lower(split_part({0}, '?', 1)), '.pdf')"
SQL["source_record"] = f"""{V('intake_wide')}, a AS (SELECT *, CASE WHEN product_url <> '' THEN product_url ELSE selected_product_url END AS page FROM intake_wide),
 b AS (SELECT *, CASE WHEN spec_sheet_url <> '' THEN spec_sheet_url WHEN {QPDF.format('dimension_source_url')} THEN dimension_source_url WHEN {QPDF.format('page')} THEN page ELSE '' END AS spec, {SC} AS score FROM a),
 c AS (SELECT *, coalesce(nullif(dimension_source_url, ''), nullif(page, ''), nullif(spec, ''), nullif(image_source_url, ''), '') AS src FROM b)
 SELECT row_id, trim(brand) AS display_brand, trim(model_sku) AS display_model_sku, trim(brand) AS brand, trim(model_sku) AS model_sku, {f.token('brand')} AS normalized_brand, {f.token('model_sku')} AS normalized_model_sku,
 {f.token('model_sku')} AS normalized_model, trim(product_name) AS product_name, '' AS manufacturer_url, dimensions AS dimensions_text, dimensions, dimension_source_url, image_source_url, page AS product_page_url, spec AS spec_sheet_url,
 {f.axis('dimensions', 'w')} AS width_in, {f.axis('dimensions', 'h')} AS height_in, {f.axis('dimensions', 'd')} AS depth_in, image_url,
 {f.no_www(f.netloc('src'))} AS source_domain, CAST(score AS INT) AS confidence_score, {_LABEL} AS confidence, coalesce(nullif(dimension_confidence, ''), {_LABEL}) AS dimension_confidence, coalesce(nullif(image_confidence, ''), {_LABEL}) AS image_confidence,
 CASE WHEN dimension_source_type = 'manufacturer_page' THEN 'manufacturer' WHEN dimension_source_type = 'retailer' THEN 'retailer' WHEN {QPDF.format('src')} THEN 'spec_sheet' ELSE 'other' END AS source_type,
 CAST(1 AS INT) AS success_count, CAST(0 AS INT) AS failure_count, '' AS notes FROM c"""

# Candidates: sites per brand as a list, first matching place by a plain scan.
SITES = """bs AS (SELECT brand_key, list(domain ORDER BY site_rank) AS sites FROM brand_sites GROUP BY 1)"""


def place(dom: str, sites: str) -> str:
    return f"list_min(list_filter(list_transform({sites}, lambda s, i: CASE WHEN {dom} = s OR ends_with({dom}, '.' || s) THEN i - 1 END), lambda v: v IS NOT NULL))"


def below(dom: str, names) -> str:
    return "(" + " OR ".join(f"{dom} = '{n}' OR ends_with({dom}, '.{n}')" for n in names) + ")"


LOWP = ["ajmadison.com", "manua.ls", "manualslib.com", "manuals.plus", "plessers.com", "appliancesconnection.com"]
SKIP = ["amazon.com", "amazon.ca", "amazon.co.uk", "ebay.com", "walmart.com", "target.com", "homedepot.com", "lowes.com"]
BRANDSCORE = f"(CASE WHEN pl IS NULL THEN 0 ELSE greatest(35, 70 - 8 * pl) END - CASE WHEN {below('domain', LOWP)} THEN 25 ELSE 0 END)"
SCORED = f"""{V('search_results', 'brand_sites')}, {SITES},
 s0 AS (SELECT r.*, {f.no_www(f.netloc('url'))} AS domain, coalesce(bs.sites, []) AS sites FROM search_results r LEFT JOIN bs ON bs.brand_key = {f.token('r.brand')}),
 s1 AS (SELECT *, {place('domain', 'sites')} AS pl FROM s0),
 s2 AS (SELECT *, {BRANDSCORE} AS brand_score FROM s1),
 sc AS (SELECT *, CAST(CASE WHEN {below('domain', SKIP)} THEN 0 ELSE least(100, greatest(0, 50 + brand_score + CASE WHEN contains(replace(replace(domain, '-', ''), '.', ''), replace(replace(lower(brand), ' ', ''), '-', '')) THEN 40 ELSE 0 END
   - CASE WHEN {below('domain', LOWP)} THEN 25 ELSE 0 END)) END AS INT) AS domain_score FROM s2)"""
SQL["domain_score"] = f"{SCORED} SELECT product_id, result_ordinal, domain, domain_score FROM sc"
SQL["domain_score_fixed"] = f"""{V('search_results')} SELECT product_id, result_ordinal, CAST(CASE
 WHEN (product_id + result_ordinal) % 4 = 0 THEN CASE WHEN product_id % 4 = 0 THEN 100 ELSE 70 END
 WHEN (product_id + result_ordinal) % 4 = 1 THEN CASE WHEN product_id % 4 = 1 THEN 100 ELSE 70 END
 WHEN (product_id + result_ordinal) % 4 = 2 THEN 0 ELSE CASE WHEN product_id % 4 = 3 THEN 100 ELSE 70 END END AS INT) AS domain_score FROM search_results"""
SQL["join_domain_suffix"] = f"""{V('search_results')} SELECT concat(product_id, '-', result_ordinal) AS result_id, CASE WHEN contains(url, 'maker.example.com') THEN 'maker.example.com' ELSE 'ajmadison.com' END AS listed
 FROM search_results WHERE contains(url, 'maker.example.com') OR contains(url, 'ajmadison.com')"""
SQL["join_allowlist_semi_anti"] = f"""{V('search_results')} SELECT product_id, result_ordinal, contains(url, 'amazon.com') AS skipped, contains(url, 'ajmadison.com') AS low_priority, false AS preferred, contains(url, 'ajmadison.com') AS retailer FROM search_results"""
SQL["topk_search"] = f"""{SCORED} SELECT product_id, result_ordinal, domain_score, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY domain_score DESC, result_ordinal) AS INT) AS position FROM sc) t WHERE position <= 3"""
DISTINCT = f"{SCORED}, dc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, url ORDER BY result_ordinal) AS rn FROM sc) t WHERE rn = 1)"
SQL["distinct_candidates"] = f"{DISTINCT} SELECT product_id, url, result_ordinal FROM dc"
HAY = "lower(concat_ws(' ', url, title, description))"
SPEC = "(" + " OR ".join(f"contains({HAY}, '{w}')" for w in ("dimension", "specification", "spec-sheet", "spec sheet", "installation", ".pdf")) + ")"
RANKED = f"""{DISTINCT}, rk AS (SELECT *, CASE WHEN contains({f.token("concat_ws(' ', url, title, description)")}, {f.token('model_sku')}) THEN 1 ELSE 0 END AS sku_hit, CASE WHEN pl IS NOT NULL THEN 1 ELSE 0 END AS official_hit,
 CASE WHEN {SPEC} THEN 1 ELSE 0 END AS spec_hit, CASE WHEN {weak_page('url')} <> '' THEN -1 ELSE 0 END AS weak, CASE WHEN {below('domain', LOWP)} THEN -1 ELSE 0 END AS low_priority FROM dc),
 rp AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY sku_hit DESC, official_hit DESC, spec_hit DESC, brand_score DESC, domain_score DESC, weak DESC, low_priority DESC, result_ordinal) AS INT) AS position FROM rk)"""
SQL["rank_candidates"] = f"{RANKED} SELECT product_id, position, url, sku_hit, official_hit, spec_hit, CAST(brand_score AS INT) AS brand_score, domain_score, weak, low_priority FROM rp WHERE position <= 3"
SQL["topk_diagnostics"] = f"""{RANKED} SELECT product_id, '[' || string_agg(concat('{{"url":"', url, '","title":"', title, '","domain_score":', domain_score, '}}'), ',' ORDER BY position) || ']' AS candidates FROM rp WHERE position <= 2 GROUP BY 1"""


def quoted(*parts: str) -> str:
    return " || ' ' || ".join(f"'\"' || {p} || '\"'" for p in parts)


S1, S2, S3 = "sites[1]", "sites[2]", "sites[3]"
VAR = "list_filter(list_distinct_ordered([model_sku, replace(model_sku, ' ', ''), replace(replace(model_sku, '-', ''), ' ', ''), replace(model_sku, ' ', '-'), cut]), lambda v: v IS NOT NULL AND v <> '')"


def ordered_distinct(items: str) -> str:
    """Keep the first of equal list items."""
    return f"list_filter({items}, lambda v, i: v IS NOT NULL AND v <> '' AND list_position({items}, v) = i)"


RAWV = ("[model_sku, replace(model_sku, ' ', ''), replace(replace(model_sku, '-', ''), ' ', ''), replace(model_sku, ' ', '-'), "
        "CASE WHEN regexp_matches(model_sku, '[- ][^- ]{1,3}$') THEN rtrim(regexp_replace(model_sku, '[^- ]{1,3}$', ''), ' -') END]")
Q = [f"CASE WHEN len(vs) > 0 THEN 'site:' || {S1} || ' ' || clause || ' dimensions specifications spec sheet product' END"]
for e in ("product", "spec sheet PDF", "installation guide", "installation guide PDF", "dimensions", "specification", "specifications", '"Width" "Height" "Depth"'):
    Q.append(f"CASE WHEN model_sku <> '' THEN 'site:' || {S1} || ' ' || {quoted('model_sku')} || ' {e}' END")
for s in (S2, S3):
    for e in ("dimensions", "spec sheet PDF"):
        Q.append(f"CASE WHEN model_sku <> '' THEN 'site:' || {s} || ' ' || {quoted('model_sku')} || ' {e}' END")
Q.append(f"CASE WHEN ctx <> '' AND len(vs) > 0 THEN 'site:' || {S1} || ' ' || vs[1] || ' ' || ctx || ' dimensions' END")
BOTH = "brand <> '' AND model_sku <> ''"
for e in ("dimensions", "specification", "specifications", "spec sheet PDF", "spec sheet pdf", "installation guide", "installation guide pdf", "product page"):
    Q.append(f"CASE WHEN {BOTH} THEN {quoted('brand', 'model_sku')} || ' {e}' END")
Q.append(f"CASE WHEN {BOTH} THEN {quoted('model_sku')} || ' PDF dimensions' END")
for i in (2, 3, 4):
    Q.append(f"CASE WHEN brand <> '' THEN {quoted('brand', f'vs[{i}]')} || ' dimensions specifications' END")
Q.append(f"CASE WHEN {BOTH} THEN {quoted('brand', 'model_sku')} || ' dimensions image product page' END")
Q.append(f"CASE WHEN {BOTH} AND product_name <> '' THEN {quoted('brand', 'model_sku', 'product_name')} END")
Q.append(f"CASE WHEN {BOTH} AND product_name <> '' THEN {quoted('brand', 'product_name')} END")
BASE = f"""{V('intake', 'brand_sites')}, {SITES}, b0 AS (SELECT intake.*, coalesce(bs.sites, CAST([] AS VARCHAR[])) AS sites, {RAWV} AS rv FROM intake LEFT JOIN bs ON bs.brand_key = {f.token('brand')})"""
SQL["search_queries"] = f"""{BASE}, b1 AS (SELECT *, {ordered_distinct('rv')} AS vs, concat_ws(' ', nullif(product_name, ''), nullif(category, '')) AS ctx FROM b0),
 b2 AS (SELECT *, CASE WHEN len(vs) = 1 THEN {quoted('vs[1]')} ELSE '(' || array_to_string(list_transform(vs[1:5], lambda v: '"' || v || '"'), ' OR ') || ')' END AS clause FROM b1),
 b3 AS (SELECT row_id, [{', '.join(Q)}] AS qs FROM b2), b4 AS (SELECT row_id, {ordered_distinct('qs')} AS ds FROM b3)
 SELECT row_id, CAST(position - 1 AS INT) AS position, query FROM (SELECT row_id, unnest(ds) AS query, unnest(range(1, len(ds) + 1)) AS position FROM b4) t"""
D = [f"'site:' || {S1} || ' ' || {quoted('model_sku')} || ' {e}'" for e in ("dimensions", "specifications", "spec sheet", "installation guide", '"Width" "Height" "Depth"')]
D += [f"'site:' || {s} || ' ' || {quoted('model_sku')} || ' {e}'" for s in (S2, S3) for e in ("dimensions", "spec sheet PDF")]
D += [f"{quoted('brand', 'model_sku')} || ' \"dimensions\"'", f"{quoted('brand', 'model_sku')} || ' \"specifications\"'", f"{quoted('brand', 'model_sku')} || ' spec sheet PDF'",
      f"{quoted('brand', 'model_sku')} || ' installation guide PDF'", f"CASE WHEN product_name <> '' THEN {quoted('brand', 'product_name')} || ' dimensions' END", f"{quoted('brand', 'model_sku')} || ' dimensions'"]
SQL["distinct_queries"] = f"""{BASE}, q AS (SELECT row_id, [{', '.join(D)}] AS qs FROM b0) SELECT row_id, array_to_string({ordered_distinct('qs')}, ' | ') AS queries FROM q"""
SQL["sku_variants"] = """SELECT p_partkey, CASE p_partkey % 5
 WHEN 0 THEN concat('MDD ', p_partkey, ' SS|MDD', p_partkey, 'SS|MDD-', p_partkey, '-SS|MDD ', p_partkey) WHEN 1 THEN concat('DEC', p_partkey, 'RID/R|DEC', p_partkey, 'RIDR|DEC', p_partkey, 'RID|DEC', p_partkey, 'R')
 WHEN 2 THEN concat('IC-', p_partkey, '-ID/S|IC-', p_partkey, '-IDS|IC', p_partkey, 'ID/S|IC-', p_partkey, '-ID|IC-', p_partkey, '-')
 WHEN 3 THEN concat('HV', p_partkey, 'SS') ELSE concat('X', p_partkey, 'ID/7|X', p_partkey, 'ID7|X', p_partkey, 'ID|X', p_partkey) END AS page_variants,
 CASE p_partkey % 5 WHEN 0 THEN concat('MDD ', p_partkey, ' SS|MDD', p_partkey, 'SS|MDD-', p_partkey, '-SS|MDD ', p_partkey) WHEN 1 THEN concat('DEC', p_partkey, 'RID/R|DEC', p_partkey, 'RIDR|DEC', p_partkey, 'RID|DEC', p_partkey, 'R')
 WHEN 2 THEN concat('IC-', p_partkey, '-ID/S|IC-', p_partkey, '-IDS|IC-', p_partkey, '-ID|IC-', p_partkey, '-|IC', p_partkey, 'ID/S')
 WHEN 3 THEN concat('HV', p_partkey, 'SS|HV', p_partkey) ELSE concat('X', p_partkey, 'ID/7|X', p_partkey, 'ID7|X', p_partkey, 'ID|X', p_partkey) END AS dimension_variants FROM part"""
GAPS = f.listing([("product_name = ''", "'Product Name'"), ("NOT complete", "'Dimensions'"), ("finish_color = ''", "'Finish / Color'"), ("category = ''", "'Product Category'"), ("product_url = ''", "'Product URL'"), ("NOT https_img", "'Image URL'")])
SQL["qualifies_for_enrichment"] = f"""{f.X}, g AS (SELECT row_id, brand, model_sku, {GAPS} AS gaps FROM x) SELECT row_id, brand <> '' AND model_sku <> '' AND gaps <> '' AS qualifies, gaps, false AS skip_source_type, brand = '' AS skip_no_brand, model_sku = '' AS skip_no_model FROM g"""
SQL["name_similarity"] = f"""{V('search_results')}, w AS (SELECT product_id, result_ordinal, lower(concat_ws(' ', title, description)) AS t, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]{{4,}}'), lambda v: v NOT IN ('with', 'product')) AS ws
 FROM search_results JOIN part ON p_partkey = product_id) SELECT product_id, result_ordinal, CAST(CASE WHEN len(ws) = 0 THEN 0 ELSE floor(len(list_filter(ws, lambda v: contains(t, v))) / len(ws) * 15) END AS INT) AS points FROM w"""
LINKS = "list_filter([product_url, selected_product_url, dimension_source_url, spec_sheet_url, image_source_url, CASE WHEN row_id % 3 = 0 THEN 'https://json.example.com/a' END, CASE WHEN row_id % 3 = 0 THEN 'https://json.example.com/b' END], lambda v: v IS NOT NULL AND v <> '')"
SQL["distinct_urls"] = f"""{V('intake_wide')}, l AS (SELECT row_id, {LINKS} AS ls FROM intake_wide) SELECT row_id, array_to_string(list_filter(ls, lambda v, i: list_position(ls, v) = i)[1:4], ' ') AS links FROM l"""
N = "(CASE WHEN w_ <> '' THEN 1 ELSE 0 END + CASE WHEN h_ <> '' THEN 1 ELSE 0 END + CASE WHEN d_ <> '' THEN 1 ELSE 0 END)"
SQL["dims_confidence"] = f"""{f.X} SELECT row_id, CASE WHEN {N} = 3 THEN CASE WHEN row_id % 100 >= 80 THEN 'high' ELSE 'medium' END WHEN {N} = 2 THEN 'medium' WHEN {N} = 1 THEN 'low' ELSE '' END AS by_domain_score,
 CASE WHEN {N} = 3 AND row_id % 6 = 0 THEN 'high' WHEN {N} = 3 THEN 'medium' WHEN {N} > 0 THEN 'low' ELSE 'none' END AS by_evidence FROM x"""
SQL["model_match_confidence"] = f"""{V('intake')} SELECT row_id, CASE WHEN row_id % 3 = 0 OR (row_id % 3 = 1 AND model_sku = '') THEN CASE WHEN row_id % 2 = 0 THEN 'high' ELSE 'medium' END WHEN row_id % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence FROM intake"""
SQL["plain_search_query"] = f"""{f.X} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'site:maker.example.com ' ELSE '' END || concat_ws(' ', nullif(brand, ''), nullif(model_sku, ''), nullif(product_name, '')) ||
 CASE WHEN complete THEN ' specifications official' ELSE ' dimensions width height depth spec sheet official' END AS query FROM x"""
SQL["product_identity"] = f"""{f.X} SELECT row_id, CASE WHEN {f.token('brand')} = '' AND {f.token('model_sku')} = '' THEN NULL ELSE {f.token('brand')} || '_' || {f.token('model_sku')} END AS product_key, charge FROM x"""
