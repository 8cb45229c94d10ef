"""SQL fragments in DuckDB dialect."""

from skuloom.functions import lookups
from skuloom.sources.sample_views import NEEDS, VIEWS

NUM = r"\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?"
WORDS = {"w": "width|wide|w", "h": "height|high|h", "d": "depth|deep|d", "l": "length|long|l"}


def with_views(*names: str) -> str:
    order: list[str] = []
    for n in names:
        for v in (*NEEDS.get(n, ()), n):
            if v not in order:
                order.append(v)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)


def axis(text: str, a: str) -> str:
    first = rf"({NUM})\s*(?:[\"“”″'']|\bin(?:ches)?\b|\s)*\s*[{a}{a.upper()}](?:[^a-zA-Z]|$)"
    word = rf"(?i)\b(?:{WORDS[a]})\b\s*(?:[:=]|is|of)?\s*({NUM})"
    return (
        f"coalesce(nullif(regexp_extract({text}, '{first}', 1), ''), "
        f"nullif(regexp_extract({text}, '{word}', 1), ''), '')"
    )


def complete(text: str) -> str:
    return "(" + " AND ".join(f"{axis(text, a)} <> ''" for a in "whd") + ")"


def number(t: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({t}, '^\d+\s+\d+/\d+$') THEN CAST(regexp_extract({t}, '^(\d+)', 1) AS DOUBLE) "
        rf"+ CAST(regexp_extract({t}, '\s(\d+)/', 1) AS DOUBLE) / nullif(CAST(regexp_extract({t}, '/(\d+)$', 1) AS DOUBLE), 0) "
        rf"WHEN regexp_matches({t}, '^\d+/\d+$') THEN CAST(regexp_extract({t}, '^(\d+)', 1) AS DOUBLE) "
        rf"/ nullif(CAST(regexp_extract({t}, '/(\d+)$', 1) AS DOUBLE), 0) ELSE TRY_CAST({t} AS DOUBLE) END"
    )


def token(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def spaced(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), "
        f"lambda x: upper(x[1]) || lower(x[2:])), '')"
    )


def values_case(c: str, pairs: dict[str, str], other: str) -> str:
    body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {c} {body} ELSE {other} END"


def section(c: str) -> str:
    direct = {n.lower(): n for n in lookups.SECTIONS} | lookups.SECTION_ALIASES
    words = " ".join(f"WHEN contains({spaced(c)}, '{w}') THEN '{s}'" for w, s in lookups.SECTION_KEYWORDS)
    return values_case(spaced(c), direct, f"CASE {words} ELSE 'General' END")


def category(c: str) -> str:
    listed = {n.lower(): n for n in lookups.CATEGORIES}
    return values_case(values_case(f"lower(trim({c}))", lookups.CATEGORY_ALIASES, f"lower(trim({c}))"), listed, "''")


def image_ok(c: str) -> str:
    bare = f"regexp_extract(lower({c}), '^([^?#]*)', 1)"
    return (
        f"(starts_with(lower({c}), 'https://') AND (regexp_matches({bare}, '\\.(jpg|jpeg|png|webp|gif|bmp)$') "
        f"OR (NOT regexp_matches({bare}, '\\.(html|htm|php|asp|aspx|cfm|pdf|txt|xml)$') "
        f"AND NOT contains(regexp_extract(rtrim({bare}, '/'), '([^/]*)$', 1), '.'))))"
    )


def https(c: str) -> str:
    return f"starts_with(lower({c}), 'https://')"


def pdf(c: str) -> str:
    return f"ends_with(lower(regexp_extract({c}, '^([^?#]*)', 1)), '.pdf')"


def netloc(c: str) -> str:
    return f"lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def host(c: str) -> str:
    return f"regexp_replace(regexp_replace({netloc(c)}, '^.*@', ''), ':.*$', '')"


def no_www(c: str) -> str:
    return f"regexp_replace({c}, '^www\\.', '')"


def path(c: str) -> str:
    return f"lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


WEAK = "(^|/)(sitemap|product-sitemap|search|category|categories|collections?|browse|tag|blog|support)(/|$)"


def export_reason(u: str, model: str) -> str:
    p = f"trim({path(u)}, '/')"
    q = f"regexp_matches(regexp_extract({u}, '\\?([^#]*)', 1), '(?i)(^|&)(q|query|search)=[^&]')"
    return (
        f"CASE WHEN {u} = '' THEN '' WHEN contains({p}, 'sitemap') THEN 'sitemap/category URL rejected' "
        f"WHEN contains({p}, 'search') OR {q} THEN 'search URL rejected' "
        f"WHEN regexp_matches('/' || {p} || '/', '{WEAK}') AND NOT ({token(model)} <> '' AND contains({token(u)}, {token(model)})) "
        f"THEN 'category/browse URL rejected' ELSE '' END"
    )


def sanity(d: str, cat: str) -> str:
    n = {a: number(axis(d, a)) for a in "whdl"}
    vals = "list_filter([" + ", ".join(n.values()) + "], lambda v: v IS NOT NULL)"
    name = {"w": "width", "h": "height", "d": "depth", "l": "length"}
    bound = {"w": (6, 96), "h": (3, 120), "d": (6, 60), "l": (3, 120)}
    axes = " ".join(
        f"WHEN ({n[a]}) < {bound[a][0]} THEN '{name[a]} below plausible appliance bounds' "
        f"WHEN ({n[a]}) > {bound[a][1]} THEN '{name[a]} exceeds plausible appliance bounds'"
        for a in "whdl"
    )
    return (
        f"CASE WHEN {d} = '' THEN '' "
        f"WHEN regexp_matches(lower({d}), '\\b(shipping|package|packaged|carton|box)\\b') THEN 'shipping/package dimensions' "
        f"WHEN regexp_matches(lower({d}), '\\b(cutout|rough[- ]?in|opening|clearance)\\b') THEN 'cutout/opening dimensions' "
        f"WHEN len({vals}) = 0 THEN '' "
        f"WHEN list_min({vals}) <= 0 THEN 'non-positive dimension value' "
        f"WHEN list_max({vals}) > 300 THEN 'dimension exceeds plausible product bounds' "
        f"WHEN NOT contains(lower({cat}), 'appliance') THEN '' {axes} "
        f"WHEN len({vals}) >= 3 AND list_max({vals}) < 6 THEN 'all appliance dimensions are implausibly small' ELSE '' END"
    )


def listing(pairs, sep: str = ", ") -> str:
    """Join the labels whose condition holds, in order."""
    items = ", ".join(f"CASE WHEN {cond} THEN {label} END" for cond, label in pairs)
    return f"array_to_string(list_filter([{items}], lambda v: v IS NOT NULL), '{sep}')"


CHARGE = "lower(import_type) IN ('unresolved_charge', 'manual_review_charge')"
PHOTO = "(photo_only OR lower(import_type) = 'photo upload' OR source_type = 'Photo')"
PHOTO_EXPORT = "(photo_only OR lower(import_type) IN ('photo upload', 'photo inventory upload') OR source_type = 'Photo')"
CHARGE_WORD = (
    "(?i)\\b(subtotal|sub[- ]?total|tax|gst|hst|vat|pst|delivery|shipping|freight|total|balance( due)?|discount|credit|"
    "surcharge|handling|deposit|freight & handling|f&h)\\b"
)
IGNORED = (
    f"({CHARGE} OR (source_type NOT IN ('URL','PDF_AI','Manual','Photo') AND "
    f"((product_name = '' AND brand = '' AND model_sku = '' AND product_url = '') OR regexp_matches(product_name, '{CHARGE_WORD}'))))"
)
VALID_LINK = "regexp_matches(product_url, '(?i)^https?://.{3,}\\..{2,}')"
EXPORTABLE = f"(include AND product_name <> '' AND (NOT {PHOTO_EXPORT} OR {image_ok('image_url')}))"

# Wide intake rows with the derived columns that many statements share.
X = f"""{with_views('intake_wide')},
dims1 AS (SELECT *, {axis('dimensions','w')} AS w_, {axis('dimensions','h')} AS h_, {axis('dimensions','d')} AS d_, {axis('dimensions','l')} AS l_ FROM intake_wide),
x AS (SELECT *, (w_ <> '' AND h_ <> '' AND d_ <> '') AS complete, {sanity('dimensions','category')} AS reason,
  {export_reason('product_url','model_sku')} AS url_reason, {image_ok('image_url')} AS img_ok, {https('image_url')} AS https_img,
  {CHARGE} AS charge, {PHOTO} AS photo, {PHOTO_EXPORT} AS photo_x, {IGNORED} AS ignored, {EXPORTABLE} AS exportable
  FROM dims1)
"""

IMPORTANT = [
    ("product_name = ''", "'Product Name'"), ("brand = ''", "'Brand'"), ("NOT complete", "'Dimensions'"),
    ("quantity = 0", "'Quantity'"), ("supplier = ''", "'Supplier'"), ("room = ''", "'Room'"),
    ("category = ''", "'Product Category'"),
]
ANY_IMPORTANT = "(" + " OR ".join(c for c, _ in IMPORTANT) + ")"
MISSING_PHOTO = [("product_name = ''", "'Product Name'"), ("category = ''", "'Product Category'"), ("NOT https_img", "'Image URL'")]
MISSING_LINK = [("project = ''", "'Project'"), ("room = ''", "'Room'"), (f"NOT {VALID_LINK}", "'Valid URL'")]
MISSING = (
    f"CASE WHEN photo THEN {listing(MISSING_PHOTO)} WHEN source_type = 'URL' THEN {listing(MISSING_LINK)} "
    f"ELSE {listing([('project = ' + repr(''), repr('Project')), *IMPORTANT])} END"
)
MISSING_REVIEW = (
    f"CASE WHEN photo THEN {listing(MISSING_PHOTO)} ELSE "
    + listing([*IMPORTANT[:3], ("quantity < 1", "'Quantity'"), *IMPORTANT[4:6]])
    + " END"
)


def minus(base: int, parts) -> str:
    return f"greatest(0, {base} - " + " - ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in parts) + ")"


SCORE = (
    "CASE WHEN photo THEN " + minus(85, [("product_name = ''", 35), ("category = ''", 25), ("NOT https_img", 25)])
    + " WHEN ignored THEN 0 WHEN source_type = 'PDF_AI' THEN least(100, greatest(0, confidence_score))"
    + f" WHEN source_type = 'URL' THEN CASE WHEN NOT {VALID_LINK} THEN 30 ELSE "
    + minus(90, [("project = ''", 15), ("room = ''", 10)])
    + " END ELSE "
    + minus(85, [("product_name = ''", 20), ("brand = ''", 15), ("quantity = 0", 10), ("supplier = ''", 10), ("room = ''", 10),
                 ("category = ''", 10), ("model_sku = ''", 5), ("price = ''", 5)])
    + " END"
)
