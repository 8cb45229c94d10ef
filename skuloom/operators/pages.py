"""Page extraction and scoring on element rows: dimensions, images, fields, links, page verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions import dims, rules, urls
from skuloom.functions.text import add_points, flags_to_list, keep_first, let, norm_token, squeeze, strip
from skuloom.operators.candidates import name_similarity, site_position, weak_page_reason
from skuloom.operators.keyed import first_per, top_per

# ------------------------------------------------------------------ dimension candidates in text

_N = dims.NUMBER
_U = r"(?:[\"“”″']|\bin(?:ches)?\b|\bcm\b|\bmm\b)"
# Labels and forms of dimension texts.
PRODUCT_LABEL = r"(?iU)(?:product|overall)\s+dimensions?\s*[:\-]\s*([^\n]{5,100})"
CUTOUT_LABEL = r"(?iU)cutout\s+dimensions?\s*[:\-]\s*([^\n]{5,100})"
SHIPPING_LABEL = r"(?iU)shipping\s+(?:dimensions?|size)\s*[:\-]\s*([^\n]{5,100})"
ANY_LABEL = r"(?iU)\b(?:dimensions?|size|measurements?|appliance\s+dimensions?)\s*[:\-]\s*([^\n]{5,120})"
INLINE = (
    r"(?U)[\d][\d ./]*\"?\s*[WwHhDd]\b[\s×xX]+[\d][\d ./]*\"?\s*[WwHhDd]\b[\s×xX]+[\d][\d ./]*\"?\s*[WwHhDd]\b"
)
TRIPLE = rf"(?iU)(?<![\w/])({_N})\s*({_U})?\s*[×xX]\s*({_N})\s*({_U})?\s*[×xX]\s*({_N})\s*({_U})?(?![\w/])"
NEAR = (
    r"(?iU)\b(dimensions?|size|measurements?|measures|overall|product|appliance|width|height|depth|specifications?|"
    r"w\s*[×x]\s*d\s*[×x]\s*h|w\s*[×x]\s*h\s*[×x]\s*d)\b"
)
NOT_NEAR = r"(?iU)\b(shipping|package|packaged|carton|box|cutout|rough[- ]?in|opening)\b"
# Every text with a candidate has one of these.
WORTH_READING = r"(?iU)\d|dimension|size|measurement"


def matches(text: Column, pattern: str, *groups: int) -> Column:
    """All matches with their places: array of (start, end, g<n> of each group), end exclusive.

    ``split`` gives the text between the matches, so running lengths are the places.
    """
    parts = F.arrays_zip(
        F.split(text, pattern).alias("gap"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (0, *groups)],
    )
    fields = "".join(f",g{g}:string" for g in (0, *groups))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["g0"]), F.lit(0))
        hit = F.struct(start.alias("start"), end.alias("end"), *[p[f"g{g}"].alias(f"g{g}") for g in (0, *groups)])
        return F.struct(end.alias("at"), F.when(p["g0"].isNotNull(), F.concat(a["hits"], F.array(hit))).otherwise(a["hits"]).alias("hits"))

    none = F.array().cast(f"array<struct<start:int,end:int{fields}>>")
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("hits")), step, lambda a: a["hits"])


def dimension_candidates(text: Column, cutout: bool = False) -> Column:
    """Array of candidate texts, most trusted first: product label, other label, inline, bare W x D x H near a size word.

    Sizes of cutouts and shipping boxes are left out (``cutout`` adds the former at the end); null and blank texts have none.
    """

    def free_of(found: Column, *taken: Column) -> Column:
        """Matches that start outside all taken ones."""
        return F.filter(
            found,
            lambda m: ~urls.any_of([F.exists(t, lambda s: (s["start"] <= m["start"]) & (m["start"] < s["end"])) for t in taken]),
        )

    def near_size_word(t: Column, m: Column) -> Column:
        begin = F.greatest(m["start"] - 70, F.lit(0))
        around = F.substring(t, begin + 1, m["end"] + 30 - begin)
        return F.rlike(around, F.lit(NEAR)) & ~F.rlike(around, F.lit(NOT_NEAR))

    def spelled(m: Column) -> Column:
        unit = F.coalesce(*[F.nullif(m[g], F.lit("")) for g in ("g2", "g4", "g6")], F.lit("in"))
        return F.concat(*[x for g, mark in (("g1", '"W x '), ("g3", '"D x '), ("g5", '"H')) for x in (dims.inches_text(m[g], unit), F.lit(mark))])

    def listed(t: Column, label: Column) -> Column:
        product, hole, box = label["product"], label["hole"], label["box"]
        triples = F.filter(free_of(matches(t, TRIPLE, 1, 2, 3, 4, 5, 6), hole, box), lambda m: near_size_word(t, m))
        found = [
            F.transform(product, lambda m: m["g1"]),
            F.transform(free_of(matches(t, ANY_LABEL, 1), product, hole, box), lambda m: m["g1"]),
            F.transform(free_of(matches(t, INLINE), hole, box), lambda m: m["g0"]),
            F.transform(triples, spelled),
            *([F.transform(hole, lambda m: m["g1"])] if cutout else []),
        ]
        trimmed = F.transform(F.concat(*found), lambda x: F.rtrim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(".,;:")))
        return F.array_distinct(F.filter(trimmed, lambda x: x != ""))

    def read(t: Column) -> Column:
        labels = F.struct(
            *[matches(t, p, 1).alias(n) for n, p in (("product", PRODUCT_LABEL), ("hole", CUTOUT_LABEL), ("box", SHIPPING_LABEL))]
        )
        return let(labels, lambda label: listed(t, label))

    none = F.array().cast("array<string>")
    return let(text, lambda t: F.when(F.rlike(t, F.lit(WORTH_READING)), read(t)).otherwise(none))


def axes_present(text: Column) -> Column:
    """How many of width, height and depth a text names, with any unit."""
    parts = []
    for axis in ("width", "height", "depth"):
        number_first = rf"(?:{_N})\s*(?:{_U}|\s)*[{dims.LETTER[axis]}](?![a-zA-Z])"
        word_first = rf"\b(?i:{dims.WORDS[axis]})\b\s*(?:[:=]|is|of)?\s*(?:{_N})"
        parts.append(F.when(F.rlike(text, F.lit(f"{number_first}|{word_first}")), 1).otherwise(0))
    return parts[0] + parts[1] + parts[2]


def best_candidate(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Most axes first (three is enough), then the earliest; an aggregate, so no key is collected."""
    scored = candidates.withColumn("axes", axes_present(F.col("candidate"))).filter("axes > 0")
    place = [F.col(c) for c in order]
    best = F.min(F.struct((-F.col("axes")).alias("rank"), *place, F.col("candidate")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in order], F.col("b.candidate").alias("dimensions"), (-F.col("b.rank")).alias("axes"))


def label_key(label: Column) -> Column:
    """Meaning of a table label; shipping and cutout labels are recognised first."""

    def pick(t: Column) -> Column:
        def any_word(*words):
            return urls.any_of([F.contains(t, F.lit(w)) for w in words])

        return keep_first(
            [
                (t == "", ""),
                (any_word("shipping", "package", "packaged", "carton", "box"), "shipping"),
                (any_word("cutout", "rough in", "opening"), "cutout"),
                (F.contains(t, F.lit("width")) | (t == "w") | F.endswith(t, F.lit(" w")), "width"),
                (F.contains(t, F.lit("height")) | (t == "h") | F.endswith(t, F.lit(" h")), "height"),
                (F.contains(t, F.lit("depth")) | (t == "d") | F.endswith(t, F.lit(" d")), "depth"),
                (any_word("dimension", "measurement", "size", "w x d x h", "w x h x d"), "dimensions"),
            ]
        )

    return let(F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " ")), pick)


STAGES = {"json_ld": 1, "embedded": 2, "dl": 3, "dl_parts": 4, "table": 5, "table_parts": 6, "visible_text": 7}


def _labelled_value(value: Column, mark: str) -> Column:
    """``4"W`` from a table value such as ``4 in`` or ``10 cm``; null when blank."""

    def show(p: Column) -> Column:
        return F.when(p["n"] == "", F.concat(p["v"], F.lit(" " + mark))).otherwise(
            F.concat(dims.inches_text(p["n"], p["u"]), F.lit('"' + mark))
        )

    parts = F.struct(
        value.alias("v"),
        F.regexp_extract(value, rf"({_N})", 1).alias("n"),
        F.regexp_extract(value, rf"(?:{_N})\s*({_U})", 1).alias("u"),
    )
    return F.when(F.coalesce(value, F.lit("")) != "", let(parts, show))


AXIS_MARKS = (("width", "W"), ("height", "H"), ("depth", "D"))


def page_dimensions(elements: DataFrame) -> DataFrame:
    """Best dimension text per page with the method that found it.

    Order of trust: JSON-LD, app JSON, definition lists, tables, visible text; a complete size wins over any
    partial one.  One pass: each element offers its best candidate, the page keeps the minimum of
    (-axes, stage, position), and sizes spread over table rows are put together in the same aggregate.
    """
    rows = elements.filter(F.col("kind").isin("script", "text", "dl", "table"))
    free = F.col("kind").isin("script", "text")
    method = (
        F.when(F.col("kind") == "text", "visible_text")
        .when(F.col("kind") != "script", F.col("kind"))
        .when(F.col("name") == "json_ld", "json_ld")
        .otherwise("embedded")
    )
    rows = rows.withColumn("method", method).withColumn("key", F.when(~free, label_key(F.col("name"))))
    rows = rows.withColumn("found", dimension_candidates(F.when(free, F.col("value"))))
    near = F.rlike("value", F.lit(NEAR)) & ~F.rlike("value", F.lit(NOT_NEAR))
    loose = let(
        dims.parse_dims(F.col("value")),
        lambda p: F.concat_ws(" x ", *[_labelled_value(p[x], m) for x, m in AXIS_MARKS]),
    )
    offers = (
        F.when(~free, F.when(F.col("key") == "dimensions", F.array("value")).otherwise(F.array().cast("array<string>")))
        .when(F.size("found") > 0, F.col("found"))
        .when(near, F.array(loose))
        .otherwise(F.array().cast("array<string>"))
    )
    stage = F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("method"))

    def entry(text: Column, at: Column, stage: Column, seq: Column, method: Column) -> Column:
        return F.struct(
            (-axes_present(text)).alias("rank"), stage.alias("stage"), seq.alias("seq"), at.alias("pos"),
            method.alias("method"), text.alias("dimensions"),
        )

    def assembled(kind: str):
        name = f"{kind}_parts"
        return lambda t: entry(t, F.lit(0), F.lit(STAGES[name]), F.lit(0), F.lit(name))

    best = F.array_min(F.transform(offers, lambda t, i: entry(t, i, stage, F.col("seq"), F.col("method"))))
    offered = rows.select("page_id", "seq", "kind", "key", "value", best.alias("best"))

    def part(kind: str, axis: str) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("key") == axis), F.struct("seq", "value")))["value"]

    per_page = offered.groupBy("page_id").agg(
        F.min("best").alias("best"),
        *[part(kind, axis).alias(f"{kind}_{axis}") for kind in ("dl", "table") for axis, _ in AXIS_MARKS],
    )
    built = [
        let(F.concat_ws(" x ", *[_labelled_value(F.col(f"{kind}_{x}"), m) for x, m in AXIS_MARKS]), assembled(kind))
        for kind in ("dl", "table")
    ]
    top = per_page.select("page_id", F.array_min(F.array_compact(F.array("best", *built))).alias("b"))
    return top.filter(F.col("b.rank") < 0).select(
        "page_id", "b.dimensions", (-F.col("b.rank")).alias("axes"), "b.method"
    )


def text_page_dimensions(pages: DataFrame) -> DataFrame:
    """Documents given as page texts (doc_id, page, text): first complete size, else the best partial."""
    found = pages.select("doc_id", "page", F.posexplode(dimension_candidates(F.col("text"))).alias("pos", "candidate"))
    return best_candidate(found, ["doc_id"], ["page", "pos"])


# ------------------------------------------------------------------ images

# Words of product context, of image hosts and image paths.
CONTEXT_WORDS = ("gallery", "product", "media", "carousel", "pdp", "hero", "main-image", "primary-image", "zoom")
IMAGE_HOSTS = ("scene7", "cloudinary", "akamai", "cdn", "shopify", "images")
IMAGE_PATHS = ("/image/", "/images/", "/media/", "is/image", "scene7", "cloudinary")
META_IMAGES = {"og:image": "og:image", "og:image:url": "og:image", "twitter:image": "twitter:image", "twitter:image:src": "twitter:image"}


def of_page(table: DataFrame) -> DataFrame:
    """A table with a row per page, as a join partner: dealt by key, never sent whole through the driver.

    Its file is small for its rows, so Spark would broadcast it long after it has outgrown the driver.
    """
    return table.hint("merge")


def page_images(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Image candidates per page, each URL once (first seen: metadata, images, sources, styles, scripts)."""
    source = F.coalesce(
        *[F.when((F.col("kind") == "meta") & (F.col("name") == k), F.lit(v)) for k, v in META_IMAGES.items()],
        F.when(F.col("kind") == "image", F.col("name")),
    )
    order = (
        F.when(F.col("kind") == "meta", 0)
        .when(F.col("name").isin("img", "img_srcset"), 1)
        .when(F.col("name") == "source_srcset", 2)
        .when(F.col("name") == "css_background", 3)
        .otherwise(4)
    )
    rows = elements.withColumn("source_type", source).filter(F.col("source_type").isNotNull()).withColumn("_order", order)
    rows = rows.filter((F.col("source_type") != "css_background") | urls.any_of([F.contains("context", F.lit(w)) for w in CONTEXT_WORDS]))
    rows = rows.join(of_page(pages.select("page_id", F.col("url").alias("page_url"))), "page_id")
    raw = F.replace(F.replace(strip(F.col("value")), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    rows = rows.withColumn("image_url", urls.join_url(F.col("page_url"), raw)).filter(
        F.startswith("image_url", F.lit("https://")) & ~F.startswith(raw, F.lit("data:"))
    )
    like = (
        F.rlike("image_url", F.lit(r"(?i)\.(?:jpe?g|png|webp|gif|bmp|avif)(?:[?#]|$)"))
        | urls.any_of([F.contains(F.lower("image_url"), F.lit(w)) for w in IMAGE_PATHS])
        | F.col("source_type").isin("og:image", "twitter:image", "json_ld_image")
    )
    rows = rows.filter(like).withColumn("_plain", F.substring_index("image_url", "#", 1))
    return first_per(rows, ["page_id", "_plain"], [F.asc("_order"), F.asc("seq")]).select(
        "page_id", "page_url", "image_url", "source_type", "alt", F.col("title"), "context", "width", "height",
        F.struct(F.col("_order").alias("group"), F.col("seq")).alias("position"),
    )


# Words of images that show no product.
BAD_WORDS = (
    "logo", "icon", "favicon", "placeholder", "default-meta-image", "default_meta_image", "sprite", "swatch", "spinner",
    "loader", "blank", "transparent", "pixel", "tracking", "generic_product_promo_overlay", "promo_overlay",
    "promotional_overlay",
)


def score_images(c: DataFrame) -> DataFrame:
    """Score, confidence and rejection of image candidates joined to brand, model_sku and product_name."""
    model, brand = norm_token(F.col("model_sku")), norm_token(F.col("brand"))
    rows = c.withColumns(
        {
            "_u": norm_token(F.col("image_url")),
            "_t": norm_token(F.concat_ws(" ", "alt", "title", "context")),
            "_m": model,
            "_b": brand,
            "_words": F.filter(
                F.regexp_extract_all(F.lower("product_name"), F.lit("([a-z0-9]{3,})"), F.lit(1)),
                lambda w: ~w.isin("the", "and", "with", "for", "product"),
            ),
            "_low": F.lower(F.concat_ws(" ", "image_url", "alt", "title")),
            "_ih": urls.netloc(F.col("image_url")),
            "_ph": urls.netloc(F.col("page_url")),
        }
    )
    has_m, has_b = F.col("_m") != "", F.col("_b") != ""
    mu, mt = has_m & F.contains("_u", F.col("_m")), has_m & F.contains("_t", F.col("_m"))
    bu, bt = has_b & F.contains("_u", F.col("_b")), has_b & F.contains("_t", F.col("_b"))
    words = F.size(F.filter("_words", lambda w: F.contains(F.col("_low"), w)))
    w, h, src = F.col("width"), F.col("height"), F.col("source_type")
    both, wide = w.isNotNull() & h.isNotNull(), w.isNotNull() & h.isNull()
    same = (F.col("_ph") != "") & ((F.col("_ih") == F.col("_ph")) | F.endswith("_ih", F.concat(F.lit("."), F.col("_ph"))))
    context = urls.any_of([F.contains("context", F.lit(x)) for x in CONTEXT_WORDS])
    points = add_points(
        [
            (mu, 40), (~mu & mt, 30), (bu, 12), (~bu & bt, 8),
            (src == "og:image", 35), (src == "twitter:image", 30), (src == "json_ld_image", 25),
            (src.isin("next_data", "shopify_json", "embedded_json"), 15),
            (context, 20),
            (both & (w >= 300) & (h >= 300), 15), (both & (F.greatest(w, h) < 300), -10), (both & (w * h >= 1_000_000), 5),
            (wide & (w >= 300), 10), (wide & (w >= 1000), 5),
            (w.isNull() & src.isin("og:image", "twitter:image", "json_ld_image"), 5),
            (same, 12),
            (~same & urls.any_of([F.contains("_ih", F.lit(x)) for x in IMAGE_HOSTS]), 8),
        ]
    ) + F.least(F.lit(18), words * 6)
    named = has_m & F.contains(norm_token(F.concat("image_url", F.lit(" "), "alt", F.lit(" "), "title")), F.col("_m"))
    hay = F.lower(F.concat_ws(" ", "image_url", "alt", "title", "context"))
    bad = F.get(F.filter(F.array(*[F.lit(x) for x in BAD_WORDS]), lambda x: F.contains(hay, x)), F.lit(0))
    why = (
        F.when(both & (F.greatest(w, h) < 100), F.lit("tiny image"))
        .when(F.endswith(F.lower(F.substring_index("image_url", "?", 1)), F.lit(".svg")) & ~named, F.lit("svg without model evidence"))
        .when(~named & bad.isNotNull(), F.concat(F.lit("contains "), bad))
        .otherwise(F.lit(""))
    )
    rows = rows.withColumn("rejection", why).withColumn("_points", points)
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.col("_points") - F.when(F.col("rejection") != "", 60).otherwise(0)))
    out = rows.withColumn("score", score.cast("int")).withColumn("confidence", image_label(F.col("score")))
    return out.drop("_u", "_t", "_m", "_b", "_words", "_low", "_ih", "_ph", "_points")


def image_label(score: Column) -> Column:
    return (
        F.when(score >= 70, F.lit("high")).when(score >= 45, F.lit("medium")).when(score > 0, F.lit("low")).otherwise(F.lit("none"))
    )


def best_image(scored: DataFrame, valid: Column | None = None) -> DataFrame:
    """Best usable image per page: order by score before the content-type bonus of 10."""
    rows = scored.filter(F.col("rejection") == "")
    if valid is not None:
        rows = rows.filter(valid).withColumn("final_score", F.least(F.lit(100), F.col("score") + 10))
    else:
        rows = rows.withColumn("final_score", F.col("score"))
    rows = rows.withColumn("final_confidence", image_label(F.col("final_score"))).filter(
        F.col("final_confidence").isin("high", "medium")
    )
    return first_per(rows, ["page_id"], [F.desc("score"), F.asc("position")])


def top_images(scored: DataFrame, k: int = 3) -> DataFrame:
    return top_per(scored, ["page_id"], [F.desc("score"), F.asc("position")], k, "place")


# ------------------------------------------------------------------ fields and links


def page_fields(elements: DataFrame) -> DataFrame:
    """Name, brand, category, description, finish and material per page."""

    def first(kind: str, *names: str) -> Column:
        picks = [
            F.min(F.when((F.col("kind") == kind) & (F.col("name") == n) & (strip(F.col("value")) != ""), F.struct("seq", "value")))["value"]
            for n in names
        ]
        return F.coalesce(*picks, F.lit(""))

    stop = r"(?=\s+(?:finish|color|colour|materials?|dimensions?|width|height|depth)\s*[:\-]|$|[|;,])"
    text = squeeze(F.col("value"))
    is_text = F.col("kind") == "text"
    rows = elements.filter(F.col("kind").isin("product", "meta", "title", "text")).withColumns(
        {
            "_finish": F.when(is_text, F.regexp_extract(text, rf"(?i)\b(?:finish|color|colour)\s*[:\-]\s*(.+?){stop}", 1)),
            "_material": F.when(is_text, F.regexp_extract(text, rf"(?i)\bmaterials?\s*[:\-]\s*(.+?){stop}", 1)),
        }
    )
    got = rows.groupBy("page_id").agg(
        first("product", "name").alias("_ld"),
        first("meta", "og:title", "twitter:title").alias("_og"),
        first("title", "").alias("_title"),
        first("product", "brand").alias("brand"),
        first("product", "category").alias("_category"),
        first("meta", "description", "og:description", "twitter:description").alias("description"),
        F.coalesce(F.max("_finish"), F.lit("")).alias("finish"),
        F.coalesce(F.max("_material"), F.lit("")).alias("material"),
    )
    name = F.coalesce(*[F.nullif(strip(F.col(x)), F.lit("")) for x in ("_ld", "_og", "_title")], F.lit(""))
    return got.select(
        "page_id",
        strip(F.substring_index(name, "|", 1)).alias("name"),
        "brand",
        rules.normalize_category(F.col("_category")).alias("category"),
        "description",
        "finish",
        "material",
        F.col("_title").alias("title"),
    )


# Fixed value: words of specification documents.
SPEC_LINK_WORDS = (
    r"spec|specification|dimension|install|installation|manual|guide|product[-_ ]?sheet|submittal|technical"
)


def spec_links(elements: DataFrame, pages: DataFrame, k: int = 3) -> DataFrame:
    """Specification PDFs linked from a page, those naming the model first, best ``k``."""
    links = elements.filter((F.col("kind") == "link") & (strip(F.col("value")) != "")).join(
        of_page(pages.select("page_id", "url", "model_sku")), "page_id"
    )
    rows = links.withColumn("link", urls.join_url(F.col("url"), F.col("value"))).filter("link <> ''")
    hay = F.lower(F.concat_ws(" ", "link", "name"))
    rows = rows.withColumn("_hay", hay).filter(F.contains("_hay", F.lit(".pdf")) & F.rlike("_hay", F.lit(SPEC_LINK_WORDS)))
    model = norm_token(F.col("model_sku"))
    score = F.when((model != "") & F.contains(norm_token(F.col("_hay")), model), 3).otherwise(1)
    rows = rows.withColumn("score", score).withColumn("link", F.substring_index("link", "#", 1))
    once = first_per(rows, ["page_id", "link"], [F.asc("seq")])
    return top_per(once, ["page_id"], [F.desc("score"), F.asc("seq")], k, "place").select("page_id", "link", "score", "place")


# ------------------------------------------------------------------ page verification


def score_pages(c: DataFrame) -> DataFrame:
    """Verify page against product: needs brand, model_sku, product_name, official, url, html, title, description, has_image."""
    model, brand = norm_token(F.col("model_sku")), norm_token(F.col("brand"))
    rows = c.withColumns(
        {
            "_weak": weak_page_reason(F.col("url")),
            "_m": model,
            "_b": brand,
            "_nu": norm_token(F.col("url")),
            "_nt": norm_token(F.col("title")),
            "_nd": norm_token(F.col("description")),
            "_nh": norm_token(F.col("html")),
            "official_site": site_position(urls.site(F.col("url")), F.col("official")).isNotNull(),
        }
    )
    spots = flags_to_list(
        [((F.col("_m") != "") & F.contains(col, F.col("_m")), name) for name, col in (("url", F.col("_nu")), ("title", F.col("_nt")), ("description", F.col("_nd")), ("html", F.col("_nh")))]
    )
    rows = rows.withColumn("locations", F.array_join(spots, ",")).withColumn(
        "matched_brand",
        (F.col("_b") != "") & F.contains(F.concat("_nu", "_nt", "_nd", "_nh"), F.col("_b")),
    )
    sku = F.col("locations") != ""
    structured = F.rlike("html", F.lit(r"(?i)application/ld\+json|@type[\"']?\s*:\s*[\"']Product"))
    described = F.rlike("html", F.lit(r"(?i)<table|<dl|dimensions?|specifications?|width|height|depth"))
    total = add_points(
        [(sku, 50), (F.col("matched_brand"), 15), (F.col("official_site"), 25), (structured, 10), (described, 10), (F.col("has_image"), 10)]
    ) + name_similarity(F.col("product_name"), F.concat_ws(" ", "title", "description", "html"))
    no_brand = (F.col("_b") != "") & ~F.col("matched_brand") & ~F.col("official_site")
    no_sku = (F.col("_m") != "") & ~sku
    rows = rows.withColumn(
        "rejection",
        F.when(F.col("_weak") != "", F.col("_weak"))
        .when(no_brand, F.lit("brand not found on candidate page"))
        .when(no_sku, F.lit("exact SKU/model not found"))
        .otherwise(F.lit("")),
    )
    rows = rows.withColumn(
        "score",
        F.when((F.col("_weak") != "") | no_brand, F.lit(0))
        .when(no_sku, F.when(F.col("official_site") & F.col("matched_brand"), 20).otherwise(0))
        .otherwise(F.least(F.lit(100), total))
        .cast("int"),
    )
    confidence = (
        F.when((F.col("_weak") != "") | no_brand, F.lit("none"))
        .when(no_sku, F.lit("low"))
        .when(F.col("official_site") & sku & (F.col("score") >= 80), F.lit("high"))
        .when(sku & (F.col("score") >= 60), F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return rows.withColumn("page_confidence", confidence).drop("_weak", "_m", "_b", "_nu", "_nt", "_nd", "_nh")


def select_page(scored: DataFrame, k: int = 3) -> DataFrame:
    """Best verified page among the first ``k`` candidates per product; nothing after the first official high one counts."""
    sure = (F.col("page_confidence") == "high") & F.col("official_site")
    near = scored.filter(F.col("position") <= k).withColumn("_sure", sure)
    stop = near.groupBy("product_id").agg(F.min(F.when(F.col("_sure"), F.col("position"))).alias("_stop"))
    live = near.join(stop, "product_id").filter(F.col("_stop").isNull() | (F.col("position") <= F.col("_stop")))
    level = F.when(F.col("page_confidence") == "high", 2).when(F.col("page_confidence") == "medium", 1)
    live = live.withColumn("_level", level).filter(F.col("_level").isNotNull())
    order = [F.desc("_level"), F.desc(F.col("official_site").cast("int")), F.desc("score"), F.asc("position")]
    return first_per(live, ["product_id"], order).drop("_sure", "_stop", "_level")
