"""Row rules of the intake table: predicates, scores, statuses, vocabulary.

Every function takes and returns columns; ``c`` is a mapping or DataFrame whose
items are the intake columns (``c["brand"]``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom.functions import dims, lookups, urls
from skuloom.functions.text import (
    add_points,
    clean,
    flags_to_list,
    has,
    is_blank,
    join_list,
    keep_first,
    let,
    norm_text,
    norm_token,
    strip,
    title_case,
)

CHARGE_TYPES = ("unresolved_charge", "manual_review_charge")
REVIEW_BELOW = 75

# ---------------------------------------------------------------- vocabulary


def _fixed_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_category(col: Column) -> Column:
    """Alias, then the closed list, else blank."""
    listed = {name.lower(): name for name in lookups.CATEGORIES}
    key = F.lower(strip(col))
    target = F.coalesce(F.try_element_at(_fixed_map(lookups.CATEGORY_ALIASES), key), key)
    return F.coalesce(F.try_element_at(_fixed_map(listed), target), F.lit(""))


def section_key(col: Column) -> Column:
    return norm_text(col)


def normalize_section(col: Column) -> Column:
    """Section name, alias, first keyword, else General."""
    direct = {name.lower(): name for name in lookups.SECTIONS} | lookups.SECTION_ALIASES

    def pick(key: Column) -> Column:
        words = [(F.contains(key, F.lit(word)), section) for word, section in lookups.SECTION_KEYWORDS]
        return F.coalesce(
            F.try_element_at(_fixed_map(direct), key), F.nullif(keep_first(words), F.lit("")), F.lit("General")
        )

    return let(section_key(col), pick)


# Fixed value: endings that make a location uncertain.
UNCERTAIN = (
    r"(?i)(?:\s*[-–]\s*if\s+we\s+can\s+fit\s+it\b.*|\s+if\s+we\s+can\s+fit\s+it\b.*|\s*[-–]\s*if\s+possible\b.*"
    r"|\s+if\s+possible\b.*|\s*[-–]\s*pending\b.*|\s*[-–]\s*tbd\b.*|\s*[-–]\s*maybe\b.*|\s+if\s+it\s+fits\b.*)"
)
# Every such ending has one of these.
UNCERTAIN_WORD = r"(?i)\bif\s|pending|tbd|maybe"


def normalize_location(raw: Column, default: Column | None = None) -> Column:
    """Struct(location, score, reason); scores 0 / 40 / 65 / 90."""
    default = F.lit("") if default is None else default

    def out(place, score, reason):
        return F.struct(place.alias("location"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    def parts(text: Column) -> Column:
        return F.struct(text.alias("text"), (F.rlike(text, F.lit(UNCERTAIN_WORD)) & F.rlike(text, F.lit(UNCERTAIN))).alias("unsure"))

    def cleaned(p: Column) -> Column:
        sure = F.when(p["unsure"], F.regexp_replace(p["text"], UNCERTAIN, "")).otherwise(p["text"])
        return F.struct(p["text"].alias("text"), p["unsure"].alias("unsure"), strip(F.btrim(strip(sure), F.lit("-–"))).alias("kept"))

    def pick(p: Column) -> Column:
        text, kept = p["text"], p["kept"]
        return (
            F.when((kept == "") & (default != ""), out(default, 40, "used default location — verify"))
            .when(text == "", out(F.lit(""), 0, "no location found"))
            .when(kept == "", out(F.lit(""), 0, "location reduced to empty after cleaning"))
            .when(p["unsure"], out(title_case(kept), 65, "location inferred from uncertain note — verify"))
            .otherwise(out(title_case(kept), 90, "location extracted from annotation"))
        )

    return let(let(let(strip(raw), parts), cleaned), pick)


# ---------------------------------------------------------------- predicates

# Fixed value: words of lines that are no product.
CHARGE_WORDS = (
    r"(?i)\b(?:subtotal|sub[- ]?total|tax|gst|hst|vat|pst|delivery|shipping|freight|total|balance(?: due)?|"
    r"discount|credit|surcharge|handling|deposit|freight & handling|f&h)\b"
)


def is_charge(c) -> Column:
    return F.lower(clean(c["import_type"])).isin(*CHARGE_TYPES)


def is_photo_only(c, import_types=("photo upload",)) -> Column:
    """Photo rows. Review rules know ``photo upload`` only; export adds the inventory upload."""
    return (
        c["photo_only"]
        | F.lower(strip(c["import_type"])).isin(*import_types)
        | (strip(c["source_type"]) == "Photo")
    )


EXPORT_PHOTO_TYPES = ("photo upload", "photo inventory upload")


def is_ignored(c) -> Column:
    """Charge rows, blank rows and subtotal lines; hand-made and link rows are kept."""
    nothing = (
        is_blank(c["product_name"]) & is_blank(c["brand"]) & is_blank(c["model_sku"]) & is_blank(c["product_url"])
    )
    trusted = strip(c["source_type"]).isin("URL", "PDF_AI", "Manual", "Photo")
    return is_charge(c) | (
        ~trusted & (nothing | F.rlike(strip(c["product_name"]), F.lit(CHARGE_WORDS)))
    )


def is_included_loose(include_text: Column) -> Column:
    """Export rule on text input: anything but false / 0 / no; absent counts as included."""
    return ~F.lower(strip(include_text)).isin("false", "0", "no")


def is_included_strict(include: Column) -> Column:
    """Eligibility rule: only a real true."""
    return F.coalesce(include, F.lit(False))


def is_exportable(c) -> Column:
    return (
        c["include"]
        & has(c["product_name"])
        & (~is_photo_only(c, EXPORT_PHOTO_TYPES) | urls.is_image_url(c["image_url"]))
    )


def quantity_missing(c) -> Column:
    return F.coalesce(c["quantity"], F.lit(0)) == 0


def quantity_below_one(c) -> Column:
    return F.coalesce(c["quantity"], F.lit(0)) < 1


# ---------------------------------------------------------------- scoring


def important_missing(c, complete: Column) -> list:
    return [
        (is_blank(c["product_name"]), "Product Name"),
        (is_blank(c["brand"]), "Brand"),
        (~complete, "Dimensions"),
        (quantity_missing(c), "Quantity"),
        (is_blank(c["supplier"]), "Supplier"),
        (is_blank(c["room"]), "Room"),
        (is_blank(c["category"]), "Product Category"),
    ]


VALID_LINK = r"(?i)^https?://.{3,}\..{2,}"


def valid_link(url: Column) -> Column:
    return F.rlike(strip(url), F.lit(VALID_LINK))


def missing_fields(c, complete: Column) -> Column:
    photo = flags_to_list(
        [
            (is_blank(c["product_name"]), "Product Name"),
            (is_blank(c["category"]), "Product Category"),
            (~urls.is_https(c["image_url"]), "Image URL"),
        ]
    )
    link = flags_to_list(
        [
            (is_blank(c["project"]), "Project"),
            (is_blank(c["room"]), "Room"),
            (~valid_link(c["product_url"]), "Valid URL"),
        ]
    )
    other = flags_to_list([(is_blank(c["project"]), "Project"), *important_missing(c, complete)])
    return F.when(is_photo_only(c), photo).when(strip(c["source_type"]) == "URL", link).otherwise(other)


def review_missing_fields(c, complete: Column) -> Column:
    """Required fields of the review screen (no category check for normal rows)."""
    photo = flags_to_list(
        [
            (is_blank(c["product_name"]), "Product Name"),
            (is_blank(c["category"]), "Product Category"),
            (~urls.is_https(c["image_url"]), "Image URL"),
        ]
    )
    normal = flags_to_list(
        [
            (is_blank(c["product_name"]), "Product Name"),
            (is_blank(c["brand"]), "Brand"),
            (~complete, "Dimensions"),
            (quantity_below_one(c), "Quantity"),
            (is_blank(c["supplier"]), "Supplier"),
            (is_blank(c["room"]), "Room"),
        ]
    )
    return F.when(is_photo_only(c), photo).otherwise(normal)


def confidence_score(c) -> Column:
    """0..100 by source type; rows read by a model keep their own score."""
    photo = F.lit(85) - add_points(
        [
            (is_blank(c["product_name"]), 35),
            (is_blank(c["category"]), 25),
            (~urls.is_https(c["image_url"]), 25),
        ]
    )
    link = F.when(~valid_link(c["product_url"]), F.lit(30)).otherwise(
        F.lit(90) - add_points([(is_blank(c["project"]), 15), (is_blank(c["room"]), 10)])
    )
    own = F.least(F.greatest(F.coalesce(c["confidence_score"], F.lit(50)), F.lit(0)), F.lit(100))
    other = F.lit(85) - add_points(
        [
            (is_blank(c["product_name"]), 20),
            (is_blank(c["brand"]), 15),
            (quantity_missing(c), 10),
            (is_blank(c["supplier"]), 10),
            (is_blank(c["room"]), 10),
            (is_blank(c["category"]), 10),
            (is_blank(c["model_sku"]), 5),
            (is_blank(c["price"]), 5),
        ]
    )
    source = strip(c["source_type"])
    return F.greatest(
        F.when(is_photo_only(c), photo)
        .when(is_ignored(c), F.lit(0))
        .when(source == "PDF_AI", own)
        .when(source == "URL", link)
        .otherwise(other),
        F.lit(0),
    ).cast("int")


def manual_gap(c, complete: Column) -> Column:
    gaps = urls.any_of([cond for cond, _ in important_missing(c, complete)])
    return (strip(c["source_type"]) == "Manual") & has(c["model_sku"]) & gaps


def review_required(c, score: Column, missing: Column, complete: Column) -> Column:
    return (
        F.when(is_photo_only(c), F.size(missing) > 0)
        .when(is_ignored(c), F.lit(False))
        .otherwise(manual_gap(c, complete) | (score < REVIEW_BELOW))
    )


def row_status(c, score: Column, missing: Column, complete: Column, target: str = "Import") -> Column:
    """Status label; ``target`` is the name of the receiving application in the label."""
    ready = F.when(strip(c["source_type"]) == "URL", F.lit(f"Ready for {target}")).otherwise(
        F.lit("Ready for Review")
    )
    return (
        F.when(
            is_photo_only(c),
            F.when(F.size(missing) == 0, F.lit("Ready for Review")).otherwise(F.lit("Needs Review")),
        )
        .when(is_ignored(c), F.lit("Ignored"))
        .when(manual_gap(c, complete), F.lit("Needs Enrichment"))
        .when(score >= REVIEW_BELOW, ready)
        .otherwise(F.lit("Needs Review"))
    )


def _sentence(missing: Column) -> Column:
    n = F.size(missing)
    last = F.element_at(missing, F.when(n > 0, -1))
    head = F.array_join(F.slice(missing, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n == 1, F.concat(F.lit("Missing "), last))
        .when(n == 2, F.concat(F.lit("Missing "), head, F.lit(" and "), last))
        .otherwise(F.concat(F.lit("Missing "), head, F.lit(", and "), last))
    )


def suggested_action(c, missing: Column, complete: Column, target: str = "Import") -> Column:
    source, name = strip(c["source_type"]), strip(c["product_name"])
    no_category = is_blank(c["category"])
    important = urls.any_of([cond for cond, _ in important_missing(c, complete)])
    ai_hint, fill_hint = "AI category suggestion needed", "Use serial/model number to fill missing fields"
    dim_hint = f"Enter full W × H × D dimensions before {target} upload"
    label = F.when(F.length(name) > 40, F.concat(F.left(name, F.lit(40)), F.lit("…"))).otherwise(name)
    base = F.when(
        F.size(missing) == 0,
        F.when(source == "URL", F.lit(f"Ready for {target} URL import")).otherwise(F.lit("Ready for review")),
    ).otherwise(_sentence(missing))
    general = (
        F.when(base == "Missing Dimensions", F.lit(dim_hint))
        .when(F.array_contains(missing, "Dimensions"), F.concat(base, F.lit("; "), F.lit(dim_hint)))
        .otherwise(base)
    )
    return (
        F.when(
            is_photo_only(c),
            F.when(
                F.size(missing) > 0, F.concat(F.lit("Photo-only item missing "), F.array_join(missing, ", "))
            ).otherwise(F.lit(f"Review AI-generated photo details before {target} export")),
        )
        .when(
            is_ignored(c),
            F.when(
                name != "", F.concat(F.lit('Possible subtotal/tax row "'), label, F.lit('" — excluded'))
            ).otherwise(F.lit("Blank or non-product row — excluded")),
        )
        .when(
            (source == "URL") & ~valid_link(c["product_url"]),
            F.lit("Invalid or missing URL — please check the link"),
        )
        .when(
            manual_gap(c, complete),
            F.when(no_category, F.lit(f"{fill_hint}. {ai_hint}")).otherwise(F.lit(fill_hint)),
        )
        .when((source == "Manual") & no_category & ~important, F.lit(ai_hint))
        .otherwise(general)
    )


# ---------------------------------------------------------------- parser quality


def critical_missing(c) -> Column:
    return flags_to_list(
        [
            (strip(c["product_name"]) == "", "Product Name"),
            (strip(c["brand"]) == "", "Brand"),
            (strip(c["model_sku"]) == "", "Model/SKU"),
            (strip(c["dimensions"]) == "", "Dimensions"),
            (strip(c["supplier"]) == "", "Supplier"),
            (strip(c["category"]) == "", "Product Category"),
            (quantity_below_one(c), "Quantity"),
        ]
    )


def parse_confidence(c) -> Column:
    return F.lit(100) - add_points(
        [
            (strip(c["product_name"]) == "", 20),
            (strip(c["brand"]) == "", 15),
            (strip(c["model_sku"]) == "", 20),
            (strip(c["dimensions"]) == "", 10),
            (strip(c["supplier"]) == "", 10),
            (strip(c["category"]) == "", 10),
            (quantity_below_one(c), 10),
        ]
    )


# ---------------------------------------------------------------- identity

# Phone and e-mail forms.
PHONE = r"(?=[+(\d])(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"


def identity_problem(c) -> Column:
    gaps = flags_to_list(
        [(is_blank(c["brand"]), "manufacturer"), (is_blank(c["model_sku"]), "model")]
    )
    return F.when(~is_charge(c) & (F.size(gaps) > 0), F.concat(F.lit("missing "), F.array_join(gaps, " and "))).otherwise(
        F.lit("")
    )


def contamination(c) -> Column:
    model = clean(c["model_sku"])
    text = F.concat_ws(" ", clean(c["product_name"]), model, clean(c["brand"]), clean(c["notes"]))
    keyed = (norm_token(c["brand"]) != "") & (norm_token(c["model_sku"]) != "")
    phone, mail = F.lit(PHONE), F.lit(EMAIL)
    return keep_first(
        [
            (F.rlike(model, phone) | F.rlike(model, mail), "phone/email captured as model"),
            (F.rlike(text, mail), "email/header text detected"),
            (F.rlike(text, phone) & ~keyed, "phone/header text detected"),
        ]
    )


def product_key(brand: Column, model: Column) -> Column:
    """``brand_model``; null when both are blank."""
    # Each token is asked for twice.
    tokens = F.struct(norm_token(brand).alias("b"), norm_token(model).alias("m"))
    return let(tokens, lambda t: F.when((t["b"] != "") | (t["m"] != ""), F.concat(t["b"], F.lit("_"), t["m"])))


# ---------------------------------------------------------------- eligibility

BLOCKED = ("Ignored", "Excluded", "Error")


def eligibility_issues(c, complete: Column) -> Column:
    """Blocking reasons before a row may be sent."""
    common = [
        (~is_included_strict(c["include"]), "Not included"),
        (strip(c["status"]).isin(*BLOCKED), "Ignored or excluded"),
    ]
    photo = common + [
        (is_blank(c["product_name"]), "Missing product name"),
        (is_blank(c["category"]), "Missing category"),
        (~urls.is_https(c["image_url"]), "Missing hosted image URL"),
    ]
    normal = common + [
        (F.coalesce(c["review_required"], F.lit(False)), "Needs review"),
        (is_blank(c["product_name"]), "Missing product name"),
        (is_blank(c["brand"]), "Missing brand"),
        (~complete, "Missing full W x H x D dimensions"),
        (quantity_below_one(c), "Missing quantity"),
        (is_blank(c["supplier"]), "Missing supplier"),
        (is_blank(c["room"]), "Missing location"),
        (is_blank(c["category"]), "Missing category"),
    ]
    return F.when(is_photo_only(c), flags_to_list(photo)).otherwise(flags_to_list(normal))


def send_blockers(c, complete: Column) -> Column:
    """Variant of the send screen: no review gate, category and dimensions checked."""
    common = [
        (~c["include"], "Include unchecked"),
        (strip(c["status"]).isin(*BLOCKED), F.concat(F.lit("Status: "), c["status"])),
        (is_blank(c["product_name"]), "No product name"),
    ]
    photo = common + [
        (is_blank(c["category"]), "No category"),
        (~urls.is_https(c["image_url"]), "No hosted image URL"),
    ]
    normal = common + [
        (quantity_below_one(c), "Quantity < 1"),
        (is_blank(c["category"]), "No category"),
        (~complete, "Missing dimensions"),
    ]
    return F.when(is_photo_only(c), flags_to_list(photo)).otherwise(flags_to_list(normal))


def is_link_row(c) -> Column:
    return (c["source_type"] == "URL") & (strip(c["product_url"]) != "")


def list_text(arr: Column) -> Column:
    return join_list(arr, ", ")


def complete_dims(c) -> Column:
    return dims.has_complete_3d(c["dimensions"])
