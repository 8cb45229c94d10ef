"""Document lines and table cells to intake rows; parser and model rows merged."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions import dims, rules
from skuloom.functions.text import contains_any, keep_first, let, staged, strip, title_case
from skuloom.operators.groups import stored
from skuloom.operators.keyed import carry_down, first_per, number_within

# ---- Fixed values: words and forms of quote lines ----
# A pattern is tried at every letter of a text: the first letters are looked at before the word edges and the single words.
SKIP_WORDS = (
    r"(?i)(?=[bcdfghpstvw])\b(?:s(?:ub[- ]?total|hipping|urcharge|ervice\s+plan)|t(?:ax|otal)|[ghp]st|vat|d(?:elivery|iscount|eposit)|"
    r"f(?:reight|&h)|balance|credit|handling|protection\s+plan|warrant(?:y|ies))\b"
)
QUANTITY = r"(?i)(?=[qx(])(?:(?:qty|quantity)\s*[:\-]?\s*(\d+)|(?<!\w)x\s*(\d+)(?!\w)|\((\d+)\))"
PRICE = r"\$[\d,]+(?:\.\d{2})?|\b\d{1,6}\.\d{2}\b"
ROW_NUMBER = r"(?i)^\s*(?:row\s*)?#?\d{1,3}\s*(?:[|.)\-:]\s*)?"
ONLY_MARKS = r"^[\d\s|.,;:()#-]+$"
# What is left of such a line is signs only: it has no letters but those of a row label.
NO_WORDS = r"^[\d\s|.,;:()#$rowROW\u0085\u2028\u2029-]*$"
HEADER_WORDS = (
    r"(?i)(?=[acdefmpqst])\b(?:p(?:c\s+richard|hone|age\s+\d+|rice)|quot(?:ation|e)|s(?:election|ales\s*person)|tel(?:ephone)?|fax|"
    r"e(?:-?mail|xtension)|a(?:ddress|mount)|d(?:ate|escription)|m(?:anufacturer|odel)|colou?r)\b"
)
SKU_LABEL = (
    r"(?i)(?=[imps])(serial\s*(?:number|#|no\.?)?|s/?n|model\s*(?:number|#|no\.?)?|sku|item\s*(?:number|#|no\.?)?|"
    r"product\s*(?:code|#)?|part\s*(?:number|#|no\.?)?|mfr\.?\s*(?:number|#|no\.?)?)\s*[:\-]?\s*(\S+)"
)
MODEL_TOKEN = r"(?=[A-Z0-9])\b(?=[A-Z0-9./-]{4,}\b)(?=[A-Z0-9./-]*\d)[A-Z0-9][A-Z0-9./-]{3,}\b"
FINISH = r"(?i)\b(?:finish|color|colour)\s*[:\-]\s*([^|;,]+)"
MATERIAL = r"(?i)\bmaterial\s*[:\-]\s*([^|;,]+)"
SIZE_TEXT = (
    r"(?i)\b(?:dimensions?|size|measurements?)\s*[:\-]\s*"
    r"(\d+(?:\.\d+)?(?:\s+\d+/\d+)?\s*(?:\"|in)?\s*[x×]\s*\d+(?:\.\d+)?(?:\s+\d+/\d+)?\s*(?:\"|in)?"
    r"(?:\s*[x×]\s*\d+(?:\.\d+)?(?:\s+\d+/\d+)?\s*(?:\"|in)?)?)"
)
COMMON_LABELS = ("model #", "model number", "model no", "sku", "serial number", "serial #")
NO_MODEL = ("PHONE", "EMAIL", "TOTAL", "QUOTE", "MODEL", "COLOR", "PRICE", "FAX", "DATE")
BRANDS = (
    "Sub-Zero", "Scotsman", "Wolf", "Miele", "Bosch", "GE", "Monogram", "Lynx", "Fisher Paykel", "Fisher & Paykel",
    "Thermador", "JennAir", "KitchenAid", "Viking", "Dacor", "Samsung", "LG", "Whirlpool", "Frigidaire", "Electrolux",
    "Sharp", "Zephyr", "Kohler", "Kallista", "Waterworks", "Rohl", "Brizo", "Moen", "Toto",
)
APPLIANCE_BRANDS = ("Wolf", "Sub-Zero", "Scotsman", "Miele", "Bosch", "GE", "Monogram", "Lynx")
ROOMS = (
    "Outdoor Kitchen", "Primary Bathroom", "Primary Bath", "Powder Room", "Laundry Room", "Living Room", "Dining Room",
    "Family Room", "Great Room", "Media Room", "Mud Room", "Pool House", "Kitchen", "Bar", "Exterior", "Mudroom",
    "Pantry", "Laundry", "Bathroom", "Bath", "Bedroom", "Office", "Garage", "Basement", "Foyer", "Entry", "Gym",
)
HEADERS = {
    "product_name": ("description", "product description", "product", "item description", "item name", "name"),
    "brand": ("manufacturer", "mfr", "brand", "vendor brand"),
    "model_sku": (
        "model", "model #", "model no", "model number", "sku", "serial", "serial number", "item #", "item no", "part #",
        "part number", "mfr number",
    ),
    "dimensions": ("dimensions", "dimension", "size", "measurements", "w x d x h", "width", "height", "depth"),
    "finish_color": ("finish", "color", "colour", "finish/color", "finish colour"),
    "material": ("material", "materials"),
    "quantity": ("qty", "quantity", "qnty"),
    "price": ("price", "unit price", "amount", "extended", "line total", "total price"),
    "supplier": ("supplier", "vendor", "dealer", "sold by"),
    "room": ("room", "location", "area"),
    "category": ("category", "type"),
    "notes": ("notes", "comments", "remarks"),
}
EDGE_MARKS = " .,;:-"


def _brand_pattern() -> str:
    """Brands in lower case, longer names first, grouped by their first letter."""
    groups: dict[str, list[str]] = {}
    for b in sorted(BRANDS, key=len, reverse=True):
        groups.setdefault(b[0].lower(), []).append(b[1:].lower().replace("-", r"\-"))
    return rf"(?=[{''.join(groups)}])\b({'|'.join(f'{k}(?:{"|".join(v)})' for k, v in groups.items())})\b"


def known_brand(text: Column) -> Column:
    """First listed brand that the text names."""
    found = F.regexp_extract_all(F.lower(text), F.lit(_brand_pattern()), F.lit(1))
    names = [(b.lower(), b.replace("Fisher & Paykel", "Fisher and Paykel")) for b in BRANDS]
    return let(found, lambda hits: keep_first([(F.size(hits) <= 0, ""), *[(F.array_contains(hits, F.lit(low)), b) for low, b in names]]))


def _is(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _is_phone(text: Column) -> Column:
    """A phone number has ten signs at least."""
    return (F.length(text) >= 10) & _is(text, rules.PHONE)


def _is_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & _is(text, rules.EMAIL)


def line_class(text: Column, brand: Column | None = None) -> Column:
    """empty, header (contact or column line), charge (price only), skip (subtotal, plan), product.

    ``brand`` is the line's known brand, where that has been found before; such a line has no whitespace around it.
    """
    line = strip(text) if brand is None else text
    brand = known_brand(line) if brand is None else brand
    header = _is_email(line) | (_is(line, HEADER_WORDS) & (((brand == "") & ~_is(line, MODEL_TOKEN)) | _is_phone(line)))
    rest = strip(F.regexp_replace(F.regexp_replace(line, PRICE, " "), ROW_NUMBER, " "))
    bare_price = _is(line, NO_WORDS) & _is(line, PRICE) & ((rest == "") | _is(rest, ONLY_MARKS))
    return (
        F.when(line == "", F.lit("empty"))
        .when(header, F.lit("header"))
        .when(bare_price, F.lit("charge"))
        .when(_is(line, SKIP_WORDS), F.lit("skip"))
        .otherwise(F.lit("product"))
    )


def _bad_token(token: Column, line: Column, brand: Column) -> Column:
    def judge(bare: Column) -> Column:
        return (
            (bare == "")
            | F.startswith(bare, F.lit("$"))
            | F.upper(bare).isin(*NO_MODEL)
            | ((brand == "") & _is(line, HEADER_WORDS))
            | _is_phone(bare)
            | _is_email(bare)
        )

    return let(F.btrim(token, F.lit(" .,;:()[]")), judge)


def model_of_line(line: Column, brand: Column) -> Column:
    """Struct(value, label): a labelled number, else the first token that looks like a model."""
    nothing = F.struct(F.lit("").alias("value"), F.lit("").alias("label"))
    label = F.rtrim(strip(F.regexp_extract(line, SKU_LABEL, 1)), F.lit(":"))
    tokens = F.filter(
        F.transform(F.regexp_extract_all(line, F.lit(f"({MODEL_TOKEN})"), F.lit(1)), lambda t: F.rtrim(t, F.lit(".,;"))),
        lambda t: ~_bad_token(t, line, brand),
    )
    by_token = let(
        F.get(tokens, F.lit(0)),
        lambda t: F.when(t.isNull(), nothing).otherwise(F.struct(t.alias("value"), F.lit("model token").alias("label"))),
    )

    def labelled(number: Column) -> Column:
        """A label always has a number; no number means no label."""
        taken = let(
            F.rtrim(number, F.lit(".,;")),
            lambda v: F.when(_bad_token(v, line, brand), nothing).otherwise(F.struct(v.alias("value"), label.alias("label"))),
        )
        return F.when(number != "", taken).otherwise(by_token)

    return let(F.regexp_extract(line, SKU_LABEL, 2), labelled)


def quantity_of(line: Column) -> Column:
    groups = [F.nullif(F.regexp_extract(line, QUANTITY, i), F.lit("")) for i in (1, 2, 3)]
    return F.greatest(F.coalesce(F.coalesce(*groups).try_cast("int"), F.lit(1)), F.lit(1))


def price_of(line: Column) -> Column:
    return F.regexp_extract(line, f"({PRICE})", 1)


def name_of(line: Column, model: Column) -> Column:
    """What is left of a line without labels, model, price, quantity, finish, material and row number."""
    text = F.regexp_replace(line, SKU_LABEL, "")
    own = F.concat(F.lit(r"(?i)\b\Q"), model, F.lit(r"\E\b"))
    text = F.when(model != "", F.regexp_replace(text, own, F.lit(" "))).otherwise(text)
    for pattern in (PRICE, QUANTITY, FINISH, MATERIAL, ROW_NUMBER):
        text = F.regexp_replace(text, pattern, "")
    text = F.btrim(F.regexp_replace(text, r"\s{2,}", " "), F.lit(EDGE_MARKS))
    return let(text, lambda t: F.when(_is(t, ONLY_MARKS), F.lit("")).otherwise(t))


def dimensions_of(line: Column) -> Column:
    mark = {"width": "W", "height": "H", "depth": "D", "length": "L"}
    labelled = let(
        dims.parse_dims(line),
        lambda p: F.concat_ws(" x ", *[F.when(p[a] != "", F.concat(p[a], F.lit('"' + mark[a]))) for a in dims.AXES]),
    )
    return let(labelled, lambda t: F.when(t != "", t).otherwise(strip(F.regexp_extract(line, SIZE_TEXT, 1))))


def labelled(line: Column, pattern: str) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_extract(line, pattern, 1), r"\s{2,}", " "), F.lit(" .,:;-"))


def room_in(text: Column) -> Column:
    """First room word of a text, title-cased."""
    return title_case(F.regexp_extract(text, rf"(?i)\b({'|'.join(ROOMS)})\b", 1))


def without_room(text: Column, room: Column) -> Column:
    cut = F.regexp_replace(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), room, F.lit(r"\E(?![A-Za-z0-9])")), F.lit(" "))
    return F.when((room != "") & (text != ""), F.btrim(F.regexp_replace(cut, r"\s{2,}", " "), F.lit(EDGE_MARKS))).otherwise(text)


def document_context(lines: DataFrame) -> DataFrame:
    """Project, supplier and category of each document: first matching line."""
    project = labelled(F.col("text"), r"(?i)\bproject\s*[:\-]\s*(.+)")
    supplier = labelled(F.col("text"), r"(?i)\b(?:supplier|vendor|sold\s+by|dealer)\s*[:\-]\s*(.+)")
    dealer = _is(F.col("text"), r"(?i)\bPC\s+Richard\b|\bP\.?C\.?\s+Richard\b")
    found = lines.select("doc_id", "line_no", project.alias("p"), supplier.alias("s"), dealer.alias("d"), _is(F.col("text"), r"(?i)\bappliances?\b").alias("a"))

    def first(col: str) -> Column:
        return F.min(F.when(F.col(col) != "", F.struct("line_no", F.col(col).alias("v"))))["v"]

    return found.groupBy("doc_id").agg(
        F.coalesce(first("p"), F.lit("")).alias("doc_project"),
        F.coalesce(first("s"), F.when(F.max("d"), F.lit("PC Richard")), F.lit("")).alias("doc_supplier"),
        F.when(F.max("a"), F.lit("Appliances")).otherwise(F.lit("")).alias("doc_category"),
    )


def lines_to_rows(lines: DataFrame) -> DataFrame:
    """Product and charge rows of document lines (doc_id, line_no, text)."""
    long_enough = lines.withColumn("text", strip(F.col("text"))).filter(F.length("text") >= 3)
    text = F.col("text")
    branded = staged(long_enough, {"brand": known_brand(text)})
    rows = staged(branded, {"kind": line_class(text, F.col("brand"))}).filter(F.col("kind").isin("product", "charge"))
    rows = staged(rows, {"_model": model_of_line(text, F.col("brand"))})
    rows = staged(rows, {"_name": name_of(text, F.col("_model.value"))})
    rows = rows.filter((F.col("kind") == "charge") | (F.col("_name") != "") | (F.col("_model.value") != ""))
    charge = F.col("kind") == "charge"
    number = F.regexp_extract(text, r"(?i)^\s*(?:row\s*)?#?(\d{1,3})\s*(?:[|.)\-:]\s*)?", 1)
    charge_name = F.when(number != "", F.concat(F.lit("Unresolved Charge - Row "), number)).otherwise(F.lit("Unresolved Charge"))
    tag = F.when(
        (F.col("_model.label") != "") & ~F.lower(F.col("_model.label")).isin(*COMMON_LABELS),
        F.concat(F.lit("["), F.col("_model.label"), F.lit(": "), F.col("_model.value"), F.lit("]")),
    ).otherwise(F.lit(""))
    blank = F.lit("")

    def product(value: Column) -> Column:
        return F.when(charge, blank).otherwise(value)

    rows = rows.withColumns(
        {
            "finish_color": product(labelled(text, FINISH)),
            "material": product(labelled(text, MATERIAL)),
            "notes": F.when(charge, F.concat(F.lit("[Unresolved charge: "), text, F.lit("]"))).otherwise(tag),
        }
    )
    rows = rows.withColumn("room", product(room_in(F.concat_ws(" ", "_name", "finish_color", "notes"))))
    rows = rows.withColumns(
        {
            "product_name": F.when(charge, charge_name).otherwise(without_room(F.col("_name"), F.col("room"))),
            "finish_color": without_room(F.col("finish_color"), F.col("room")),
            "model_sku": product(F.col("_model.value")),
            "dimensions": product(dimensions_of(text)),
            "category": product(F.when(F.col("brand").isin(*APPLIANCE_BRANDS), F.lit("Appliances")).otherwise(blank)),
            "brand": product(F.col("brand")),
            "quantity": F.when(charge, F.lit(1)).otherwise(quantity_of(text)),
            "price": price_of(text),
            "include": ~charge,
            "import_type": F.when(charge, F.lit("unresolved_charge")).otherwise(blank),
            "source_type": F.lit("PDF"),
        }
    )
    return rows.drop("_model", "_name", "kind")


def with_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Document defaults into the rows, then the row status."""
    out = rows.join(context, "doc_id", "left")
    out = out.withColumns(
        {
            "supplier": F.coalesce("doc_supplier", F.lit("")),
            "project": F.coalesce("doc_project", F.lit("")),
        }
    ).drop("doc_supplier", "doc_project", "doc_category")
    return out.withColumn("status", parsed_status(out))


def parsed_status(c) -> Column:
    gap = F.lit(False)
    for x in ("product_name", "brand", "supplier", "room", "category", "dimensions"):
        gap = gap | (strip(c[x]) == "")
    open_ = (strip(c["model_sku"]) != "") & gap
    return F.when(c["import_type"] == "unresolved_charge", F.lit("Manual Review")).when(open_, F.lit("Needs Enrichment")).otherwise(
        F.lit("Needs Review")
    )


# ------------------------------------------------------------------ tables


def canonical_header(cell: Column) -> Column:
    """Column a header cell stands for; blank when none."""

    def spaced(t: str) -> str:
        return "".join(ch if ch.isalnum() or ch == "#" else " " for ch in t.lower()).strip()

    def shortest(names) -> list[str]:
        """Names that hold no other name of the list: a text with one of the others has one of these."""
        every = {spaced(a) for a in names}
        return sorted(a for a in every if not any(b != a and b in a for b in every))

    def pick(text: Column) -> Column:
        return F.when(text == "", F.lit("")).otherwise(
            keep_first([(contains_any(text, shortest(names)), column) for column, names in HEADERS.items()])
        )

    return let(F.btrim(F.regexp_replace(F.lower(cell), "[^a-z0-9#]+", " ")), pick)


# Columns of which a header row names one at least.
MAIN_HEADERS = ("product_name", "model_sku", "brand")


def _first_words(columns: tuple[str, ...]) -> list[str]:
    """First words of the headers of some columns, without those that hold another: any spelling of a header has one of them."""
    every = {re.split("[^a-z0-9]", name)[0] for c in columns for name in HEADERS[c]}
    return sorted(a for a in every if not any(b != a and b in a for b in every))


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """Table rows (doc_id, page, table_no, row_no, cells) to product rows.

    Each row is read with the latest header above it; columns the table lacks are read from the joined text.
    """
    rows = staged(cells.select("doc_id", "page", "table_no", "row_no", "cells"), {"cells": F.transform("cells", strip)})
    # A header row names the product, its model or its brand: only rows with the first word of such a name are looked at by cell.
    named = contains_any(F.lower(F.array_join("cells", "|")), _first_words(MAIN_HEADERS))
    rows = staged(rows, {"_head": F.when(named, F.transform("cells", canonical_header))})
    main = F.array(*[F.lit(x) for x in MAIN_HEADERS])
    hits = let(F.array_distinct(F.filter("_head", lambda h: h != "")), lambda x: (F.size(x) >= 2) & F.arrays_overlap(x, main))
    hits = F.when(F.col("cells").isNotNull(), F.coalesce(hits, F.lit(False)))
    rows = staged(rows, {"_is_header": hits}).withColumn("_own", F.when(F.col("_is_header"), F.col("_head"))).drop("_head")
    # The search for the header above reads the rows several times.
    filled = carry_down(stored(rows, "cells"), ["doc_id", "page", "table_no"], "row_no", "_own", "header")
    body = staged(filled.filter(~F.col("_is_header")), {"text": F.array_join(F.filter("cells", lambda c: c != ""), " | ")})
    text, none = F.col("text"), F.col("header").isNull()
    body = staged(body, {"_found": known_brand(text)})
    body = staged(body, {"kind": line_class(text, F.col("_found"))}).filter(F.col("kind").isin("product", "charge"))

    def cell(column: str) -> Column:
        """The cell below the last header of that column; a row may have fewer cells than its header."""
        back = F.array_position(F.reverse("header"), column)
        return F.when(none | (back == 0), F.lit("")).otherwise(F.coalesce(F.get("cells", F.size("header") - back.cast("int")), F.lit("")))

    wanted = ("product_name", "brand", "model_sku", "dimensions", "finish_color", "material", "quantity", "price")
    body = staged(body, {f"_{c}": cell(c) for c in wanted})
    body = staged(body, {"_token": model_of_line(text, F.col("_found"))["value"]})

    def first(column: str, other: Column) -> Column:
        return F.when(F.col(f"_{column}") != "", F.col(f"_{column}")).otherwise(other)

    names = {
        "product_name": F.when(none, name_of(text, F.col("_token"))).otherwise(F.col("_product_name")), "model_sku": first("model_sku", F.col("_token")),
    }
    body = staged(body, names).filter((F.col("product_name") != "") | (F.col("model_sku") != ""))
    digits = F.regexp_replace("_quantity", r"\D+", "").try_cast("int")
    return body.select(
        "doc_id", "page", "table_no", "row_no", "kind", "text",
        "product_name",
        first("brand", F.col("_found")).alias("brand"),
        "model_sku",
        first("dimensions", dimensions_of(text)).alias("dimensions"),
        first("finish_color", labelled(text, FINISH)).alias("finish_color"),
        first("material", labelled(text, MATERIAL)).alias("material"),
        F.when(none | (F.col("_quantity") == ""), F.when(none, quantity_of(text)).otherwise(F.lit(1)))
        .otherwise(F.greatest(F.coalesce(digits, F.lit(1)), F.lit(1)))
        .alias("quantity"),
        first("price", F.when(none, price_of(text)).otherwise(F.lit(""))).alias("price"),
    )


def prefer_tables(table_rows: DataFrame, lines: DataFrame, to_rows: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Line rows only for pages without table rows, then each (name, model) once per document.

    ``lines`` are line rows, or lines that ``to_rows`` makes rows of one by one: no other lines' rows can stay.  The table rows are written
    once, since their pages are asked for as well.
    """
    table_rows = stored(table_rows, "table-rows")
    pages = table_rows.select("doc_id", "page").distinct()
    rest = to_rows(lines.join(pages, ["doc_id", "page"], "left_anti"))
    both = table_rows.unionByName(rest)
    keyed = both.withColumn("_n", F.lower(strip(F.col("product_name")))).withColumn("_m", F.lower(strip(F.col("model_sku"))))
    return first_per(keyed, ["doc_id", "_n", "_m"], [F.asc("page"), F.asc("row_no")]).drop("_n", "_m")


# ------------------------------------------------------------------ parser rows and model rows

TEXT_FIELDS = ("product_name", "brand", "model_sku", "dimensions", "supplier", "category", "finish_color", "price")


def choose_value(parsed: Column, model: Column) -> Column:
    """The model's text when it has one."""
    return F.when(F.coalesce(strip(model), F.lit("")) != "", strip(model)).otherwise(F.coalesce(strip(parsed), F.lit("")))


def choose_quantity(parsed: Column, model: Column) -> Column:
    a, b = F.coalesce(parsed, F.lit(0)), F.coalesce(model, F.lit(0))
    return F.when((a > 1) & (b <= 1), a).when(b > 0, b).when(a > 0, a).otherwise(F.lit(1))


def choose_notes(parsed: Column, model: Column) -> Column:
    a, b = F.coalesce(strip(parsed), F.lit("")), F.coalesce(strip(model), F.lit(""))
    return F.when((a != "") & (b != "") & ~F.contains(a, b), F.concat(a, F.lit(" "), b)).when(b != "", b).otherwise(a)


def merge_by_model(parsed: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Equality stage: k-th parser row of a (document, model) meets the k-th model row of it."""
    token = rules.norm_token(F.col("model_sku"))

    def numbered(df: DataFrame, prefix: str) -> DataFrame:
        keyed = df.withColumn("model_key", token)
        with_key = number_within(keyed.filter("model_key <> ''"), ["doc_id", "model_key"], "position", "nth")
        cols = ["position", "quantity", "notes", *TEXT_FIELDS]
        return with_key.select("doc_id", "model_key", "nth", *[F.col(c).alias(prefix + c) for c in cols])

    j = numbered(parsed, "p_").join(numbered(model_rows, "m_"), ["doc_id", "model_key", "nth"], "full")
    return j.select(
        "doc_id", "model_key", "nth", "p_position", "m_position",
        *[choose_value(F.col(f"p_{c}"), F.col(f"m_{c}")).alias(c) for c in TEXT_FIELDS],
        choose_quantity(F.col("p_quantity"), F.col("m_quantity")).cast("int").alias("quantity"),
        choose_notes(F.col("p_notes"), F.col("m_notes")).alias("notes"),
    )


# ------------------------------------------------------------------ pairing


def _grams(name: Column, most: int = 4) -> Column:
    """All parts of up to ``most`` letters, tagged with their length."""
    def of(k: int) -> Column:
        last = F.length(name) - k + 1
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substr(name, i, F.lit(k)))

    return F.array_distinct(F.concat(*[of(k) for k in range(1, most + 1)]))


def _linked_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, name, other): names of a document of which one holds the other.

    An inverted index: the shorter name is known by its first four letters (or itself), the longer one by all its parts of
    at most four letters; pairs that meet are compared.
    """
    head = lambda c: F.substr(c, F.lit(1), F.lit(4))
    a = left.select("doc_id", F.col("name"))
    b = right.select("doc_id", F.col("name").alias("other"))
    inner = a.withColumn("piece", head(F.col("name"))).join(b.withColumn("piece", F.explode(_grams(F.col("other")))), ["doc_id", "piece"])
    outer = b.withColumn("piece", head(F.col("other"))).join(a.withColumn("piece", F.explode(_grams(F.col("name")))), ["doc_id", "piece"])
    both = inner.filter(F.contains("other", F.col("name"))).select("doc_id", "name", "other").unionByName(
        outer.filter(F.contains("name", F.col("other"))).select("doc_id", "name", "other")
    )
    return both.distinct()


def _chosen(rows: DataFrame, listed: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, i, j): the row of rank r in its group takes the r-th listed row that no earlier row of other groups holds.

    ``rows`` has the keys, i and rank; ``listed`` the keys, j and place; ``taken`` the keys, place and the holder of rows held from
    outside the group.
    """
    held = taken.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "holder"))).alias("held"))
    placed = rows.join(held, keys, "left").withColumn(
        "place",
        F.aggregate(
            F.coalesce("held", F.array().cast("array<struct<place:int,holder:int>>")), F.col("rank"),
            lambda at, h: F.when((h["place"] <= at) & (h["holder"] < F.col("i")), at + 1).otherwise(at),
        ),
    )
    return placed.join(listed, [*keys, "place"]).select("doc_id", "i", "j")


# Documents of at most this many rows on each side are walked in one expression; any number gives the same result.
WALKED_ROWS = 64


def _walked_pairs(sides: DataFrame) -> DataFrame:
    """Pairs of short documents: a row per document with the rows of both sides in order, walked by the rule as it is told.

    ``sides`` has doc_id, own (parser row or model row), position, model and name; a document has at most a fixed number of rows.
    """
    row = F.struct("position", "model", "name")
    docs = sides.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("own"), row))).alias("p"), F.array_sort(F.collect_list(F.when(~F.col("own"), row))).alias("m")
    )

    def step(used: Column, x: Column) -> Column:
        """``used`` has the place of the model row that each parser row before took, 0 for none."""
        def free(test) -> Column:
            at = F.filter(F.sequence(F.lit(1), F.size("m")), lambda k: test(F.element_at("m", k)) & ~F.array_contains(used, k))
            return F.when(F.size("m") > 0, F.get(at, F.lit(0)))

        here = F.size(used) + 1
        by_model = F.when(x["model"] != "", free(lambda y: y["model"] == x["model"]))
        by_place = F.when((here <= F.size("m")) & ~F.array_contains(used, here), here)
        held = lambda y: (y["name"] != "") & (F.contains(y["name"], x["name"]) | F.contains(x["name"], y["name"]))
        by_name = F.when(x["name"] != "", free(held))
        return F.array_append(used, F.coalesce(by_model, by_place, by_name, F.lit(0)))

    walked = staged(docs, {"taken": F.aggregate("p", F.array().cast("array<int>"), step)})
    places = F.when(F.size("m") > 0, F.sequence(F.lit(1), F.size("m"))).otherwise(F.array().cast("array<int>"))
    pair = lambda p, m: F.struct(p.alias("p_position"), m.alias("m_position"))
    none = F.lit(None).cast("long")
    matched = F.transform("p", lambda x, k: pair(x["position"], F.get("m", F.element_at("taken", k + 1) - 1)["position"]))
    alone = F.transform(F.array_except(places, F.col("taken")), lambda k: pair(none, F.element_at("m", k)["position"]))
    return walked.select("doc_id", F.inline(F.concat(matched, alone)))


def pair_rows(parsed: DataFrame, model_rows: DataFrame, walked_rows: int = WALKED_ROWS) -> DataFrame:
    """(doc_id, p_position, m_position): parser rows with the model row each takes, both sides whole.

    The rule: parser rows take, in order, the first free model row of their model, else the free one at their own
    place, else the first free one whose name holds theirs or is held by it.  Documents of up to ``walked_rows`` rows a side are walked
    by that rule, each in one row; longer ones are paired in rounds over tables, so that no task needs a whole document.

    Positions are whole numbers, unique per document and side.  Null and blank models and names match nothing; a document on one
    side only keeps all its rows.
    """

    def side(df: DataFrame, own: bool) -> DataFrame:
        return df.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lit(own).alias("own"), F.col("position").cast("long").alias("position"),
            F.coalesce(rules.norm_token(F.col("model_sku")), F.lit("")).alias("model"),
            F.coalesce(rules.norm_token(F.col("product_name")), F.lit("")).alias("name"),
        )

    sides = stored(side(parsed, True).unionByName(side(model_rows, False)), "pair-sides")
    counts = sides.groupBy("doc_id").agg(F.count_if("own").alias("p"), F.count_if(~F.col("own")).alias("m"))
    long = stored(counts.filter(F.greatest("p", "m") > walked_rows).select("doc_id"), "pair-long")
    if long.isEmpty():
        return _walked_pairs(sides)
    short = _walked_pairs(sides.join(long, "doc_id", "left_anti"))
    rest = sides.join(long, "doc_id", "left_semi")
    return short.unionByName(_pairs_in_rounds(rest.filter("own").drop("own"), rest.filter("NOT own").drop("own")))


def _pairs_in_rounds(parsed: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Pairs of documents of any length; both sides have doc_id, position, model and name.

    A row's choice depends on the choices of earlier rows only, so all rows choose at once against the choices of the round
    before, until no choice changes; every round settles at least the first unsettled row of each document.  Rows of one model or one
    name choose in one step: the r-th of them takes the r-th model row that no earlier row of another group holds.  Choices are tables,
    joined by document and model, place or name; rows held from outside a group form one array per group.
    """

    def side(df: DataFrame, index: str) -> DataFrame:
        return stored(number_within(df, ["doc_id"], "position", index), f"pair-{index}")

    left, right = side(parsed, "i"), side(model_rows, "j")
    of_model = stored(number_within(left.filter("model <> ''"), ["doc_id", "model"], "position", "rank").select("doc_id", "model", "i", "rank"), "pair-model")
    by_model = stored(number_within(right.filter("model <> ''"), ["doc_id", "model"], "position", "place").select("doc_id", "model", "j", "place"), "pair-models")
    names = lambda df: df.filter("name <> ''").select("doc_id", "name").distinct()
    links = _linked_names(names(left), names(right))
    by_name = links.join(right.select("doc_id", F.col("name").alias("other"), "position", "j"), ["doc_id", "other"])
    by_name = stored(number_within(by_name, ["doc_id", "name"], "position", "place").select("doc_id", "name", "j", "place"), "pair-names")
    none = lambda: F.lit(None).cast("string")
    held, before = None, None
    while True:
        known = held if held is not None else left.limit(0).select("doc_id", "i", F.col("i").alias("j"), none().alias("model"), none().alias("name"))

        def outside(listed: DataFrame, group: str) -> DataFrame:
            """Listed rows that rows of other groups hold."""
            at = known.select("doc_id", "j", F.col("i").alias("holder"), F.col(group).alias("own"))
            met = listed.join(at, ["doc_id", "j"]).filter(~F.col(group).eqNullSafe(F.col("own")))
            return met.groupBy("doc_id", group, "place").agg(F.min("holder").alias("holder"))

        first = _chosen(of_model, by_model, outside(by_model, "model"), ["doc_id", "model"])
        first = first.join(of_model, ["doc_id", "i"]).select("doc_id", "i", "j", "model", none().alias("name"))
        rest = left.join(first.select("doc_id", "i"), ["doc_id", "i"], "left_anti")
        there = right.select("doc_id", "j").join(known.groupBy("doc_id", "j").agg(F.min("i").alias("holder")), ["doc_id", "j"], "left")
        second = rest.join(there, (rest["doc_id"] == there["doc_id"]) & (rest["i"] == there["j"])).filter("holder IS NULL OR holder >= i")
        second = second.select(rest["doc_id"], "i", "j", none().alias("model"), none().alias("name"))
        left_over = rest.filter("name <> ''").join(second.select("doc_id", "i"), ["doc_id", "i"], "left_anti")
        of_name = number_within(left_over.select("doc_id", "name", "i"), ["doc_id", "name"], "i", "rank")
        third = _chosen(of_name, by_name, outside(by_name, "name"), ["doc_id", "name"])
        third = third.join(left.select("doc_id", "i", "name"), ["doc_id", "i"]).select("doc_id", "i", "j", none().alias("model"), "name")
        held = stored(first.unionByName(second).unionByName(third), "pairs")
        now = held.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "i", "j").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    pairs = left.select("doc_id", "i", F.col("position").alias("p_position")).join(held.select("doc_id", "i", "j"), ["doc_id", "i"], "left")
    return pairs.join(right.select("doc_id", "j", F.col("position").alias("m_position")), ["doc_id", "j"], "full").select(
        "doc_id", "p_position", "m_position"
    )


# ------------------------------------------------------------------ merged rows

# Fields of which the model's value wins, fields copied where the model has them, and fields kept for audit.
MERGED = (
    "project", "room", "product_name", "brand", "dimensions", "finish_color", "color", "material", "model_sku", "category", "price", "supplier",
)
COPIED = ("confidence_score", "review_required", "missing_fields", "suggested_action", "category_confidence", "category_source")
AUDITED = ("product_name", "supplier", "model_sku", "dimensions")
NO_MATCH = "AI returned no matching row"


def merge_rows(parsed: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Merged rows of both sides: matched ones, parser rows without a partner, and model rows without one.

    All columns of either side stay; ``p_position`` and ``m_position`` tell where a row comes from.  Audit columns give the parser's, the model's
    and the final value of four fields, whether the model was used, the parse confidence and the critical fields missing before and after.
    """
    pairs = pair_rows(parsed, model_rows)
    # Plain columns: of a struct per row, all would be moved and written for the joins, also those that nobody asks for.
    wrap = lambda df, p: df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias(f"{p}_position"), F.lit(True).alias(f"_{p}"),
        *[F.col(c).alias(f"_{p}_{c}") for c in df.columns],
    )
    # The model's rows first: fewer and shorter rows are moved for the second join.
    j = pairs.join(wrap(model_rows, "m"), ["doc_id", "m_position"], "left").join(wrap(parsed, "p"), ["doc_id", "p_position"], "left")
    both, own = F.col("_p").isNotNull() & F.col("_m").isNotNull(), F.col("_p").isNotNull()
    left, right = set(parsed.columns), set(model_rows.columns)
    columns = [c for c in [*parsed.columns, *[x for x in model_rows.columns if x not in left]] if c not in ("doc_id", "position")]

    def side(p: str, has: set, c: str) -> Column:
        other = (parsed if c in left else model_rows).schema[c].dataType
        return F.col(f"_{p}_{c}") if c in has else F.lit(None).cast(other)

    def value(c: str) -> Column:
        a, b = side("p", left, c), side("m", right, c)
        if c in MERGED:
            chosen = choose_value(a, b)
        elif c == "quantity":
            chosen = choose_quantity(a, b)
        elif c == "notes":
            chosen = choose_notes(a, b)
        elif c in COPIED:
            chosen = F.when(F.coalesce(strip(b.cast("string")), F.lit("")) != "", b).otherwise(a)
        elif c == "source_type":
            chosen = F.lit("PDF_AI")
        else:
            chosen = a if c in left else b
        return F.when(both, chosen).when(own, a).otherwise(b).alias(c)

    rows = j.select("*", *[value(c) for c in columns])
    score = rules.parse_confidence({c: F.coalesce(F.col(c), F.lit(0 if c == "quantity" else "")) for c in CRITICAL})
    out = rows.withColumn("parse_confidence", F.greatest(F.lit(0), score).cast("int"))
    if "status" in columns:
        ready = F.when(F.col("parse_confidence") >= 75, F.lit("Ready for Review"))
        status = ready.when(F.coalesce(strip(F.col("status")), F.lit("")) == "", F.lit("Needs Review")).otherwise(F.col("status"))
        out = out.withColumn("status", F.when(both, status).otherwise(F.col("status")))
    text = lambda x: F.coalesce(strip(x), F.lit(""))
    audit = {}
    for c in AUDITED:
        audit[f"deterministic_{c}"], audit[f"ai_{c}"] = text(side("p", left, c)), text(side("m", right, c))
        audit[f"final_{c}"] = text(F.col(c))
    before = {c: F.when(own, side("p", left, c)).otherwise(side("m", right, c)) for c in CRITICAL}
    audit |= {
        "ai_used": F.col("_m").isNotNull(),
        "ai_skipped_reason": F.when(F.col("_m").isNull(), F.lit(NO_MATCH)).otherwise(F.lit("")),
        "missing_critical_fields_before_ai": missing_critical(before),
        "missing_critical_fields_after_ai": missing_critical({c: F.col(c) for c in CRITICAL}),
    }
    return out.withColumns(audit).select(*dict.fromkeys(["doc_id", "p_position", "m_position", *columns, "parse_confidence", *audit]))


# Critical fields of a parsed row and their labels.
CRITICAL = {
    "product_name": "Product Name", "brand": "Brand", "model_sku": "Model/SKU", "dimensions": "Dimensions", "supplier": "Supplier",
    "category": "Product Category", "quantity": "Quantity",
}


def missing_critical(c: dict[str, Column]) -> Column:
    """Labels of the critical fields that are blank, or whose quantity is below 1."""
    def gone(name: str) -> Column:
        if name == "quantity":
            return F.coalesce(c[name].cast("long"), F.lit(0)) < 1
        return F.coalesce(strip(c[name]), F.lit("")) == ""

    return F.concat_ws(", ", *[F.when(gone(k), F.lit(label)) for k, label in CRITICAL.items()])


# ------------------------------------------------------------------ model answers

ITEM_SCHEMA = (
    "array<struct<project:string,room:string,product_name:string,brand:string,dimensions:string,model_sku:string,"
    "product_category:string,quantity:string,supplier:string,confidence_score:string,review_required:string,notes:string>>"
)


def array_text(answer: Column) -> Column:
    """The JSON array inside an answer: fences out, typographic marks replaced, first ``[`` to last ``]``."""

    def plain(text: Column) -> Column:
        """Most answers have neither fences nor signs beyond ASCII."""
        ascii_only = F.octet_length(text) == F.length(text)
        return F.when(ascii_only, text).otherwise(F.translate(text, "“”‘’［］", "\"\"''[]"))

    fenced = F.contains(answer, F.lit("```"))
    text = let(F.when(fenced, F.regexp_replace(answer, r"```(?:json)?\s*|```", "")).otherwise(answer), plain)
    return F.regexp_extract(strip(text), r"(?s)(\[.*\])", 1)


def items_of(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per item of an answer; unreadable answers yield none."""
    # Spark drops empty lists before it explodes; of a plain column that test would read the answer once more.
    parsed = staged(answers.select("doc_id", answer), {"_items": F.from_json(array_text(F.col(answer)), ITEM_SCHEMA)})
    return parsed.select("doc_id", F.posexplode("_items").alias("position", "item"))


def item_rows(items: DataFrame, default_room: str = "") -> DataFrame:
    """Coerce model items: quantity >= 1, score 0..100, flags, category, location with penalty."""
    it = F.col("item")

    def text(name: str) -> Column:
        return F.coalesce(strip(it[name]), F.lit(""))

    score = F.least(F.greatest(F.coalesce(it["confidence_score"].try_cast("int"), F.lit(50)), F.lit(0)), F.lit(100))
    raw = F.when(text("room") != "", text("room")).otherwise(F.lit(default_room))
    rows = items.withColumn("_loc", rules.normalize_location(raw, F.lit(default_room))).withColumn("_raw", raw)
    unsure = F.col("_loc.score") < 75
    note = F.concat(F.lit("[Location note: "), F.col("_raw"), F.lit("]"))
    odd = (F.col("_raw") != "") & unsure & (F.col("_loc.location") != F.col("_raw")) & ~F.contains(text("notes"), note)
    final = F.when(unsure, F.greatest(score - 15, F.lit(0))).otherwise(score)
    return rows.select(
        "doc_id",
        "position",
        text("product_name").alias("product_name"),
        text("brand").alias("brand"),
        text("model_sku").alias("model_sku"),
        rules.normalize_category(text("product_category")).alias("category"),
        F.greatest(F.coalesce(it["quantity"].try_cast("int"), F.lit(1)), F.lit(1)).alias("quantity"),
        F.col("_loc.location").alias("room"),
        F.when(odd, F.concat_ws(" ", F.nullif(text("notes"), F.lit("")), note)).otherwise(text("notes")).alias("notes"),
        final.alias("confidence_score"),
        (F.lower(text("review_required")) == "true").alias("review_required"),
        F.when(final >= 75, F.lit("Ready for Review")).otherwise(F.lit("Needs Review")).alias("status"),
    )


# ------------------------------------------------------------------ result answers

# Links and sizes that are saved from an answer that can't be parsed, and the reason given.
SAVED_LINKS = ("image_url", "image_source_url", "dimension_source_url", "product_page_url", "spec_sheet_url")
SAVED_SIZES = ("width_in", "height_in", "depth_in")
RESULT_FIELDS = ("row_id", "safe_to_write", "confidence", "reason", *SAVED_LINKS, *SAVED_SIZES)
UNREADABLE = "OpenAI JSON response could not be parsed safely."


def json_text(answer: Column) -> Column:
    """The JSON in an answer: fences out, from the first opening to the last closing bracket."""
    text = strip(F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), r"(?i)^```(?:json)?\s*|\s*```$", ""))

    def last_of(c: str, t: Column) -> Column:
        return F.when(F.contains(t, F.lit(c)), F.length(t) - F.length(F.substring_index(t, c, -1)))

    def ends(t: Column) -> Column:
        first = F.least(*[F.nullif(F.locate(c, t), F.lit(0)) for c in "{["])
        return F.struct(t.alias("t"), first.alias("first"), F.greatest(*[last_of(c, t) for c in "}]"]).alias("last"))

    def cut(p: Column) -> Column:
        return F.when(p["last"] > p["first"], F.substr(p["t"], p["first"], p["last"] - p["first"] + 1)).otherwise(p["t"])

    return let(let(text, ends), cut)


def repaired_json(text: Column) -> Column:
    """Control signs and bare constants replaced, missing closing brackets added: braces first, then square ones."""
    clean = F.regexp_replace(F.replace(text, F.lit("\ufeff"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    clean = F.regexp_replace(clean, r"\b(?:NaN|Infinity|-Infinity)\b", "null")

    def closed(t: Column, opening: str, closing: str) -> Column:
        count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
        return F.concat(t, F.repeat(F.lit(closing), F.greatest(F.lit(0), count(opening) - count(closing))))

    return let(let(clean, lambda t: closed(t, "{", "}")), lambda t: closed(t, "[", "]"))


def result_rows(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per result of an answer, with ``position``, ``parse_status`` and the result's fields as text.

    An answer is a list, an object with a list ``rows``, or one object.  Text that is no JSON is repaired; where that fails as well, the
    links and sizes in it are saved in one result that is not safe to write.  Readable answers without a result keep one
    row of nulls with the status ``no_rows``; so no answer vanishes.  Other columns of ``answers`` stay.
    """
    text = answers.withColumn("_text", json_text(F.col(answer)))
    parsed = text.withColumn("_strict", F.try_parse_json("_text")).withColumn(
        "_json", F.coalesce("_strict", F.try_parse_json(repaired_json(F.col("_text"))))
    )
    # Found once: the three forms below all ask for it.
    parsed = parsed.withColumn("_kind", F.left(F.schema_of_variant("_json"), F.lit(6)))
    kind = F.col("_kind")
    listed = F.coalesce(
        F.when(F.startswith(kind, F.lit("OBJECT")), F.try_variant_get("_json", "$.rows", "array<variant>")),
        F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("_json", "$", "array<variant>")),
        F.when(F.startswith(kind, F.lit("OBJECT")), F.array("_json")),
    )

    def link(name: str) -> Column:
        raw = F.regexp_extract("_text", rf'"{name}"\s*:\s*"([^"\\]*(?:\\.[^"\\]*)*)"', 1)

        def read(v: Column) -> Column:
            as_json = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), v, F.lit('"'))), "$", "string")
            return F.when(v != "", F.when(F.contains(v, F.lit("\\")), F.coalesce(as_json, v)).otherwise(v))

        return let(raw, read)

    saved = {"safe_to_write": F.lit("false"), "confidence": F.lit("none"), "reason": F.lit(UNREADABLE)}
    saved |= {c: link(c) for c in SAVED_LINKS}
    saved |= {c: F.nullif(F.regexp_extract("_text", rf'"{c}"\s*:\s*([0-9.]+)', 1), F.lit("")) for c in SAVED_SIZES}
    broken = F.col("_json").isNull()
    rows = parsed.withColumn("_broken", broken).select("*", F.posexplode_outer(listed).alias("position", "_row"))
    status = F.when(F.col("_broken"), F.lit("partial_recovery")).when(F.col("_row").isNull(), F.lit("no_rows"))
    status = status.when(F.col("_strict").isNull(), F.lit("json_repaired")).otherwise(F.lit("strict_json"))
    none = F.lit(None).cast("string")
    fields = {f"result_{c}": F.when(F.col("_broken"), saved.get(c, none)).otherwise(F.try_variant_get("_row", f"$.{c}", "string")) for c in RESULT_FIELDS}
    return rows.withColumns({**fields, "position": F.coalesce("position", F.lit(0)), "parse_status": status}).drop(
        "_text", "_strict", "_json", "_kind", "_broken", "_row"
    )
