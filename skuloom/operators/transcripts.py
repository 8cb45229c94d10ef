"""Call transcripts to product fields, turn by turn.

Values are read per turn and combined by aggregation, so a very long call is never collected into one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions import dims
from skuloom.functions.text import strip

# Spoken numbers.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SPOKEN = rf"(?iU)\b(?:(?:{'|'.join(NUMBER_WORDS)}|hundred|and)[\s-]*)+\b"


def _value_of(phrase: Column) -> Column:
    """A spoken number as digits; a phrase with any other word stays as it is, without its outer spaces."""
    kept = F.regexp_replace(phrase, r"(?U)^\s+|\s+$", "")
    words = F.filter(F.split(F.lower(kept), r"(?U)[\s-]+"), lambda w: w != "and")
    value = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    total = F.aggregate(
        words,
        F.lit(0),
        lambda sofar, w: F.when(w == "hundred", F.greatest(sofar, F.lit(1)) * 100).otherwise(sofar + F.try_element_at(value, w)),
    )
    return F.when(F.size(words) > 0, F.coalesce(total.cast("string"), kept)).otherwise(kept)


def number_words(text: Column) -> Column:
    """Spoken numbers as digits: ``eighty-four`` -> ``84``; the text between the phrases stays."""
    phrases = F.regexp_extract_all(text, F.lit(SPOKEN), F.lit(0))
    between = F.split(text, SPOKEN)
    digits = F.concat(F.transform(phrases, _value_of), F.array(F.lit("")))
    spoken = F.array_join(F.zip_with(between, digits, lambda a, b: F.concat(a, b)), "")
    return F.when(F.rlike(text, F.lit(SPOKEN)), spoken).otherwise(text)


NUM = r"(\d+(?:\.\d+)?)"
UNIT = r"\s*(?:inches|inch|in|\"|”)?\s*"
LABELS = {"Width": "width|wide|w", "Depth": "depth|deep|d", "Height": "height|high|h"}
BY, BY_WIDE = r"\s*(?:x|×|by)\s*", r"\s*(?:by|x|×|,|and)\s*"
W, D, H = (rf"(?:{LABELS[x]})" for x in ("Width", "Depth", "Height"))
TRIPLES = (
    (rf"(?i){NUM}{UNIT}{W}{BY_WIDE}{NUM}{UNIT}{D}{BY_WIDE}{NUM}{UNIT}{H}", ("Width", "Depth", "Height")),
    (rf"(?i){NUM}\s*{W}{BY}{NUM}\s*{D}{BY}{NUM}\s*{H}", ("Width", "Depth", "Height")),
    (rf"(?i){NUM}\s*{W}{BY}{NUM}\s*{H}{BY}{NUM}\s*{D}", ("Width", "Height", "Depth")),
)
BARE = rf"(?i)(?:dimensions|size|measures?)\D{{0,40}}{NUM}{UNIT}(?:by|x|×)\s*{NUM}{UNIT}(?:by|x|×)\s*{NUM}"


def _entries(label: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))


def _clean_number(value: Column) -> Column:
    return dims.trim_zeros(value.try_cast("double"), 6)


def spoken_dimensions(turns: DataFrame) -> DataFrame:
    """Per call with a size: status complete / partial / conflict, the axes and the text; spoken numbers count."""
    turns = turns.withColumn("text", number_words(F.col("text")))
    text = F.col("text")
    found = [
        _entries(label, F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        for label, words in LABELS.items()
        for pattern in (
            rf"(?i)\b(?:{words})\b\s*(?:is|=|:|-)?\s*{NUM}",
            rf"(?i){NUM}{UNIT}\b(?:{words})\b",
        )
    ]
    found += [
        _entries(label, F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)))
        for pattern, labels in TRIPLES
        for i, label in enumerate(labels)
    ]
    bare = F.when(
        F.rlike(text, F.lit(BARE)),
        F.array(
            *[
                F.struct(F.lit("bare " + label).alias("label"), F.regexp_extract(text, BARE, i + 1).alias("value"))
                for i, label in enumerate(("Width", "Depth", "Height"))
            ]
        ),
    ).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
    values = (
        turns.select("conv_id", "turn", F.explode(F.concat(*found, bare)).alias("e"))
        .select("conv_id", "turn", "e.label", _clean_number(F.col("e.value")).alias("value"))
        .groupBy("conv_id", "label", "value")
        .agg(F.min("turn").alias("turn"))
    )
    sums = []
    for label in LABELS:
        for prefix, tag in (("", "n"), ("bare ", "b")):
            at = F.col("label") == prefix + label
            sums.append(F.count_if(at).alias(f"{tag}_{label}"))
            sums.append(F.min(F.when(at, F.struct("turn", "value")))["value"].alias(f"{tag}v_{label}"))
    per_call = values.groupBy("conv_id").agg(*sums)
    any_label = sum(F.col(f"n_{x}") for x in LABELS) > 0
    clash = F.lit(False)
    for x in LABELS:
        clash = clash | (F.col(f"n_{x}") > 1)
    axis = {
        x: F.when(any_label, F.when(F.col(f"n_{x}") == 1, F.col(f"nv_{x}"))).otherwise(F.col(f"bv_{x}")) for x in LABELS
    }
    out = per_call.select("conv_id", clash.alias("clash"), *[axis[x].alias(x.lower()) for x in LABELS])
    full = F.col("width").isNotNull() & F.col("depth").isNotNull() & F.col("height").isNotNull()
    status = F.when(F.col("clash"), F.lit("conflict")).when(full, F.lit("complete")).otherwise(F.lit("partial"))
    return out.select(
        "conv_id",
        status.alias("dimension_status"),
        *[F.when(~F.col("clash"), F.coalesce(x, F.lit(""))).otherwise(F.lit("")).alias(x) for x in ("width", "depth", "height")],
        F.when(
            ~F.col("clash") & full,
            F.concat("width", F.lit(" in W x "), "depth", F.lit(" in D x "), "height", F.lit(" in H")),
        ).otherwise(F.lit("")).alias("dimensions"),
    )


# How callers name a field.
ALIASES = {
    "Finish / Color": ("finish", "color"),
    "Material": ("material",),
    "Lead Time": ("lead time", "leadtime"),
    "Price": ("price", "cost"),
    "Model/SKU": ("model/sku", "model number", "sku", "model"),
    "Availability": ("availability", "available"),
    "Brand": ("brand", "manufacturer"),
    "Supplier": ("supplier", "vendor"),
    "Product Name": ("product name", "item name", "name"),
    "Product Category": ("category", "product category"),
    "Quantity": ("quantity", "qty"),
    "Room": ("location", "room"),
}
UNKNOWN = ("unknown", "not sure", "do not know", "don't know")


def simple_fields(turns: DataFrame, requested: tuple[str, ...]) -> DataFrame:
    """(conv_id, field, value, evidence): first alias that is answered, earliest turn."""
    text = F.col("text")
    hits = []
    for field in requested:
        for place, alias in enumerate(ALIASES[field]):
            pattern = rf"(?i)\b{re.escape(alias)}\b\s*(?:is|=|:|-)?\s*([^\n.;]+)"
            value = F.btrim(F.regexp_extract(text, pattern, 1), F.lit(" ,"))
            start = F.regexp_instr(text, F.lit(pattern))
            around = strip(F.substr(text, F.greatest(start - 120, F.lit(1)), F.lit(340)))
            hits.append(
                F.when(
                    (value != "") & ~F.lower(value).isin(*UNKNOWN),
                    F.struct(
                        F.lit(field).alias("field"),
                        F.lit(place).alias("place"),
                        value.alias("value"),
                        F.left(F.regexp_extract(around, r"(?s)^(.*?[.!?](?=\s)|.*)", 1), F.lit(240)).alias("evidence"),
                    ),
                )
            )
    rows = turns.select("conv_id", "turn", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    best = rows.groupBy("conv_id", "h.field").agg(
        F.min(F.struct("h.place", "turn", "h.value", "h.evidence")).alias("best")
    )
    return best.select("conv_id", "field", "best.value", "best.evidence")


def transcript_specs(turns: DataFrame, requested: tuple[str, ...]) -> DataFrame:
    """Long result (conv_id, field, value, confidence, evidence) with 'unresolved' rows for open fields.

    The whole size is always asked for.  Single axes are answered where requested: with high confidence
    from a complete size, with medium from a partial one; conflicting sizes answer nothing.
    """
    axes = [x for x in LABELS if x in requested]
    calls = turns.select("conv_id").distinct()
    simple = simple_fields(turns, tuple(x for x in requested if x not in LABELS)).select(
        "conv_id", "field", "value", F.lit("medium").alias("confidence"), "evidence"
    )
    entries = [F.struct(F.lit("Dimensions").alias("field"), F.col("dimensions").alias("value"))]
    entries += [
        F.struct(F.lit(x).alias("field"), F.concat(F.nullif(F.col(x.lower()), F.lit("")), F.lit(" in")).alias("value")) for x in axes
    ]
    sure = F.when(F.col("dimension_status") == "complete", F.lit("high")).otherwise(F.lit("medium"))
    found = (
        spoken_dimensions(turns)
        .filter("dimension_status <> 'conflict'")
        .select("conv_id", sure.alias("confidence"), F.inline(F.array(*entries)))
        .filter("value <> ''")
        .select("conv_id", "field", "value", "confidence", F.lit("").alias("evidence"))
    )
    every = simple.unionByName(found)
    wanted = calls.select("conv_id", F.explode(F.array(*[F.lit(x) for x in ("Dimensions", *requested)])).alias("field"))
    return wanted.join(every, ["conv_id", "field"], "left").select(
        "conv_id", "field", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("confidence", F.lit("unresolved")).alias("confidence"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


def assemble(turns: DataFrame) -> DataFrame:
    """Whole transcript as one text per call."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
        .select("conv_id", F.array_join(F.col("lines.line"), "\n").alias("transcript"), F.size("lines").alias("turns"))
    )


SOURCE_NOTE = "Filled from call transcript"


def apply_transcript(rows: DataFrame, specs: DataFrame, overwrite: bool = False) -> DataFrame:
    """Write answered fields into missing columns of the rows joined by ``conv_id``.

    Existing values are replaced only with ``overwrite`` and high or medium confidence.  Material, lead time and
    availability go into the notes where these are blank (or may be replaced).  Rows that took a value get a source note and the evidence of
    every value; ``applied`` names the columns.  Of several answers to one field the surest counts, then the largest text.
    """
    target = {
        "Dimensions": "dimensions", "Finish / Color": "finish_color", "Model/SKU": "model_sku", "Brand": "brand",
        "Supplier": "supplier", "Product Name": "product_name", "Product Category": "category", "Room": "room", "Price": "price",
    }
    noted = {"Material": "material", "Lead Time": "lead_time", "Availability": "availability"}
    sure = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    proof = F.col("evidence") if "evidence" in specs.columns else F.lit("")
    answer = F.struct(sure.alias("sure"), "value", proof.alias("evidence"))
    wide = specs.filter((F.col("confidence") != "unresolved") & (strip(F.col("value")) != "")).groupBy("conv_id").agg(
        *[F.max(F.when(F.col("field") == x, answer)).alias(f"said_{c}") for x, c in (target | noted).items()]
    )
    j = rows.join(wide, "conv_id", "left")

    def takes(c: str, missing: Column) -> Column:
        said = F.col(f"said_{c}")
        return said.isNotNull() & (missing | (F.lit(overwrite) & (said["sure"] > 0)))

    use = {c: takes(c, ~dims.has_complete_3d(F.col("dimensions")) if c == "dimensions" else strip(F.col(c)) == "") for c in target.values()}
    note = {c: takes(c, strip(F.col("notes")) == "") for c in noted.values()}
    both = list(zip([*target, *["Notes"] * len(noted)], [*use, *note], [*use.values(), *note.values()], strict=True))
    names = [F.when(u, F.lit(c)) for c, u in use.items()] + [F.when(F.exists(F.array(*note.values()), lambda u: u), F.lit("notes"))]
    applied = F.array_join(F.array_compact(F.array(*names)), ", ")
    added = [F.when(note[c], F.concat(F.lit(f"{x}: "), F.col(f"said_{c}.value"))) for x, c in noted.items()]
    proofs = [
        F.when(u & (strip(F.col(f"said_{c}.evidence")) != ""), F.concat(F.lit(f"{x} evidence: "), strip(F.col(f"said_{c}.evidence")))) for x, c, u in both
    ]
    own = F.concat_ws("\n", F.nullif(strip(F.col("notes")), F.lit("")), *added)
    told = F.when(~F.contains(own, F.lit(SOURCE_NOTE)), F.lit(SOURCE_NOTE))
    full = F.concat_ws("\n", F.nullif(own, F.lit("")), told, *proofs)
    out = j.withColumn("applied", applied).withColumn("_notes", F.when(applied != "", full).otherwise(F.col("notes")))
    values = {c: F.when(u, F.col(f"said_{c}.value")).otherwise(F.col(c)) for c, u in use.items()}
    return out.withColumns({**values, "notes": F.col("_notes")}).drop("_notes", *[f"said_{c}" for c in (target | noted).values()])
