"""Dimension text rules: labels, numbers, plausibility, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom.functions.text import clean, keep_first, let, strip

AXES = ("width", "height", "depth", "length")
# Number forms and axis words of dimension texts.
NUMBER = r"\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?"
WHOLE_NUMBER = r"\d++\s++\d++/\d++|\d++/\d++|\d++(?:\.\d++)?+"
UNIT = r"(?:[\"“”″'\s]|\bin(?:ches)?\b)*+"
LETTER = {"width": "Ww", "height": "Hh", "depth": "Dd", "length": "Ll"}
WORDS = {
    "width": "width|wide|w",
    "height": "height|high|h",
    "depth": "depth|deep|d",
    "length": "length|long|l",
}


def axis_forms(axis: str) -> tuple[str, str]:
    """Patterns of ``36"W`` and ``Width 36``.

    Nothing that a number or a unit takes can begin what follows it, so neither is given back and tried again shorter.
    """
    number_first = rf"(?<!\d)({WHOLE_NUMBER}){UNIT}[{LETTER[axis]}](?![a-zA-Z])"
    return number_first, rf"(?i)(?=[{LETTER[axis]}])\b(?:{WORDS[axis]})\b\s*(?:[:=]|is|of)?\s*({NUMBER})"


def axis_text(text: Column, axis: str) -> Column:
    """Value of one axis as written: ``36"W`` first, then ``Width 36``."""
    number_first, word_first = axis_forms(axis)
    return F.coalesce(
        F.nullif(F.regexp_extract(text, number_first, 1), F.lit("")),
        F.regexp_extract(text, word_first, 1),
        F.lit(""),
    )


def _axis_once(text: Column, axis: str) -> Column:
    """``axis_text`` whose first form is searched once, also where it is found."""
    number_first, word_first = axis_forms(axis)
    found = F.regexp_extract(text, number_first, 1)
    return F.coalesce(let(found, lambda v: F.when(v != "", v).otherwise(F.regexp_extract(text, word_first, 1))), F.lit(""))


def _axis_tests(letters: str, words: str) -> str:
    """Pattern of texts in which one of the axes can be read: only the last digit of a number matters."""
    return rf"\d{UNIT}[{letters}](?![a-zA-Z])|(?i)(?=[{letters}])\b(?:{words})\b\s*(?:[:=]|is|of)?\s*\d"


# Fixed value: any form of any axis.
ANY_AXIS = _axis_tests("".join(LETTER.values()), "|".join(WORDS.values()))


def has_axis(text: Column, axis: str) -> Column:
    """Whether ``axis_text`` finds a value."""
    return F.coalesce(F.rlike(text, F.lit(_axis_tests(LETTER[axis], WORDS[axis]))), F.lit(False))


def parse_dims(dims: Column) -> Column:
    """Struct of the four axes, as text."""

    def read(text: Column) -> Column:
        none = F.struct(*[F.lit("").alias(axis) for axis in AXES])
        return F.when(F.rlike(text, F.lit(ANY_AXIS)), F.struct(*[_axis_once(text, axis).alias(axis) for axis in AXES])).otherwise(none)

    return let(strip(dims), read)


def complete_3d(parsed: Column) -> Column:
    return (parsed["width"] != "") & (parsed["height"] != "") & (parsed["depth"] != "")


def has_complete_3d(dims: Column) -> Column:
    text = clean(dims)
    return has_axis(text, "width") & has_axis(text, "height") & has_axis(text, "depth")


def axis_count(parsed: Column) -> Column:
    return sum(F.when(parsed[a] != "", 1).otherwise(0) for a in ("width", "height", "depth"))


def to_number(value: Column) -> Column:
    """``14 7/8`` or ``7/8`` or ``29.5`` as double; null when unreadable."""

    def read(text: Column) -> Column:
        whole = F.coalesce(F.regexp_extract(text, r"^(\d+)\s", 1).try_cast("double"), F.lit(0.0))
        top = F.regexp_extract(text, r"(\d+)/", 1).try_cast("double")
        bottom = F.regexp_extract(text, r"/(\d+)$", 1).try_cast("double")
        fraction = F.contains(text, F.lit("/")) & F.rlike(text, F.lit(r"^(?:\d+\s+)?\d+/\d+$"))
        return F.when(fraction, whole + top / F.nullif(bottom, F.lit(0.0))).otherwise(text.try_cast("double"))

    return let(strip(value), read)


def trim_zeros(number: Column, places: int) -> Column:
    """Fixed-point text without trailing zeros."""
    text = F.format_string(f"%.{places}f", number)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def decimal_text(value: Column, places: int = 6) -> Column:
    """Fractions as decimal text with ``places`` digits (6 for lookups, 4 for import); others unchanged."""

    def show(text: Column) -> Column:
        as_text = let(to_number(text), lambda n: F.when(n.isNull(), text).otherwise(trim_zeros(n, places)))
        return F.when(F.rlike(text, F.lit(r"^(?:\d+\s+)?\d+/\d+$")), as_text).otherwise(text)

    return let(strip(value), show)


def unit_name(unit: Column) -> Column:
    text = F.lower(strip(unit))
    return (
        F.when(text.isin("cm", "mm"), text)
        .when(text.isin('"', "“", "”", "″", "'", "in", "inch", "inches"), F.lit("in"))
        .otherwise(F.lit(""))
    )


def inches_text(value: Column, unit: Column) -> Column:
    """Value in inches, three places when converted from cm or mm."""
    parts = F.struct(to_number(value).alias("n"), unit_name(unit).alias("u"), strip(value).alias("t"))
    return let(
        parts,
        lambda p: F.when(p["n"].isNull(), p["t"])
        .when(p["u"] == "cm", trim_zeros(p["n"] / F.lit(2.54), 3))
        .when(p["u"] == "mm", trim_zeros(p["n"] / F.lit(25.4), 3))
        .otherwise(p["t"]),
    )


# Plausible appliance sizes in inches.
APPLIANCE_BOUNDS = {"width": (6, 96), "height": (3, 120), "depth": (6, 60), "length": (3, 120)}
LARGEST = 300


# Words of sizes that are not the product's.
BOX_WORDS = r"(?=[bcps])\b(shipping|package|packaged|carton|box)\b"
HOLE_WORDS = r"(?=[cor])\b(cutout|rough[- ]?in|opening|clearance)\b"


def _says(text: Column, words: str) -> Column:
    """Whether the lower-cased text has one of the words; plain ASCII texts need no lower-casing for that."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.rlike(text, F.lit("(?i)" + words))).otherwise(F.rlike(F.lower(text), F.lit(words)))


def _implausible(parsed: Column, category: Column) -> Column:
    """Why parsed numbers cannot be the product's size; blank when plausible."""
    appliance = F.contains(F.lower(F.coalesce(category, F.lit(""))), F.lit("appliance"))

    def judge(values: Column, known: Column) -> Column:
        rules = [
            (F.size(known) == 0, ""),
            (F.array_min(known) <= 0, "non-positive dimension value"),
            (F.array_max(known) > LARGEST, "dimension exceeds plausible product bounds"),
            (~appliance, ""),
        ]
        for i, axis in enumerate(AXES):
            low_bound, high_bound = APPLIANCE_BOUNDS[axis]
            rules.append((values[i] < low_bound, f"{axis} below plausible appliance bounds"))
            rules.append((values[i] > high_bound, f"{axis} exceeds plausible appliance bounds"))
        rules.append(
            ((F.size(known) >= 3) & (F.array_max(known) < 6), "all appliance dimensions are implausibly small")
        )
        return keep_first(rules)

    numbers = F.array(*[F.when(parsed[a] != "", to_number(parsed[a])) for a in AXES])
    return let(numbers, lambda values: let(F.array_compact(values), lambda known: judge(values, known)))


def sanity_reason(dims: Column, category: Column) -> Column:
    """Why a dimension text cannot be the product's size; blank when plausible."""
    text = clean(dims)
    return keep_first(
        [
            (text == "", ""),
            (_says(text, BOX_WORDS), "shipping/package dimensions"),
            (_says(text, HOLE_WORDS), "cutout/opening dimensions"),
            (F.lit(True), let(parse_dims(text), lambda p: _implausible(p, category))),
        ]
    )


def whd_text(parsed: Column) -> Column:
    return F.concat(
        parsed["width"], F.lit('"W x '), parsed["height"], F.lit('"H x '), parsed["depth"], F.lit('"D')
    )


def export_text(dims: Column, reason: Column) -> Column:
    """W x H x D only; blank when the dimensions were rejected."""
    text = clean(dims)
    shown = let(parse_dims(text), lambda p: F.when(complete_3d(p), whd_text(p)).otherwise(text))
    return F.when(reason != "", F.lit("")).otherwise(shown)


def export_dims(dims: Column, category: Column) -> Column:
    """``export_text`` with the reason of ``sanity_reason``: the text is parsed once for both."""

    def shown(p: Column, text: Column) -> Column:
        return F.when(_implausible(p, category) != "", F.lit("")).when(complete_3d(p), whd_text(p)).otherwise(text)

    def read(text: Column) -> Column:
        return F.when((text == "") | _says(text, BOX_WORDS) | _says(text, HOLE_WORDS), F.lit("")).otherwise(let(parse_dims(text), lambda p: shown(p, text)))

    return let(clean(dims), read)


def confidence_from_axes(dims: Column, domain_score: Column) -> Column:
    """Label by number of axes and domain score."""
    full = F.when(domain_score >= 80, F.lit("high")).otherwise(F.lit("medium"))
    return let(
        axis_count(parse_dims(dims)),
        lambda n: F.when(n >= 3, full).when(n == 2, F.lit("medium")).when(n == 1, F.lit("low")).otherwise(F.lit("")),
    )
