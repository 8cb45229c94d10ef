"""Text normalisation as column expressions.

Blank policy of the whole library: adapters turn null and the words nan / none /
null into the empty string, so operators only test for ``''``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def strip(col: Column) -> Column:
    """Trim every kind of whitespace (``trim`` alone removes spaces only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def tidy(col: Column) -> Column:
    """Blank policy, applied once by the source adapters: null, nan, none, null -> ``''``."""
    text = strip(F.coalesce(col, F.lit("")))
    return F.when(F.lower(text).isin("nan", "none", "null"), F.lit("")).otherwise(text)


# Inside the library columns are already tidy, so rules only trim.
clean = strip


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose values are computed once per row, whatever filters follow.

    A condition on a plain computed column is moved below it, where the whole expression is evaluated again, and inside it
    every column it refers to, as often as it does.  Generated columns are not looked through.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def is_blank(col: Column) -> Column:
    return clean(col) == ""


def has(col: Column) -> Column:
    return clean(col) != ""


def first_filled(*cols: Column) -> Column:
    """First value that is not blank, else ``''``."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def norm_token(col: Column) -> Column:
    """Lower case with everything but ``a-z0-9`` removed."""
    return F.regexp_replace(F.lower(clean(col)), "[^a-z0-9]+", "")


def norm_text(col: Column) -> Column:
    """Lower case with other characters collapsed to one space."""
    return F.btrim(F.regexp_replace(F.lower(clean(col)), "[^a-z0-9]+", " "))


def squeeze(col: Column) -> Column:
    return F.btrim(F.regexp_replace(col, r"\s+", " "))


def title_case(col: Column) -> Column:
    """Capital after every non-letter, as in ``Half-Bath O'Neil 2Nd Floor``."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda x: F.concat(
                F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))
            ),
        ),
        "",
    )


def contains_any(col: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(n)) for n in needles])


def keep_first(pairs) -> Column:
    """``[(condition, value), ...]`` -> value of the first true condition, else ``''``."""
    (cond, value), *rest = pairs
    out = F.when(cond, lit(value))
    for cond, value in rest:
        out = out.when(cond, lit(value))
    return out.otherwise(F.lit(""))


def flags_to_list(pairs) -> Column:
    """``[(condition, label), ...]`` -> array of the labels whose condition holds."""
    return F.array_compact(
        F.array(*[F.when(cond, lit(label)) for cond, label in pairs])
    )


def add_points(pairs) -> Column:
    """Sum of the weights whose condition holds."""
    return reduce(
        lambda a, b: a + b,
        [F.when(cond, lit(points)).otherwise(F.lit(0)) for cond, points in pairs],
    )


def join_list(arr: Column, sep: str = ", ") -> Column:
    return F.array_join(arr, sep)


def distinct_ci(arr: Column) -> Column:
    """Distinct ignoring case; the first spelling wins."""
    return F.aggregate(
        arr,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc
        ).otherwise(F.array_append(acc, x)),
    )


# Fixed value: the leading row label removed from notes.
ROW_PREFIX = r"(?i)^\s*(?:row\s*)?#?\d{1,3}\s*[-–—:.)]\s+(?=[A-Za-z\[\(\"'])"
# Fixed value: words of technical noise that drop a note line.
NOISE_WORDS = (
    r"(?i)\b(?:invalid ipv6|traceback|stack trace|api key|secret|token|httpx|exception)\b"
)
# Fixed value: the source summary at the end of notes.
SOURCE_BLOCK = (
    r"(?is)(?:\n{2,})?(?:Source links:\n.*|No verified source found during enrichment\.)\s*$"
)


def drop_row_prefix(col: Column) -> Column:
    return strip(F.regexp_replace(strip(col), ROW_PREFIX, ""))


def clean_notes(col: Column) -> Column:
    """Notes without system tags, source summary, technical lines and row label."""
    text = F.regexp_replace(clean(col), r"\[[^\]]*\]", "")
    text = F.regexp_replace(text, SOURCE_BLOCK, "")
    parts = F.filter(
        F.split(text, r"[\r\n]+"),
        lambda p: (strip(p) != "") & ~F.rlike(p, F.lit(NOISE_WORDS)),
    )
    joined = F.array_join(F.transform(parts, strip), " ")
    return drop_row_prefix(F.regexp_replace(joined, r"\s{2,}", " "))


def material_tag(col: Column) -> Column:
    return strip(F.regexp_extract(clean(col), r"(?i)\[Materials:\s*([^\]]+)\]", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_stem_title(name: Column) -> Column:
    """File name to product name: ``side_table-01.jpg`` -> ``Side Table 01``."""
    base = F.when(strip(name) == "", F.lit("Photo item")).otherwise(name)
    words = squeeze(F.translate(file_stem(base), "_-", "  "))
    return F.coalesce(F.nullif(title_case(words), F.lit("")), F.lit("Photo Item"))


# Words that mark contact, source or transcript text.
NOTE_MARKERS = (
    "salesperson", "sales person", "contact", "phone", "email", "@", "transcript",
    "vendor call", "source", "scraped", "extraction", "confidence", "verify",
    "uncertain", "line 1", "line 2", "http://", "https://",
)


def looks_like_notes(col: Column) -> Column:
    text = strip(col)
    lines = F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n"))
    return (text != "") & (
        contains_any(F.lower(text), NOTE_MARKERS) | (lines > 2) | (F.length(text) > 350)
    )


# Words that make a finish a colour.
COLOR_WORDS = (
    "white", "black", "gray", "grey", "silver", "blue", "green", "red", "yellow",
    "orange", "brown", "beige", "cream", "ivory", "tan", "taupe", "gold", "bronze",
    "copper", "nickel", "brass",
)


def color_of_finish(col: Column) -> Column:
    text = strip(col)
    pattern = r"\b(?:" + "|".join(COLOR_WORDS) + r")\b"
    return F.when(F.rlike(F.lower(text), F.lit(pattern)), text).otherwise(F.lit(""))


# Fixed value: words that mark the evidence part of a page.
EVIDENCE_WORDS = (
    r"(?i)\b(?:dimensions?|overall|product dimensions?|width|height|depth|w\s*[x×]\s*h\s*[x×]\s*d|"
    r"w\s*[x×]\s*d\s*[x×]\s*h|specifications?|spec sheet|image|gallery)\b"
)


def plain_text(col: Column) -> Column:
    """Markup and control characters out, whitespace squeezed."""
    text = clean(col)
    text = F.when(
        F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")),
        F.regexp_replace(text, r"<[^>]*>", " "),
    ).otherwise(text)
    return squeeze(F.regexp_replace(text, r"[\x00-\x1f]", " "))


def snippet(text: Column, needles: list[Column], lead: int = 250, size: int = 1100) -> Column:
    """Window around the earliest hit of a needle or evidence word (whole text searched)."""
    low = F.lower(text)
    spots = [
        F.when(n != "", F.nullif(F.position(F.lower(n), low), F.lit(0))) for n in needles
    ]
    spots.append(F.nullif(F.regexp_instr(text, F.lit(EVIDENCE_WORDS)), F.lit(0)))
    hit = F.coalesce(F.array_min(F.array_compact(F.array(*spots))), F.lit(1))
    start = F.greatest(hit - F.lit(lead), F.lit(1))
    return squeeze(F.substr(text, start, F.lit(size)))


# Numbers that may never be called.
EMERGENCY = ("911", "112", "999", "000")


def phone_problem(col: Column) -> Column:
    """Reason a phone number is refused (E.164 wanted); blank when fine."""
    phone = strip(col)
    return keep_first(
        [
            (phone == "", "Phone number is required."),
            (F.regexp_replace(phone, r"\D", "").isin(*EMERGENCY), "Emergency numbers cannot be called."),
            (
                ~F.rlike(phone, F.lit(r"^\+[1-9]\d{7,14}$")),
                "Enter a phone number in E.164 format, for example +12223334444.",
            ),
        ]
    )
