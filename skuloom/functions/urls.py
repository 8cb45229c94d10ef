"""URL rules as column expressions.

URLs are split with one RFC 3986 pattern instead of ``parse_url``: that function
rejects texts (``https://[bad``) and loses parts the rules look at.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom.functions.text import clean, contains_any, flags_to_list, keep_first, let, norm_token, strip

URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
# Fixed value: a well-formed host name.
HOST_PATTERN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 2))


def path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 3))


def query_part(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 4)


def host(url: Column) -> Column:
    """Lower-case host without credentials and port (bracketed IPv6 without brackets)."""
    return let(
        F.regexp_replace(netloc(url), r"^.*@", ""),
        lambda bare: F.when(F.startswith(bare, F.lit("[")), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_replace(bare, r":.*$", "")
        ),
    )


def strip_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


# Most links: http or https, a host of plain letters with a dot, no whitespace.  None of the reasons below holds for them.
PLAIN_URL = r"^https?://[a-z0-9-]+\.[a-z0-9.-]+(?:[/?#]\S*)?\z"


def url_problem(url: Column) -> Column:
    """Why a URL must not be fetched; blank when it may."""
    raw = strip(url)
    judged = let(
        F.struct(raw.alias("raw"), netloc(raw).alias("loc"), host(raw).alias("name"), scheme(raw).alias("proto")),
        _judge_url,
    )
    return F.when(F.rlike(raw, F.lit(PLAIN_URL)), F.lit("")).otherwise(judged)


def _judge_url(part: Column) -> Column:
    loc, name, proto = part["loc"], part["name"], part["proto"]
    odd_bracket = F.contains(loc, F.lit("[")) != F.contains(loc, F.lit("]"))
    return keep_first(
        [
            (part["raw"] == "", "empty URL"),
            (F.rlike(part["raw"], F.lit(r"\s")), "malformed URL: contains whitespace"),
            (odd_bracket, "Invalid IPv6 URL: Invalid IPv6 URL"),
            (
                ~proto.isin("http", "https"),
                F.concat(
                    F.lit("malformed URL: unsupported scheme "),
                    F.when(proto == "", F.lit("<missing>")).otherwise(proto),
                ),
            ),
            ((loc == "") | (name == ""), "malformed URL: missing host"),
            ((name == "localhost") | F.contains(name, F.lit(":")), ""),
            (F.rlike(name, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$")), ""),
            (
                ~F.rlike(name, F.lit(r"^[a-z0-9.-]+$")) | ~F.contains(name, F.lit(".")),
                F.concat(F.lit("malformed domain: "), name),
            ),
        ]
    )


def is_fetchable(url: Column) -> Column:
    return url_problem(url) == ""


def _with_scheme(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("://")), value).otherwise(F.concat(F.lit("https://"), value))


def clean_domain(value: Column) -> Column:
    """Validated host without ``www.``; null when it is no valid host name."""
    name = strip_www(host(_with_scheme(F.lower(strip(value)))))
    return F.when(F.rlike(name, F.lit(HOST_PATTERN)) & (F.length(name) <= 253), name)


def memory_domain(value: Column) -> Column:
    """Looser host rule of the source memory; blank when it does not hold."""
    name = strip_www(host(_with_scheme(F.lower(strip(value)))))
    ok = F.contains(name, F.lit(":")) | F.rlike(name, F.lit(r"^[a-z0-9.-]+\.[a-z]{2,63}$"))
    return F.when(ok, name).otherwise(F.lit(""))


def url_domain(url: Column) -> Column:
    """Domain of a full URL, as the source memory keeps it."""
    loc = netloc(strip(url))
    return F.when(loc == "", F.lit("")).otherwise(memory_domain(loc))


def site(url: Column) -> Column:
    """Network location without ``www.`` (used for ranking)."""
    return strip_www(netloc(strip(url)))


def host_suffixes(domain: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: turns 'equal or sub-domain' into an equi-join."""
    labels = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def in_domains(domain: Column, names) -> Column:
    """Domain equals one of the fixed names or is below it: one pattern, no arrays per row."""
    listed = "|".join(re.escape(n) for n in sorted(names))
    return F.rlike(domain, F.lit(rf"(?:^|\.)(?:{listed})\z"))


def is_pdf(url: Column) -> Column:
    return F.endswith(F.lower(F.regexp_extract(clean(url), r"^([^?#]*)", 1)), F.lit(".pdf"))


# Fixed value: path words of pages that are no product page.
WEAK_PATH = (
    r"(?:^|/)(?:sitemap|product-sitemap|search|category|categories|collections?|browse|tag|blog|support)(?:/|$)"
)


def export_url_problem(url: Column, model: Column) -> Column:
    """Export variant: a category path is fine when the URL carries the model."""
    raw = clean(url)
    token = norm_token(model)
    named = (token != "") & F.contains(norm_token(raw), token)
    asks = F.contains(raw, F.lit("?")) & F.rlike(query_part(raw), F.lit(r"(?i)(?:^|&)(?:q|query|search)=[^&]"))

    def judge(where: Column) -> Column:
        return keep_first(
            [
                (F.contains(where, F.lit("sitemap")), "sitemap/category URL rejected"),
                (F.contains(where, F.lit("search")) | asks, "search URL rejected"),
                (
                    F.rlike(F.concat(F.lit("/"), where, F.lit("/")), F.lit(WEAK_PATH)) & ~named,
                    "category/browse URL rejected",
                ),
            ]
        )

    return F.when(raw == "", F.lit("")).otherwise(let(F.btrim(path(raw), F.lit("/")), judge))


# File endings of images and of other content.
IMAGE_ENDINGS = r"\.(?:jpg|jpeg|png|webp|gif|bmp)$"
OTHER_ENDINGS = r"\.(?:html|htm|php|asp|aspx|cfm|pdf|txt|xml)$"


def is_image_url(url: Column) -> Column:
    """https and an image ending, or no ending in the last path segment."""
    low = F.lower(clean(url))
    bare = F.regexp_extract(low, r"^([^?#]*)", 1)
    last = F.regexp_extract(F.rtrim(bare, F.lit("/")), r"([^/]*)$", 1)
    return F.startswith(low, F.lit("https://")) & (
        F.rlike(bare, F.lit(IMAGE_ENDINGS))
        | (~F.rlike(bare, F.lit(OTHER_ENDINGS)) & ~F.contains(last, F.lit(".")))
    )


def is_https(url: Column) -> Column:
    return F.startswith(F.lower(strip(url)), F.lit("https://"))


# Text that rules a URL out of notes.
URL_NOISE = ("traceback", "invalid ipv6", "api key", "secret")


def first_url(col: Column) -> Column:
    text = clean(col)
    found = F.regexp_extract(text, r"(?i)(https?://[^\s,)\]\"']+)", 1)
    best = F.rtrim(F.when(found != "", found).otherwise(text), F.lit(".,;"))

    def check(url: Column) -> Column:
        plain = ~F.contains(url, F.lit("[")) & ~F.contains(url, F.lit("]"))
        ok = (
            F.rlike(url, F.lit(r"(?i)^https?://[^/?#]"))
            & (plain | (F.contains(netloc(url), F.lit("[")) == F.contains(netloc(url), F.lit("]"))))
            & ~contains_any(F.lower(url), URL_NOISE)
        )
        return F.when(ok, url).otherwise(F.lit(""))

    return F.when(text == "", F.lit("")).otherwise(let(best, check))


def first_url_of(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(first_url(c), F.lit("")) for c in cols], F.lit(""))


def join_url(base: Column, raw: Column) -> Column:
    """Resolve absolute, ``//host``, ``/path`` and plain relative links."""
    link = strip(raw)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(plain) > F.length(origin), F.regexp_extract(plain, r"^(.*/)", 1)).otherwise(
        F.concat(origin, F.lit("/"))
    )
    absolute = (
        F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link))
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link)
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.rlike(link, F.lit(r"^[?#]")), F.concat(plain, link))
        .otherwise(F.concat(folder, link))
    )
    return let(absolute, lambda u: F.when((link != "") & is_fetchable(u), u).otherwise(F.lit("")))


# Shops that are not the manufacturer.
RETAILERS = (
    "ajmadison.com", "appliancesconnection.com", "bestbuy.com", "build.com",
    "designerappliances.com", "ferguson.com", "homedepot.com", "lowes.com",
    "perigold.com", "wayfair.com",
)


def export_domain(url: Column) -> Column:
    return strip_www(host(first_url(url)))


def is_retailer(url: Column) -> Column:
    return in_domains(export_domain(url), RETAILERS)


def domain_below(domain: Column, parent: Column) -> Column:
    """Row-wise 'equal or below' test for two columns of the same row."""
    return (domain != "") & (parent != "") & (
        (domain == parent) | F.endswith(domain, F.concat(F.lit("."), parent))
    )


def rejected_fields(fields: dict) -> Column:
    """``name=value`` of every URL field that is filled but not fetchable."""
    return flags_to_list(
        [
            ((strip(c) != "") & ~is_fetchable(c), F.concat(F.lit(f"{name}="), c))
            for name, c in fields.items()
        ]
    )


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
