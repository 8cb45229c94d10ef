"""Search-result candidates: weak pages, domain scores, ranking, query generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions import dims, lookups, urls
from skuloom.functions.text import flags_to_list, keep_first, let, norm_token, staged, strip
from skuloom.operators.keyed import first_per, top_per


def weak_page_reason(url: Column) -> Column:
    """Enrichment variant: why a link is no product page (a blank link is weak, too)."""
    raw = strip(url)
    problem = urls.url_problem(raw)

    def judge(where: Column) -> Column:
        asks = F.contains(raw, F.lit("search=")) & F.rlike(urls.query_part(raw), F.lit(r"(?:^|&)search=[^&]"))
        return keep_first(
            [
                (where == "", "homepage"),
                (F.contains(where, F.lit("sitemap")), "sitemap page"),
                (F.endswith(where, F.lit(".pdf")), "spec PDF, not product page"),
                (F.contains(where, F.lit("/search")) | asks, "search result page"),
                (
                    F.rlike(where, F.lit(r"(?=[bcst])\b(?:sitemap|search|category|collections?|browse|tag|blog|support)$")),
                    "category/browse page",
                ),
            ]
        )

    return let(
        problem,
        lambda p: F.when(p != "", p).otherwise(let(F.btrim(urls.path(raw), F.lit("/")), judge)),
    )


def fixed_brand_sites(spark) -> DataFrame:
    """The fixed brand table as rows (brand_key, site_rank, domain)."""
    rows = [(b, i, d) for b, names in lookups.BRAND_SOURCES.items() for i, d in enumerate(names)]
    return spark.createDataFrame(rows, "brand_key string, site_rank int, domain string")


def with_brand_sites(df: DataFrame, sites: DataFrame, brand: str = "brand") -> DataFrame:
    """Add ``official``: the brand's sites in order of preference (empty when unknown)."""
    lists = (
        sites.groupBy("brand_key")
        .agg(F.array_sort(F.collect_set(F.struct("site_rank", "domain"))).alias("_sites"))
        .select("brand_key", F.col("_sites.domain").alias("official"))
    )
    keyed = df.withColumn("brand_key", norm_token(F.col(brand)))
    return keyed.join(lists, "brand_key", "left").withColumn(
        "official", F.coalesce("official", F.array().cast("array<string>"))
    )


def site_position(domain: Column, official: Column) -> Column:
    """Index of the first official site that equals the domain or is above it; null if none."""
    return let(
        urls.host_suffixes(domain),
        lambda names: F.array_min(
            F.array_compact(F.transform(official, lambda site, i: F.when(F.array_contains(names, site), i)))
        ),
    )


def brand_site_score(domain: Column, official: Column) -> Column:
    """70 for the first official site, 8 less per place, at least 35; low-priority sites lose 25."""
    bonus = let(
        site_position(domain, official),
        lambda i: F.when(i.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(35), F.lit(70) - i * 8)),
    )
    low = F.when(urls.in_domains(domain, lookups.LOW_PRIORITY_SITES), 25).otherwise(0)
    return F.when(domain == "", F.lit(0)).otherwise(bonus - low)


def domain_score(domain: Column, brand: Column, official: Column) -> Column:
    """0..100 trust of a result's domain; low priority counts twice, as in the rule it restates."""
    slug = F.translate(F.lower(brand), " -", "")
    low = F.when(urls.in_domains(domain, lookups.LOW_PRIORITY_SITES), 25).otherwise(0)
    liked = F.when(urls.in_domains(domain, lookups.PREFERRED_SITES), 20).otherwise(0)
    named = F.when((slug != "") & F.contains(F.translate(domain, "-.", ""), slug), 40).otherwise(0)
    raw = F.lit(50) + brand_site_score(domain, official) + named + liked - low
    return F.when(urls.in_domains(domain, lookups.SKIPPED_SITES), F.lit(0)).otherwise(
        F.least(F.lit(100), F.greatest(F.lit(0), raw))
    )


def score_results(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Valid results with ``domain``, ``official`` and ``domain_score``."""
    valid = results.filter(urls.is_fetchable(F.col("url")))
    rows = with_brand_sites(valid, sites).withColumn("domain", urls.site(F.col("url")))
    return rows.withColumn("domain_score", domain_score(F.col("domain"), F.col("brand"), F.col("official")))


def best_results(scored: DataFrame, k: int = 5) -> DataFrame:
    """Top results per product by domain score."""
    return top_per(scored, ["product_id"], [F.desc("domain_score"), F.asc("result_ordinal")], k, "position")


def distinct_results(scored: DataFrame) -> DataFrame:
    """First result per product and URL."""
    return first_per(scored, ["product_id", "url"], [F.asc("result_ordinal")])


# Words of specification pages.
SPEC_WORDS = ("dimension", "specification", "spec-sheet", "spec sheet", "installation", ".pdf")


def rank_columns(c) -> dict[str, Column]:
    text = F.concat_ws(" ", c["url"], c["title"], c["description"])
    model = norm_token(c["model_sku"])
    spec = urls.any_of([F.contains(F.lower(text), F.lit(w)) for w in SPEC_WORDS])
    return {
        "sku_hit": F.when((model != "") & F.contains(norm_token(text), model), 1).otherwise(0),
        "official_hit": F.when(site_position(c["domain"], c["official"]).isNotNull(), 1).otherwise(0),
        "spec_hit": F.when(spec, 1).otherwise(0),
        "brand_score": brand_site_score(c["domain"], c["official"]),
        "weak": F.when(weak_page_reason(c["url"]) != "", -1).otherwise(0),
        "low_priority": F.when(urls.in_domains(c["domain"], lookups.LOW_PRIORITY_SITES), -1).otherwise(0),
    }


RANK_ORDER = ("sku_hit", "official_hit", "spec_hit", "brand_score", "domain_score", "weak", "low_priority")


def rank_candidates(scored: DataFrame, k: int = 3) -> DataFrame:
    """Distinct candidates, best ``k`` per product by the seven-part key."""
    rows = distinct_results(scored)
    rows = rows.withColumns(rank_columns(rows))
    order = [F.desc(x) for x in RANK_ORDER] + [F.asc("result_ordinal")]
    return top_per(rows, ["product_id"], order, k, "position")


def top_json(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Best candidates of a product as one JSON text (``position`` must be bounded by ``k``)."""
    entry = F.struct("position", "url", "title", "domain_score")
    return (
        ranked.filter(F.col("position") <= k)
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("_list"))
        .select(
            "product_id",
            F.to_json(
                F.transform(
                    "_list", lambda e: F.struct(e["url"].alias("url"), e["title"].alias("title"), e["domain_score"].alias("domain_score"))
                )
            ).alias("candidates"),
        )
    )


# ------------------------------------------------------------------ domain tables


def match_domains(df: DataFrame, row: str, domain: str, table: DataFrame) -> DataFrame:
    """Rows with the listed domain that equals theirs or is above it: an equi-join on host suffixes.

    ``table`` has the column ``listed``.  One-label suffixes (``com``) cannot be listed and are skipped.
    """
    suffix = df.select(
        row, F.explode(F.filter(urls.host_suffixes(F.col(domain)), lambda s: F.contains(s, F.lit(".")))).alias("listed")
    )
    hits = suffix.join(table.select("listed").distinct(), "listed")
    return hits.groupBy(row).agg(F.max(F.struct(F.length("listed"), "listed"))["listed"].alias("listed"))


# ------------------------------------------------------------------ models and queries


def model_variants(model: Column, strict: bool = True) -> Column:
    """Spellings of a model number, most literal first.

    Two versions exist: the page lookup (``strict=True``) and the dimension lookup, which lists
    joined forms later and also cuts a plain letter ending (``HV48SS`` -> ``HV48``).
    """
    def parts(m: Column) -> Column:
        joined = F.regexp_replace(m, r"\s+", "")
        return F.struct(
            m.alias("m"), joined.alias("joined"), F.regexp_extract(joined, r"^([^/\\]*)", 1).alias("base"),
            F.regexp_extract(joined, r"([^/\\]*)$", 1).alias("ending"), F.rlike(joined, F.lit(r"[/\\]")).alias("slashed"),
        )

    def spell(p: Column) -> Column:
        m, joined, base, ending, slashed = (p[x] for x in ("m", "joined", "base", "ending", "slashed"))
        plain = F.regexp_replace(joined, r"[/\\]+", "")
        closed = F.regexp_replace(m, r"[-\s]+", "")
        dashed = F.regexp_replace(m, r"\s+", "-")
        short = slashed & (base != "") & (ending != "") & (F.length(ending) <= 3)
        rid = short & F.endswith(F.upper(base), F.lit("RID")) & F.upper(ending).isin("R", "L")
        ident = short & ~rid & F.endswith(F.upper(base), F.lit("ID")) & (F.length(ending) == 1)
        by_slash = [
            F.when(slashed, base),
            F.when(short, F.concat(base, ending)),
            F.when(rid, F.concat(F.left(base, F.length(base) - 3), ending)),
            F.when(ident, F.left(base, F.length(base) - 2)),
        ]
        cut = F.when(
            F.rlike(m, F.lit(r"[-\s][^-\s]{1,3}$")),
            F.regexp_replace(F.regexp_replace(m, r"[^-\s]{1,3}$", ""), r"[ \-]+$", ""),
        )
        if strict:
            forms = [m, joined, plain, closed, dashed, *by_slash, cut]
        else:
            simple = F.nullif(F.regexp_extract(m, r"^([A-Za-z]+\d+)[A-Za-z]{1,3}$", 1), F.lit(""))
            forms = [m, joined, plain, *by_slash, dashed, closed, F.coalesce(cut, simple)]
        return F.filter(F.array_distinct(F.array_compact(F.array(*forms))), lambda v: v != "")

    return let(let(strip(model), parts), spell)


def _quoted(*parts) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit('"'), p, F.lit('"')) for p in parts])


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def page_queries(c) -> Column:
    """Lookup texts for product pages, in order, each once; the texts of ``c`` are trimmed."""
    brand, model, name, category = (c[x] for x in ("brand", "model_sku", "product_name", "category"))
    sites, variants = c["official"], c["variants"]
    first = F.get(sites, F.lit(0))
    some = F.slice(variants, 1, 5)
    clause = F.when(F.size(some) == 1, _quoted(F.get(some, F.lit(0)))).otherwise(
        _say("(", F.array_join(F.transform(some, lambda v: _quoted(v)), " OR "), ")")
    )
    has_model, both = model != "", (brand != "") & (model != "")
    context = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(category, F.lit("")))
    queries = [
        (F.size(variants) > 0, _say("site:", first, " ", clause, " dimensions specifications spec sheet product"))
    ]
    for ending in (
        "product", "spec sheet PDF", "installation guide", "installation guide PDF", "dimensions",
        "specification", "specifications", '"Width" "Height" "Depth"',
    ):
        queries.append((has_model, _say("site:", first, ' "', model, '" ', ending)))
    for place in (1, 2):
        site = F.get(sites, F.lit(place))
        for ending in ("dimensions", "spec sheet PDF"):
            queries.append((has_model, _say("site:", site, ' "', model, '" ', ending)))
    queries.append(
        (
            (context != "") & (F.size(variants) > 0),
            _say("site:", first, " ", F.get(variants, F.lit(0)), " ", context, " dimensions"),
        )
    )
    for ending in (
        "dimensions", "specification", "specifications", "spec sheet PDF", "spec sheet pdf",
        "installation guide", "installation guide pdf", "product page",
    ):
        queries.append((both, _say(_quoted(brand, model), " ", ending)))
    queries.append((both, _say(_quoted(model), " PDF dimensions")))
    for place in (1, 2, 3):
        queries.append(
            (
                (brand != "") & (F.size(variants) > place),
                _say(_quoted(brand, F.get(variants, F.lit(place))), " dimensions specifications"),
            )
        )
    queries.append((both, _say(_quoted(brand, model), " dimensions image product page")))
    queries.append((both & (name != ""), _quoted(brand, model, name)))
    queries.append((both & (name != ""), _quoted(brand, name)))
    # Drops nulls and repeated texts, in order; unlike a filter of the array it is compiled.
    return F.array_except(F.array(*[F.when(cond, q) for cond, q in queries]), F.array(F.lit(None).cast("string")))


def dimension_queries(c) -> Column:
    """Lookup texts of the dimension search: official sites, brand, fallbacks."""
    brand, model, name = (strip(c[x]) for x in ("brand", "model_sku", "product_name"))
    sites = c["official"]
    first = F.get(sites, F.lit(0))
    out = [
        _say("site:", first, ' "', model, '" ', ending)
        for ending in ("dimensions", "specifications", "spec sheet", "installation guide", '"Width" "Height" "Depth"')
    ]
    for place in (1, 2):
        out += [
            _say("site:", F.get(sites, F.lit(place)), ' "', model, '" ', ending)
            for ending in ("dimensions", "spec sheet PDF")
        ]
    out += [
        _say(_quoted(brand, model), ' "dimensions"'),
        _say(_quoted(brand, model), ' "specifications"'),
        _say(_quoted(brand, model), " spec sheet PDF"),
        _say(_quoted(brand, model), " installation guide PDF"),
        F.when(name != "", _say(_quoted(brand, name), " dimensions")),
        _say(_quoted(brand, model), " dimensions"),
    ]
    return F.array_distinct(F.array_compact(F.array(*out)))


def plain_query(c, site: Column) -> Column:
    """One general lookup text; asks for dimensions when they are incomplete."""
    parts = F.concat_ws(
        " ", *[F.nullif(strip(c[x]), F.lit("")) for x in ("brand", "model_sku", "product_name")]
    )
    ending = F.when(
        dims.has_complete_3d(c["dimensions"]), F.lit(" specifications official")
    ).otherwise(F.lit(" dimensions width height depth spec sheet official"))
    body = F.concat(parts, ending)
    return F.when(site.isNotNull(), F.concat(F.lit("site:"), site, F.lit(" "), body)).otherwise(body)


def work_list(df: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per product row and lookup text."""
    texts = {x: strip(F.col(x)) for x in ("brand", "model_sku", "product_name", "category")}
    rows = with_brand_sites(df, sites).withColumns({**texts, "variants": model_variants(F.col("model_sku"))})
    # Spark drops empty lists before it explodes; of a plain column that test would build the list, and every part, once more.
    listed = staged(rows, {"queries": page_queries(rows)})
    return listed.select("row_id", F.posexplode("queries").alias("position", "query"))


def name_similarity(name: Column, text: Column) -> Column:
    """Whole points of 15: share of name words (4+ characters) found in the text."""
    words = F.filter(
        F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]{4,})"), F.lit(1)),
        lambda w: ~w.isin("with", "product"),
    )
    low = F.lower(text)
    return let(
        words,
        lambda ws: F.when(F.size(ws) == 0, F.lit(0)).otherwise(
            F.floor(F.size(F.filter(ws, lambda w: F.contains(low, w))) / F.size(ws) * 15).cast("int")
        ),
    )


def query_gaps(c) -> Column:
    """Fields a product lookup should fill, in order."""
    return flags_to_list(
        [
            (strip(c["product_name"]) == "", "Product Name"),
            (~dims.has_complete_3d(c["dimensions"]), "Dimensions"),
            (strip(c["finish_color"]) == "", "Finish / Color"),
            (strip(c["category"]) == "", "Product Category"),
            (strip(c["product_url"]) == "", "Product URL"),
            (~urls.is_https(c["image_url"]), "Image URL"),
        ]
    )
