"""Source memory, preferred domains, product cache: reading, lookup, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions import dims, urls
from skuloom.functions.text import flags_to_list, has, norm_token, strip
from skuloom.operators.keyed import attach, first_per

MEMORY_KEYS = ["normalized_brand", "normalized_model_sku"]
LINK_FIELDS = (
    "product_page_url", "manufacturer_url", "spec_sheet_url", "dimension_source_url", "image_source_url", "image_url",
)


def search_memory(memory: DataFrame, text: str = "", source_type: str = "", limit: int = 100) -> DataFrame:
    """Filter first, then sort and return the first ``limit`` rows, as many as the caller asks for."""
    rows = memory
    if source_type:
        rows = rows.filter(F.lower("source_type") == source_type.lower())
    fields = [
        c
        for c in (
            "display_brand", "display_model_sku", "brand", "model_sku", "normalized_brand", "normalized_model_sku",
            "product_name", "source_domain", "manufacturer_url", "product_page_url", "spec_sheet_url", "notes",
        )
        if c in rows.columns
    ]
    if text.strip():
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.strip().lower())))
    order = [F.desc("success_count"), F.desc("confidence_score")]
    if "last_verified_at" in rows.columns:
        order.append(F.desc("last_verified_at"))
    return rows.orderBy(*order, *MEMORY_KEYS).limit(max(1, limit))


def search_domains(domains: DataFrame, text: str = "", source_type: str = "", limit: int = 100) -> DataFrame:
    rows = domains
    if source_type:
        rows = rows.filter(F.lower("source_type") == source_type.lower())
    if text.strip():
        hay = F.lower(F.concat_ws(" ", "domain", "source_type", "notes"))
        rows = rows.filter(F.contains(hay, F.lit(text.strip().lower())))
    return rows.orderBy(
        F.asc("downranked"), F.desc("success_count"), F.asc("failure_count"), F.desc("domain"), F.desc("domain_id")
    ).limit(max(1, limit))


def sanitize_links(df: DataFrame, fields: tuple[str, ...] = LINK_FIELDS) -> DataFrame:
    """Blank unusable links and say which (first three)."""
    present = [c for c in fields if c in df.columns]
    bad = urls.rejected_fields({c: F.coalesce(F.col(c), F.lit("")) for c in present})
    rows = df.withColumn("_bad", bad)
    def names(field: str):
        return lambda entry: F.startswith(entry, F.lit(f"{field}="))

    cleaned = {c: F.when(F.exists("_bad", names(c)), F.lit("")).otherwise(F.col(c)) for c in present}
    reason = F.when(
        F.size("_bad") > 0,
        F.concat(F.lit("invalid URL removed: "), F.array_join(F.slice("_bad", 1, 3), "; ")),
    ).otherwise(F.lit(""))
    return rows.withColumns({**cleaned, "rejected_reason": reason}).drop("_bad")


def usable(df: DataFrame) -> Column:
    """Score of at least 60 and anything to offer."""
    fields = (
        "dimensions_text", "dimension_source_url", "image_url", "image_source_url",
        "manufacturer_url", "product_page_url", "spec_sheet_url",
    )
    present = [has(F.col(c)) for c in fields if c in df.columns]
    return (F.coalesce(F.col("confidence_score"), F.lit(0)) >= 60) & urls.any_of(present)


def best_per_key(memory: DataFrame, keys: list[str]) -> DataFrame:
    """Best entry per key: confidence, then successes, then last check."""
    order = [F.desc("confidence_score"), F.desc("success_count")]
    if "last_verified_at" in memory.columns:
        order.append(F.desc("last_verified_at"))
    return first_per(memory, keys, order + [F.asc("product_page_url")])


def lookup_memory(rows: DataFrame, memory: DataFrame, legacy: str | None = None) -> DataFrame:
    """Left join of each row's best memory entry; unusable best entries do not count.

    With ``legacy`` (an older model column of the memory) rows without a hit are looked up again there.
    """
    payload = [c for c in memory.columns if c not in (*MEMORY_KEYS, legacy)]

    def ready(key: str, prefix: str) -> DataFrame:
        best = best_per_key(memory.filter(F.col(key) != ""), ["normalized_brand", key])
        best = sanitize_links(best)
        best = best.filter(usable(best))
        return best.select(
            F.col("normalized_brand"),
            F.col(key).alias("normalized_model_sku"),
            *[F.col(c).alias(prefix + c) for c in payload],
        )

    keyed = rows.withColumn("normalized_brand", norm_token(F.col("brand"))).withColumn(
        "normalized_model_sku", norm_token(F.col("model_sku"))
    )
    blank = (F.col("normalized_brand") == "") | (F.col("normalized_model_sku") == "")
    # Keyless rows would all meet in one partition; they get a key of their own.
    keyed = keyed.withColumn(
        "normalized_brand", F.when(blank, F.concat(F.lit("~"), F.col("row_id").cast("string"))).otherwise(F.col("normalized_brand"))
    )
    out = attach(keyed, ready("normalized_model_sku", "memory_"), MEMORY_KEYS)
    if legacy:
        out = attach(out, ready(legacy, "legacy_"), MEMORY_KEYS)
        for c in payload:
            out = out.withColumn(f"memory_{c}", F.coalesce(f"memory_{c}", f"legacy_{c}")).drop(f"legacy_{c}")
    return out.drop(*MEMORY_KEYS)


# Which memory fields fill which row fields, in order; the first filled memory field counts.
FILLS = (
    ("width_in", "Width (in)", ("width_in",)), ("height_in", "Height (in)", ("height_in",)), ("depth_in", "Depth (in)", ("depth_in",)),
    ("image_url", "Image URL", ("image_url",)), ("product_url", "Product URL", ("product_page_url",)),
    ("manufacturer_url", "Manufacturer URL", ("manufacturer_url",)),
    ("dimension_source_url", "Dimension Source URL", ("dimension_source_url", "spec_sheet_url")),
    ("image_source_url", "image_source_url", ("image_source_url",)), ("selected_product_url", "selected_product_url", ("product_page_url",)),
    ("manufacturer_domain_used", "manufacturer_domain_used", ("source_domain",)),
    ("dimension_confidence", "Dimension Confidence", ("dimension_confidence", "confidence")),
    ("image_confidence", "image_confidence", ("image_confidence", "confidence")),
    ("dimension_source_type", "Dimension Source Type", ("source_type",)),
)
USED = ("product_page_url", "manufacturer_url", "dimension_source_url", "spec_sheet_url", "image_source_url")


def fill_from_memory(joined: DataFrame) -> DataFrame:
    """Blank fields from the memory entry; dimensions replaced while incomplete.

    Fields that the row or the memory does not have count as blank; row fields are added.  ``memory_filled`` names what was filled,
    ``stored_source_used`` the entry's first link; rows with an entry get the cache hit ``stored_source``.
    """
    hit = F.col("memory_confidence_score").isNotNull()

    def entry(*names: str) -> Column:
        known = [F.nullif(strip(F.col(f"memory_{n}").cast("string")), F.lit("")) for n in names if f"memory_{n}" in joined.columns]
        return F.coalesce(*known, F.lit(""))

    def own(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in joined.columns else F.lit("")

    dim = entry("dimensions_text", "dimensions")
    take = hit & (dim != "") & ~dims.has_complete_3d(F.col("dimensions"))
    uses = [(c, label, hit & (strip(own(c)) == "") & (entry(*names) != ""), entry(*names)) for c, label, names in FILLS]
    new = {"dimensions": F.when(take, dim).otherwise(F.col("dimensions"))}
    new |= {c: F.when(use, value).otherwise(own(c)) for c, _, use, value in uses}
    source = F.when(hit, entry(*USED)).otherwise(F.lit(""))
    new |= {
        "memory_filled": F.array_join(flags_to_list([(take, "Dimensions")] + [(use, label) for _, label, use, _ in uses]), ", "),
        "memory_hit": hit, "stored_source_used": source, "knowledge_base_source_used": source,
    }
    if "cache_hit" in joined.columns:
        new["cache_hit"] = F.when(hit, F.lit("stored_source")).otherwise(F.col("cache_hit"))
    return joined.withColumns(new)


# ------------------------------------------------------------------ product cache

CACHE_FIELDS = (
    ("product_url", "product_url", "general_confidence"),
    ("product_name", "product_name", "general_confidence"),
    ("finish", "finish_color", "general_confidence"),
    ("material", "material", "general_confidence"),
    ("product_category", "category", "general_confidence"),
    ("image_url", "image_url", "general_confidence"),
    ("dimensions", "dimensions", "dimension_confidence"),
)


def confidence_ok(label: Column) -> Column:
    return F.coalesce(label, F.lit("")).isin("high", "medium")


def apply_cache(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Fill blank fields from the cache where its confidence allows; report filled and missing."""
    from skuloom.functions.rules import product_key
    from skuloom.operators.candidates import weak_page_reason
    from skuloom.operators.keyed import own_key

    renamed = cache.select("product_key", *[F.col(c).alias(f"cache_{c}") for c in cache.columns if c != "product_key"])
    keyed = rows.withColumn("product_key", own_key(product_key(F.col("brand"), F.col("model_sku")), F.col("row_id")))
    joined = attach(keyed, renamed, ["product_key"])
    use = {}
    for source, target, conf in CACHE_FIELDS:
        value = F.col(f"cache_{source}")
        ok = value.isNotNull() & confidence_ok(F.col(f"cache_{conf}")) & (strip(F.col(target)) == "")
        if source == "product_url":
            ok = ok & (weak_page_reason(F.coalesce(value, F.lit(""))) == "")
        use[source] = ok
    out = joined.withColumn("cache_filled", F.array_join(flags_to_list([(ok, s) for s, ok in use.items()]), ", "))
    out = out.withColumns(
        {t: F.when(use[s], F.col(f"cache_{s}")).otherwise(F.col(t)) for s, t, _ in CACHE_FIELDS}
    )
    missing = flags_to_list(
        [
            (~dims.has_complete_3d(F.col("dimensions")), "dimensions"),
            (strip(F.col("product_url")) == "", "product_url"),
        ]
    )
    return out.withColumn("cache_missing", F.array_join(missing, ", ")).drop(
        *[c for c in renamed.columns if c != "product_key"]
    )


def sanitize_cache(cache: DataFrame, fields: tuple[str, ...] = ("product_url", "image_url")) -> DataFrame:
    """Null unusable links on read and keep the reason per field."""
    bad = {c: F.coalesce(F.col(c) != "", F.lit(False)) & ~urls.is_fetchable(F.col(c)) for c in fields}
    rejected = F.map_from_entries(
        F.array_compact(
            F.array(
                *[
                    F.when(cond, F.struct(F.lit(c), F.lit("invalid URL removed from cache")))
                    for c, cond in bad.items()
                ]
            )
        )
    )
    out = cache.withColumn("null_fields", rejected)
    return out.withColumns({c: F.when(~bad[c], F.col(c)) for c in fields})


# Links of a cache entry, the fields that a size finding writes, and how certain such a finding is.
CACHE_LINKS = (
    "product_url", "verified_product_url", "product_page_url", "manufacturer_url", "spec_sheet_url", "dimension_source_url",
    "image_source_url", "image_url", "cloudinary_url", "original_image_url",
)
SIZE_FIELDS = ("dimensions", "width_in", "height_in", "depth_in", "length_in", "dimension_source_url", "dimension_confidence")
CERTAINTY = {"high": 2, "medium": 1, "low": 0}


def update_cache(cache: DataFrame, delta: DataFrame, at: Column | None = None) -> DataFrame:
    """Merge findings (one row per key) into the cache; all fields of either side stay.

    A filled value wins, ``''`` says nothing, null records a miss, and a link that can't be fetched is refused.  Misses
    and refusals blank the field and enter ``null_fields`` with their reason (``<field>_reason``) and the time; older entries of other
    fields stay.  Sizes are replaced together, and only by a finding of at least the stored certainty.
    """
    kinds = dict(delta.dtypes) | dict(cache.dtypes)
    reasons = {c for c in delta.columns if c.endswith("_reason") and c[: -len("_reason")] in delta.columns}
    given = [c for c in delta.columns if c != "product_key" and c not in reasons]
    extra = ("product_key", "null_fields", "timestamp")
    fields = [c for c in cache.columns if c not in extra] + [c for c in given if c not in cache.columns]
    d = delta.select("product_key", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in [*given, *reasons]])
    j = cache.join(d, "product_key", "full")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    now = at if at is not None else F.lit(None).cast("string")

    def rank(label: Column) -> Column:
        out = F.lit(-1)
        for word, value in CERTAINTY.items():
            out = F.when(label == word, value).otherwise(out)
        return out

    stronger = F.lit(True)
    if "dimension_confidence" in given and "dimension_confidence" in cache.columns:
        stronger = rank(F.col("_new_dimension_confidence")) >= rank(F.col("dimension_confidence"))

    def outcome(c: str) -> tuple[Column, Column]:
        """The new value and, for a miss, its reason."""
        old = F.col(c) if c in cache.columns else F.lit(None).cast(kinds[c])
        if c not in given:
            return old, F.lit(None).cast("string")
        new = F.col(f"_new_{c}")
        told = hit & stronger if c in SIZE_FIELDS else hit
        silent = F.coalesce(new == "", F.lit(False)) if kinds[c] == "string" else F.lit(False)
        refused = F.lit(False)
        if c in CACHE_LINKS:
            refused = told & new.isNotNull() & ~silent & ~urls.is_fetchable(F.coalesce(new, F.lit("")))
        own = F.nullif(F.col(f"_new_{c}_reason"), F.lit("")) if f"{c}_reason" in reasons else F.lit(None).cast("string")
        why = F.when(refused, F.coalesce(own, F.lit("invalid URL rejected from cache"))).when(told & new.isNull(), F.coalesce(own, F.lit("not found")))
        return F.when(why.isNotNull(), F.lit(None)).when(told & ~silent, new).otherwise(old), why

    results = {c: outcome(c) for c in fields}
    entry = "map<string,struct<last_attempted:string,failure_reason:string>>"
    pairs = [F.struct(F.lit(c).alias("k"), F.struct(now.cast("string").alias("last_attempted"), why.alias("failure_reason")).alias("v")) for c, (_, why) in results.items()]
    fresh = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"]["failure_reason"].isNotNull())).cast(entry)
    old = F.col("null_fields").cast(entry) if "null_fields" in cache.columns else F.lit(None).cast(entry)
    empty = F.create_map().cast(entry)
    merged = F.map_zip_with(F.coalesce(old, empty), fresh, lambda k, a, b: F.coalesce(b, a))
    stamp = F.coalesce(F.col("timestamp") if "timestamp" in cache.columns else F.lit(None).cast("string"), F.when(hit, now)).alias("timestamp")
    return j.select("product_key", *[value.cast(kinds[c]).alias(c) for c, (value, _) in results.items()], merged.alias("null_fields"), stamp)


# ------------------------------------------------------------------ brand domains


def brand_domain(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Official domain per brand: user entry, fixed table, discovered entry; invalid ones skipped."""
    from skuloom.functions.text import norm_text

    best = (
        table.select(
            norm_text(F.col("brand")).alias("brand_name"),
            urls.clean_domain(F.col("domain")).alias("valid"),
            "source",
            "priority",
        )
        .filter(F.col("valid").isNotNull())
        .groupBy("brand_name")
        .agg(F.min(F.struct("priority", "valid", "source")).alias("best"))
        .select("brand_name", F.col("best.valid").alias("domain"), F.col("best.source").alias("domain_source"))
    )
    keyed = rows.withColumn("brand_name", norm_text(F.col("brand")))
    return keyed.join(best, "brand_name", "left")


def merge_brand_domains(entries: DataFrame) -> DataFrame:
    """One entry per brand after an update run (lowest priority number wins)."""
    return (
        entries.groupBy("brand")
        .agg(F.min(F.struct("priority", "domain", "source")).alias("best"))
        .select("brand", "best.domain", "best.source")
    )


def held_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``texts`` (with ``text``) once for every key of ``keys`` (column key) that stands inside their text.

    Only pieces of the lengths that occur among the keys are cut out, and pieces meet keys in an equi-join; work per text is
    its length times the number of different lengths.  That list of lengths is the only thing the driver reads: at most the
    longest key has entries.
    """
    sizes = keys.filter("key <> ''").agg(F.array_sort(F.collect_set(F.length("key"))).alias("sizes")).first()["sizes"]

    def cut(size: int) -> Column:
        last = F.length("text") - size + 1
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substr(F.col("text"), i, F.lit(size)))

    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *[cut(size) for size in sizes]))
    return texts.withColumn("key", F.explode(pieces)).join(keys.filter("key <> ''").distinct(), "key", "left_semi")


def domain_hint(asked: DataFrame, memory: DataFrame, domains: DataFrame) -> DataFrame:
    """Best learned domain per brand (and category, where ``asked`` has one).

    Own memory rows of the brand come first.  Else of the domains not ranked down whose name or notes hold the brand, or whose notes hold
    the category, the one with the best balance of successes, the latest success, most successes and fewest failures.  A manufacturer's
    domain that begins with the brand holds it as well, so its source type adds no case.
    """
    category = F.coalesce(norm_token(F.col("category")), F.lit("")) if "category" in asked.columns else F.lit("")
    asked = asked.select(F.coalesce(norm_token(F.col("brand")), F.lit("")).alias("brand_key"), category.alias("category_key"))
    asked = asked.filter("brand_key <> ''").distinct()
    checked = F.col("last_verified_at").cast("string") if "last_verified_at" in memory.columns else F.lit("")
    link = urls.memory_domain(F.col("source_domain")) if "source_domain" in memory.columns else urls.url_domain(F.col("product_page_url"))
    place = F.struct(
        (F.coalesce("success_count", F.lit(0)) - F.coalesce("failure_count", F.lit(0))).alias("balance"),
        F.coalesce("confidence_score", F.lit(0)).alias("score"), F.coalesce(checked, F.lit("")).alias("checked"), F.col("link").alias("domain"),
    )
    own = memory.withColumn("link", link).filter("link <> ''").groupBy(F.col("normalized_brand").alias("brand_key")).agg(F.max(place).alias("own"))
    last = F.col("last_success_at").cast("string") if "last_success_at" in domains.columns else F.lit("")
    live = domains.filter(~F.coalesce("downranked", F.lit(False))).select(
        F.struct(
            (F.coalesce("success_count", F.lit(0)) - F.coalesce("failure_count", F.lit(0))).alias("balance"),
            F.coalesce(last, F.lit("")).alias("last"), F.coalesce("success_count", F.lit(0)).alias("successes"),
            (-F.coalesce("failure_count", F.lit(0))).alias("failures"), F.col("domain"),
        ).alias("rank"),
        F.coalesce(norm_token(F.col("domain")), F.lit("")).alias("name"), F.coalesce(norm_token(F.col("notes")), F.lit("")).alias("note"),
    )
    texts = live.select("rank", F.explode(F.array("name", "note")).alias("text"))
    brands, categories = asked.select(F.col("brand_key").alias("key")), asked.select(F.col("category_key").alias("key"))
    best = lambda df, c: df.groupBy(F.col("key").alias(c)).agg(F.max("rank").alias(f"{c}_best"))
    by_brand = best(held_keys(texts, brands), "brand_key")
    by_category = best(held_keys(live.select("rank", F.col("note").alias("text")), categories), "category_key")
    joined = asked.join(own, "brand_key", "left").join(by_brand, "brand_key", "left").join(by_category, "category_key", "left")
    related = F.greatest("brand_key_best", "category_key_best")["domain"]
    hint = F.coalesce(F.col("own.domain"), urls.memory_domain(related), F.lit(""))
    return joined.select("brand_key", "category_key", hint.alias("hint"))


# ------------------------------------------------------------------ merging


def source_rank(source_type: Column) -> Column:
    return (
        F.when(source_type == "manufacturer", 4)
        .when(source_type == "spec_sheet", 3)
        .when(source_type == "manual", 2)
        .when(source_type.isin("retailer", "trusted_retailer"), 1)
        .otherwise(0)
    )


# Fields of a better-ranked record that a weaker increment does not replace.
PROTECTED = (
    "product_page_url", "manufacturer_url", "spec_sheet_url", "dimension_source_url", "image_source_url", "image_url",
    "dimensions_text", "dimensions", "width_in", "height_in", "depth_in", "dimension_confidence", "image_confidence",
    "source_domain", "source_type", "confidence_score", "confidence",
)
COUNTERS = ("success_count", "failure_count")
FIRST_TIMES = ("first_seen_at", "created_at")


def upsert_memory(memory: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge one increment per key into the table; all columns of both sides stay.

    The incoming record wins when its (rank, score) is at least the existing one; a better-ranked
    existing record with at least the score keeps its filled protected fields.  Null means absent, ``''``
    is a value, a missing score counts as 0.  Counters add up; the first times stay.
    """
    given = [c for c in delta.columns if c not in MEMORY_KEYS]
    kinds = dict(delta.dtypes) | dict(memory.dtypes)
    d = delta.select(*MEMORY_KEYS, *[F.col(c).alias(f"in_{c}") for c in given], F.lit(True).alias("in_present"))
    j = memory.withColumn("old_present", F.lit(True)).join(d, MEMORY_KEYS, "full")
    old_rank, new_rank = source_rank(F.col("source_type")), source_rank(F.col("in_source_type"))
    old_score, new_score = (F.coalesce(F.col(f"{p}confidence_score"), F.lit(0)) for p in ("", "in_"))
    better = (new_rank > old_rank) | ((new_rank == old_rank) & (new_score >= old_score))
    keep = (old_rank > new_rank) & (old_score >= new_score)

    def filled(value: Column, kind: str) -> Column:
        if kind == "string":
            return F.nullif(value, F.lit(""))
        return F.nullif(value, F.lit(0)) if kind.startswith(("int", "bigint", "double", "float", "decimal")) else value

    def merged(c: str) -> Column:
        if c not in given:
            return F.col(c)
        if c not in memory.columns:
            return F.col(f"in_{c}").alias(c)
        old, new = F.col(c), F.col(f"in_{c}")
        if c in COUNTERS:
            return (F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).cast("int").alias(c)
        if c in FIRST_TIMES:
            return F.coalesce(old, new).alias(c)
        both = F.when(better, F.coalesce(new, old)).otherwise(F.coalesce(old, new))
        if c in PROTECTED:
            both = F.when(keep, F.coalesce(filled(old, kinds[c]), filled(new, kinds[c]), old)).otherwise(both)
        return F.when(F.col("old_present").isNull(), new).when(F.col("in_present").isNull(), old).otherwise(both).alias(c)

    columns = [c for c in memory.columns if c not in MEMORY_KEYS]
    return j.select(*MEMORY_KEYS, *[merged(c) for c in [*columns, *[c for c in given if c not in columns]]])


def merged_record(old: Column, new: Column, kinds: dict[str, str]) -> Column:
    """The record (a struct of the fields in ``kinds``) after one increment; the rule of ``upsert_memory`` on structs.

    A null ``old`` gives the increment itself.
    """
    absent = old.isNull()
    score = lambda r: F.coalesce(r["confidence_score"], F.lit(0))
    old_rank, new_rank = source_rank(old["source_type"]), source_rank(new["source_type"])
    better = (new_rank > old_rank) | ((new_rank == old_rank) & (score(new) >= score(old)))
    keep = (old_rank > new_rank) & (score(old) >= score(new))

    def field(c: str, kind: str) -> Column:
        a, b = old[c], new[c]
        blank = F.lit("") if kind == "string" else F.lit(0) if kind.startswith(("int", "bigint", "double", "float", "decimal")) else None
        filled = (lambda v: F.nullif(v, blank)) if blank is not None else (lambda v: v)
        if c in COUNTERS:
            value = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        elif c in FIRST_TIMES:
            value = F.coalesce(a, b)
        else:
            value = F.when(better, F.coalesce(b, a)).otherwise(F.coalesce(a, b))
            if c in PROTECTED:
                value = F.when(keep, F.coalesce(filled(a), filled(b), a)).otherwise(value)
        return F.when(absent, b).otherwise(value).cast(kind).alias(c)

    return F.struct(*[field(c, kind) for c, kind in kinds.items()])


def fold_memory(memory: DataFrame, increments: DataFrame, order: list[str]) -> DataFrame:
    """Records of the keys that ``increments`` has, after all its increments one by one.

    Increments of a key are applied by ``order``, then by their other fields.  They are held as one array per key, so
    ``increments`` is a bounded batch; records of other keys are left out.  Fields that only one side has are null on the other.
    """
    kinds = {c: k for c, k in [*memory.dtypes, *increments.dtypes] if c not in MEMORY_KEYS}

    def record(df: DataFrame) -> Column:
        return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    new = increments.groupBy(*MEMORY_KEYS).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{c}") for c in order], record(increments).alias("r")))).alias("new")
    )
    old = memory.select(*MEMORY_KEYS, record(memory).alias("old"))
    shape = "struct<" + ",".join(f"`{c}`:{k}" for c, k in kinds.items()) + ">"
    joined = new.join(old, MEMORY_KEYS, "left")
    after = F.aggregate("new", F.col("old").cast(shape), lambda a, x: merged_record(a, x["r"], kinds))
    return joined.select(*MEMORY_KEYS, after.alias("r")).select(*MEMORY_KEYS, "r.*")


def upsert_domains(domains: DataFrame, events: DataFrame) -> DataFrame:
    """Add counters per normalised domain; keep the times of the last success and failure.

    All columns of ``domains`` stay.  Where stored names of one domain differ only in form, their counters add up and
    the entry with most successes gives the other columns.  Of the events of a domain the latest filled source type and
    notes replace the stored ones, as the last write does; a new domain without a type is a manufacturer's.
    """
    stored_name, sent_name = urls.memory_domain(F.col("domain")), urls.memory_domain(F.col("domain"))
    given = [c for c in ("source_type", "notes") if c in events.columns]
    order = F.struct("happened_at", *given)
    delta = (
        events.select(sent_name.alias("domain"), "success_count", "failure_count", "happened_at", *given)
        .filter(F.col("domain") != "")
        .groupBy("domain")
        .agg(
            F.sum("success_count").alias("add_success"),
            F.sum("failure_count").alias("add_failure"),
            F.max(F.when(F.col("success_count") > 0, F.col("happened_at"))).alias("new_success_at"),
            F.max(F.when(F.col("failure_count") > 0, F.col("happened_at"))).alias("new_failure_at"),
            *[F.max_by(c, F.when(strip(F.col(c)) != "", order)).alias(f"new_{c}") for c in given],
        )
    )
    times = ("last_success_at", "last_failure_at")
    rest = [c for c in domains.columns if c not in ("domain", "success_count", "failure_count", "downranked", *times)]
    lead = F.struct(F.coalesce("success_count", F.lit(0)).alias("_n"), *rest)
    base = domains.withColumn("_name", F.coalesce(F.nullif(stored_name, F.lit("")), F.col("domain"))).groupBy("_name").agg(
        F.sum("success_count").alias("old_success"), F.sum("failure_count").alias("old_failure"), F.max("downranked").alias("downranked"),
        F.max(lead).alias("rest"),
        *[F.max(c).alias(c) for c in times if c in domains.columns],
    ).withColumnRenamed("_name", "domain")
    zero = F.lit(0)

    def kept(c: str) -> Column:
        value = F.col(f"rest.{c}")
        if c in given:
            value = F.coalesce(f"new_{c}", value)
        if c == "source_type":
            value = F.coalesce(F.nullif(value, F.lit("")), F.lit("manufacturer"))
        return value.alias(c)

    j = base.join(delta, "domain", "full")
    when = {c: F.greatest(F.col(f"new_{c[5:]}"), F.col(c)) if c in domains.columns else F.col(f"new_{c[5:]}") for c in times}
    return j.select(
        "domain",
        (F.coalesce("old_success", zero) + F.coalesce("add_success", zero)).alias("success_count"),
        (F.coalesce("old_failure", zero) + F.coalesce("add_failure", zero)).alias("failure_count"),
        F.coalesce("downranked", F.lit(False)).alias("downranked"),
        *[when[c].alias(c) for c in times],
        *[kept(c) for c in rest],
        *[F.col(f"new_{c}").alias(c) for c in given if c not in domains.columns],
    )


def memory_counters(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*MEMORY_KEYS).agg(
        F.sum("success_count").alias("success_count"), F.sum("failure_count").alias("failure_count")
    )


# Which fields a normalised key follows, and the note of a re-check.
KEYS_FROM = {
    "normalized_brand": ("brand", "display_brand"), "normalized_model_sku": ("model_sku", "display_model_sku"),
    "normalized_model": ("model_sku", "display_model_sku"),
}
REVERIFY = "Marked for manual re-verify."


def _edited(table: DataFrame, edits: DataFrame, row: str, derived, at: Column | None) -> DataFrame:
    """Rows without the deleted ones; an update sets every field the edit gives, a re-check sets the note."""
    gone = edits.filter(F.col("op") == "delete").select(row)
    given = [c for c in edits.columns if c not in (row, "op")]
    change = edits.filter(F.col("op").isin("update", "reverify")).select(row, "op", *[F.col(c).alias(f"new_{c}") for c in given])
    j = table.join(gone, row, "left_anti").join(change, row, "left")
    update, check = F.coalesce(F.col("op") == "update", F.lit(False)), F.coalesce(F.col("op") == "reverify", F.lit(False))

    def field(c: str) -> Column:
        old = F.col(c)
        value = F.coalesce(F.when(update, derived(c, given)), old) if derived(c, given) is not None else old
        if c == "notes":
            value = F.when(check, F.lit(REVERIFY)).otherwise(value)
        if at is not None and c == "last_verified_at":
            value = F.when(check, at).otherwise(value)
        if at is not None and c == "updated_at":
            value = F.when(update | check, at).otherwise(value)
        return value.alias(c)

    return j.select(*[field(c) for c in table.columns])


def edit_memory(memory: DataFrame, edits: DataFrame, row: str = "memory_id", at: Column | None = None) -> DataFrame:
    """Apply an edit table (op = update, delete, reverify) to records; at most one edit per record.

    Every column of ``edits`` that the memory has can be changed; null leaves a field as it is.  Keys follow an edited brand or
    model, ``dimensions`` and ``dimensions_text`` follow each other.  All columns stay; a re-check sets the note and, with ``at``, the time.
    """

    def derived(c: str, given: list[str]) -> Column | None:
        named = lambda *names: [F.col(f"new_{n}") for n in names if n in given]
        if c in KEYS_FROM and named(c, *KEYS_FROM[c]):
            return norm_token(F.coalesce(*named(c, *KEYS_FROM[c])))
        twin = {"dimensions": "dimensions_text", "dimensions_text": "dimensions", "display_brand": "brand", "display_model_sku": "model_sku"}
        values = named(c, *([twin[c]] if c in twin else []))
        return F.coalesce(*values) if values else None

    return _edited(memory, edits, row, derived, at)


def edit_domains(domains: DataFrame, edits: DataFrame, row: str = "domain_id", at: Column | None = None) -> DataFrame:
    """Apply an edit table (op = update, delete) to learned domains; a new domain name is normalised, all columns stay."""

    def derived(c: str, given: list[str]) -> Column | None:
        if c not in given:
            return None
        new = F.col(f"new_{c}")
        return F.nullif(urls.memory_domain(new), F.lit("")) if c == "domain" else new

    return _edited(domains, edits, row, derived, at)


def audit(**tables: DataFrame) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ records


def label_score(*labels: Column) -> Column:
    """90 / 70 / 35 / 60 / 0 from confidence words."""
    text = F.lower(F.concat_ws(" ", *labels))
    return (
        F.when(F.contains(text, F.lit("high")), 90)
        .when(F.contains(text, F.lit("medium")), 70)
        .when(F.contains(text, F.lit("low")), 35)
        .when(strip(text) != "", 60)
        .otherwise(0)
    )


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 80, F.lit("high"))
        .when(score >= 60, F.lit("medium"))
        .when(score > 0, F.lit("low"))
        .otherwise(F.lit("none"))
    )


def kind_of_source(url: Column, hint: Column) -> Column:
    text = F.translate(F.lower(strip(hint)), "_", " ")
    return (
        F.when(F.contains(text, F.lit("manufacturer")), F.lit("manufacturer"))
        .when(F.contains(text, F.lit("retailer")), F.lit("retailer"))
        .when(F.contains(text, F.lit("manual")), F.lit("manual"))
        .when(
            F.contains(text, F.lit("spec")) | F.endswith(F.lower(F.substring_index(url, "?", 1)), F.lit(".pdf")),
            F.lit("spec_sheet"),
        )
        .otherwise(F.lit("other"))
    )


def record_from_row(df: DataFrame, notes: str = "", at: Column | None = None) -> DataFrame:
    """Memory records of enriched rows, one increment each; ``at`` is the time of the check.

    Row fields that are missing count as blank; sizes without own columns are read from the dimensions.
    """
    c = df
    page = F.when(strip(c["product_url"]) != "", strip(c["product_url"])).otherwise(strip(c["selected_product_url"]))
    rows = df.withColumn("_page", page)
    dim_url, spec_own = strip(c["dimension_source_url"]), strip(c["spec_sheet_url"])

    def pdf(col):
        return F.endswith(F.lower(F.substring_index(col, "?", 1)), F.lit(".pdf"))

    spec = (
        F.when(spec_own != "", spec_own)
        .when(pdf(dim_url), dim_url)
        .when(pdf(F.col("_page")), F.col("_page"))
        .otherwise(F.lit(""))
    )
    rows = rows.withColumn("_spec", spec)
    maker = strip(c["manufacturer_url"]) if "manufacturer_url" in df.columns else F.lit("")
    rows = rows.withColumn(
        "_source",
        F.coalesce(*[F.nullif(x, F.lit("")) for x in (dim_url, F.col("_page"), maker, F.col("_spec"), strip(c["image_source_url"]))], F.lit("")),
    ).withColumn(
        "_score", label_score(c["dimension_confidence"], c["selected_product_url_confidence"], c["image_confidence"])
    )
    def own(name: str) -> Column:
        return F.coalesce(strip(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit("")

    labels = {c: F.coalesce(F.nullif(own(c), F.lit("")), score_label(F.col("_score"))) for c in ("dimension_confidence", "image_confidence")}
    axes = {f"{axis}_in": F.coalesce(F.nullif(own(f"{axis}_in"), F.lit("")), F.nullif(dims.axis_text(F.col("dimensions"), axis), F.lit("")), F.lit("")) for axis in ("width", "height", "depth")}
    brand, model = own("brand"), own("model_sku")
    record = {
        "display_brand": brand, "display_model_sku": model, "brand": brand, "model_sku": model,
        "normalized_brand": norm_token(brand), "normalized_model_sku": norm_token(model), "normalized_model": norm_token(model),
        "product_name": own("product_name"), "manufacturer_url": own("manufacturer_url"),
        "dimensions_text": own("dimensions"), "dimensions": own("dimensions"), "dimension_source_url": own("dimension_source_url"),
        "image_source_url": own("image_source_url"), "product_page_url": F.col("_page"), "spec_sheet_url": F.col("_spec"), **axes,
        "image_url": own("image_url"), "source_domain": urls.url_domain(F.col("_source")),
        "confidence_score": F.col("_score").cast("int"), "confidence": score_label(F.col("_score")), **labels,
        "source_type": kind_of_source(F.col("_source"), F.col("dimension_source_type")), "success_count": F.lit(1), "failure_count": F.lit(0),
        "notes": F.lit(notes),
    }
    if at is not None:
        record |= {"last_verified_at": at, "first_seen_at": F.coalesce(F.col("first_seen_at"), at) if "first_seen_at" in df.columns else at}
    return rows.select("row_id", *[value.alias(c) for c, value in record.items()])
