"""Lookup and ranking queries: brands, memory, cache, domains, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import dims, rules, urls
from skuloom.functions import text as tx
from skuloom.operators import candidates as cand
from skuloom.operators import memory as mem
from skuloom.registry import query


@query("intake", "brand_domains")
def join_brand_domain(df, table):
    return mem.brand_domain(df, table).select("row_id", "brand", "domain", "domain_source")


@query("brand_domains")
def domain_cache_update(table):
    return mem.merge_brand_domains(table)


@query("intake", "source_memory")
def join_product_memory(df, memory):
    return mem.lookup_memory(df, memory).select(
        "row_id", "memory_source_type", "memory_confidence_score", "memory_image_url"
    )


@query("intake", "source_memory")
def join_product_memory_legacy(df, memory):
    """Keys moved to an older model column for a third of the memory."""
    moved = F.col("success_count") % 3 == 0
    old = memory.withColumn("normalized_model", F.when(moved, F.col("normalized_model_sku")).otherwise(F.lit(""))).withColumn(
        "normalized_model_sku", F.when(moved, F.lit("")).otherwise(F.col("normalized_model_sku"))
    )
    return mem.lookup_memory(df, old, "normalized_model").select("row_id", "memory_source_type", "memory_confidence_score")


@query("intake_wide", "source_memory_wide")
def fill_from_memory(df, memory):
    return mem.fill_from_memory(mem.lookup_memory(df, memory)).select(
        "row_id", "dimensions", *[c for c, _, _ in mem.FILLS], "memory_filled", "memory_hit", "stored_source_used", "cache_hit"
    )


@query("intake_wide", "product_cache")
def join_product_cache(df, cache):
    return mem.apply_cache(df, cache).select(
        "row_id", "product_name", "brand", "dimensions", "product_url", "image_url", "finish_color", "cache_filled", "cache_missing"
    )


@query("product_cache")
def cache_sanitize_on_read(cache):
    return mem.sanitize_cache(cache).select(
        "product_key", "product_url", "image_url",
        F.array_join(F.array_sort(F.map_keys("null_fields")), ",").alias("rejected"),
    )


@query("source_memory")
def memory_sanitize_on_read(memory):
    return mem.sanitize_links(memory).select("normalized_model_sku", "product_page_url", "image_url", "rejected_reason")


@query("product_cache", "cache_delta_wide")
def cache_update(cache, delta):
    misses = F.array_sort(F.transform(F.map_entries("null_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["failure_reason"])))
    return mem.update_cache(cache, delta).withColumn("misses", F.array_join(misses, "; ")).drop("null_fields", "timestamp")


@query("source_memory")
def kb_read(memory):
    return mem.search_memory(memory, text="p/1", source_type="manufacturer", limit=100).select(
        "normalized_brand", "normalized_model_sku", "source_type", "confidence_score", "success_count"
    )


@query("source_memory")
def topk_sources(memory):
    return mem.search_memory(memory, limit=9999).select("normalized_brand", "normalized_model_sku", "success_count", "confidence_score")


@query("preferred_domains")
def domains_read(domains):
    return mem.search_domains(domains, text="example", limit=50).select("domain", "domain_id", "success_count", "failure_count", "downranked")


@query("source_memory", "preferred_domains")
def kb_audit(memory, domains):
    return mem.audit(stored_sources=memory, preferred_domains=domains)


@query("source_memory")
def usable_source(memory):
    return memory.select("normalized_model_sku", mem.usable(memory).alias("usable"))


@query("product_cache")
def confidence_ok(cache):
    return cache.select(
        "product_key",
        mem.confidence_ok(F.col("dimension_confidence")).alias("dimension_ok"),
        mem.confidence_ok(F.col("general_confidence")).alias("general_ok"),
    )


@query("source_memory")
def memory_best_per_key(memory):
    return mem.best_per_key(memory, ["normalized_brand"]).select("normalized_brand", "confidence_score", "success_count", "product_page_url")


@query("hint_requests", "source_memory", "preferred_domains")
def preferred_domain_hint(asked, memory, domains):
    return mem.domain_hint(asked, memory, domains)


@query("source_memory", "memory_delta")
def memory_upsert(memory, delta):
    return mem.upsert_memory(memory, delta)


@query("preferred_domains", "domain_events")
def domain_upsert(domains, events):
    good = F.col("success_count") > 0
    events = events.withColumns({
        "source_type": F.when(good, F.lit("retailer")).otherwise(F.lit("")), "notes": F.when(good, F.lit("")).otherwise(F.lit("timeout")),
    })
    out = mem.upsert_domains(domains, events)
    return out.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("last_success_at", "last_failure_at")}
    )


@query("source_memory", "memory_delta")
def memory_counters(memory, delta):
    cols = ["normalized_brand", "normalized_model_sku", "success_count", "failure_count"]
    return mem.memory_counters(memory.select(*cols).unionByName(delta.select(*cols)))


@query("source_memory_wide")
def memory_edit(memory):
    op = F.when(F.col("success_count") == 1, "update").when(F.col("success_count") == 2, "delete").when(F.col("success_count") == 3, "reverify")
    edits = memory.withColumn("op", op).filter("op is not null").select(
        "memory_id", "op", F.lit("New Brand!").alias("brand"), F.lit('1"W x 2"H x 3"D').alias("dimensions_text"),
        F.when(F.col("failure_count") == 0, F.lit("https://new.example.com/p")).alias("product_page_url"),
    )
    return mem.edit_memory(memory, edits).select(
        "memory_id", "normalized_brand", "normalized_model_sku", "brand", "display_brand", "dimensions_text", "product_page_url", "notes",
        "source_type", "confidence_score", "success_count", "source_domain",
    )


@query("preferred_domains")
def domain_edit(domains):
    op = F.when(F.col("domain_id") % 5 == 1, "update").when(F.col("domain_id") % 5 == 2, "delete")
    edits = domains.withColumn("op", op).filter("op is not null").select(
        "domain_id", "op", F.when(F.col("domain_id") % 2 == 0, F.concat(F.lit("https://WWW.New"), F.col("domain_id").cast("string"), F.lit(".example.com/x"))).alias("domain"),
        F.lit(True).alias("downranked"), F.lit("Checked.").alias("notes"),
    )
    return mem.edit_domains(domains, edits)


@query("intake_wide")
def source_record(df):
    return mem.record_from_row(df)


# ---------------------------------------------------------------- candidates


@query("search_results", "brand_sites")
def domain_score(results, sites):
    return cand.score_results(results, sites).select("product_id", "result_ordinal", "domain", "domain_score")


@query("search_results")
def domain_score_fixed(results):
    """The fixed brand table; brands of the sample are mapped onto four of its names."""
    names = F.array(*[F.lit(b) for b in ("Sub-Zero", "Miele", "Bosch", "GE Profile")])
    hosts = F.array(*[F.lit(h) for h in ("https://ca.subzero-wolf.com/x", "https://miele.com/y", "https://www.ajmadison.com/z", "https://geappliances.com/p")])
    rows = results.select(
        "product_id",
        "result_ordinal",
        F.get(names, (F.col("product_id") % 4).cast("int")).alias("brand"),
        F.get(hosts, ((F.col("product_id") + F.col("result_ordinal")) % 4).cast("int")).alias("url"),
    )
    return cand.score_results(rows, cand.fixed_brand_sites(results.sparkSession)).select("product_id", "result_ordinal", "domain_score")


@query("search_results")
def join_domain_suffix(results):
    rows = results.select(
        F.concat(F.col("product_id").cast("string"), F.lit("-"), F.col("result_ordinal").cast("string")).alias("result_id"),
        urls.site(F.col("url")).alias("domain"),
    )
    listed = results.filter(F.col("result_ordinal") < 2).select(
        F.when(F.col("product_id") % 2 == 0, F.lit("maker.example.com")).otherwise(F.lit("ajmadison.com")).alias("listed")
    )
    return cand.match_domains(rows, "result_id", "domain", listed)


@query("search_results")
def join_allowlist_semi_anti(results):
    from skuloom.functions import lookups

    site = urls.site(F.col("url"))
    return results.select(
        "product_id",
        "result_ordinal",
        urls.in_domains(site, lookups.SKIPPED_SITES).alias("skipped"),
        urls.in_domains(site, lookups.LOW_PRIORITY_SITES).alias("low_priority"),
        urls.in_domains(site, lookups.PREFERRED_SITES).alias("preferred"),
        urls.in_domains(site, urls.RETAILERS).alias("retailer"),
    )


@query("search_results", "brand_sites")
def topk_search(results, sites):
    return cand.best_results(cand.score_results(results, sites), 3).select("product_id", "result_ordinal", "domain_score", "position")


@query("search_results", "brand_sites")
def distinct_candidates(results, sites):
    return cand.distinct_results(cand.score_results(results, sites)).select("product_id", "url", "result_ordinal")


@query("search_results", "brand_sites")
def rank_candidates(results, sites):
    return cand.rank_candidates(cand.score_results(results, sites), 3).select(
        "product_id", "position", "url", "sku_hit", "official_hit", "spec_hit", "brand_score", "domain_score", "weak", "low_priority"
    )


@query("search_results", "brand_sites")
def topk_diagnostics(results, sites):
    return cand.top_json(cand.rank_candidates(cand.score_results(results, sites), 5), 2)


@query("intake", "brand_sites")
def search_queries(df, sites):
    return cand.work_list(df.withColumn("room", F.lit("")), sites)


@query("intake", "brand_sites")
def distinct_queries(df, sites):
    rows = cand.with_brand_sites(df, sites)
    return rows.select("row_id", F.array_join(cand.dimension_queries(rows), " | ").alias("queries"))


@query("part")
def sku_variants(df):
    n = F.col("p_partkey").cast("string")
    model = F.get(
        F.array(
            F.concat(F.lit("MDD "), n, F.lit(" SS")), F.concat(F.lit("DEC"), n, F.lit("RID/R")), F.concat(F.lit("IC-"), n, F.lit("-ID/S")),
            F.concat(F.lit("HV"), n, F.lit("SS")), F.concat(F.lit("X"), n, F.lit("ID/7")),
        ),
        (F.col("p_partkey") % 5).cast("int"),
    )
    return df.select(
        "p_partkey",
        F.array_join(cand.model_variants(model), "|").alias("page_variants"),
        F.array_join(cand.model_variants(model, strict=False), "|").alias("dimension_variants"),
    )


@query("intake_wide")
def qualifies_for_enrichment(df):
    from skuloom.operators.enrich import qualification

    return qualification(df).select("row_id", "qualifies", "gaps", "skip_source_type", "skip_no_brand", "skip_no_model")


@query("search_results", "part")
def name_similarity(results, part):
    rows = results.join(part.select(F.col("p_partkey").alias("product_id"), "p_name"), "product_id")
    text = F.concat_ws(" ", "title", "description")
    return rows.select("product_id", "result_ordinal", cand.name_similarity(F.col("p_name"), text).alias("points"))


@query("product_pages", "part")
def snippet(pages, part):
    rows = pages.join(part.select(F.col("p_partkey").alias("product_id"), "p_brand", "p_type"), "product_id")
    model = F.concat(F.col("p_type"), F.lit("-"), F.col("product_id").cast("string"))
    return rows.select("page_id", tx.snippet(tx.plain_text(F.col("html")), [model, F.col("p_brand")]).alias("snippet"))


@query("intake_wide")
def distinct_urls(df):
    from skuloom.operators.enrich import source_links

    extra = F.when(
        df.row_id % 3 == 0, F.lit('[{"url":"https://json.example.com/a"},{"url":"bad"},{"url":"https://json.example.com/b"}]')
    ).otherwise(F.lit(""))
    return df.select("row_id", F.array_join(source_links(df, extra), " ").alias("links"))


@query("intake_wide")
def dims_confidence(df):
    from skuloom.operators.enrich import dimension_confidence

    n = dims.axis_count(dims.parse_dims(df.dimensions))
    return df.select(
        "row_id",
        dims.confidence_from_axes(df.dimensions, (df.row_id % 100).cast("int")).alias("by_domain_score"),
        dimension_confidence(n, df.row_id % 2 == 0, df.row_id % 3 == 0).alias("by_evidence"),
    )


@query("intake")
def model_match_confidence(df):
    from skuloom.operators.enrich import model_confidence

    variant = F.when(df.row_id % 3 == 0, F.lower(df.model_sku)).when(df.row_id % 3 == 1, F.regexp_replace(df.model_sku, "[- ]", "")).otherwise(F.lit("other"))
    return df.select("row_id", model_confidence(variant, df.model_sku, df.row_id % 2 == 0).alias("confidence"))


@query("intake_wide")
def plain_search_query(df):
    site = F.when(df.row_id % 2 == 0, F.lit("maker.example.com"))
    return df.select("row_id", cand.plain_query(df, site).alias("query"))


@query("intake_wide")
def product_identity(df):
    return df.select("row_id", rules.product_key(df.brand, df.model_sku).alias("product_key"), rules.is_charge(df).alias("charge"))
