"""URL filter: configured rules first, else an empirical-Bayes reputation of the host.

Labelled pages give every host bad outcomes k out of n.  Few labels say little, so rates are shrunk down
the hierarchy corpus -> suffix -> registered domain -> host: the posterior of a parent is the
beta prior of its children.  How strongly a level pulls is estimated from its own spread (method of moments
on the between-node variance).  A host is blocked when the lower bound of its posterior bad rate is
above ``max_bad``; hosts without labels inherit the domain's posterior.

Counts are combined per host before anything is shuffled; levels above are sums of the host table.

Defined results: a url that is null or has no ``://`` has an empty host and path and is judged as the host
''; outcomes of unknown pages, null outcomes and null page ids are left out; repeated outcomes of a page
count each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import ascii_lower, stored

# z of the one-sided 95 % bound.
Z95 = 1.6448536269514722


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as (length, rule, verdict), else null.

    ``rules``: (verdict, host, path); a configured list, checked one after the other on every row.
    """
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def _level(nodes: DataFrame, key: str, parent: str, above: DataFrame) -> DataFrame:
    """Posterior (a, b) of every node, with the parent's posterior mean as prior mean.

    ``nodes``: key, parent, n, k.  ``above``: parent, mean.
    """
    p = F.sum("k") / F.sum("n")
    total = nodes.filter("n > 0").agg(
        p.alias("p"), F.sum("n").cast("double").alias("big_n"), F.count("*").alias("m"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
    )
    # sum n (k/n - p)^2 = sum k^2/n - N p^2
    within = F.col("p") * (1 - F.col("p"))
    between = (F.col("kk") - F.col("big_n") * F.col("p") * F.col("p") - within * (F.col("m") - 1)) / (F.col("big_n") - F.col("sq") / F.col("big_n"))
    pull = F.when((F.col("m") > 1) & (between > 0) & (within > 0), F.least(F.greatest(within / between - 1, F.lit(1.0)), F.lit(10000.0))).otherwise(
        F.lit(10000.0)
    )
    strength = total.select(pull.alias("pull"))
    joined = nodes.join(above, parent).crossJoin(F.broadcast(strength.limit(1)))
    return joined.select(
        key, parent, "n", "k",
        (F.col("mean") * F.col("pull") + F.col("k")).alias("a"),
        ((1 - F.col("mean")) * F.col("pull") + F.col("n") - F.col("k")).alias("b"),
    )


def reputations(hosts: DataFrame, domain_labels: int = 2, suffix_labels: int = 1) -> DataFrame:
    """(host, a, b, low) from (host, n, k): beta posterior and lower 95 % bound of the bad rate."""
    named = hosts.withColumn("domain", last_labels(F.col("host"), domain_labels)).withColumn(
        "suffix", last_labels(F.col("host"), suffix_labels)
    ).withColumn("top", F.lit(0))
    domains = named.groupBy("domain", "suffix", "top").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix", "top").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # One page of either outcome keeps the corpus rate off 0 and 1.
    corpus = suffixes.groupBy("top").agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("mean"))
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")
    top = _level(suffixes, "suffix", "top", corpus).select("suffix", mean)
    mid = _level(domains.drop("top"), "domain", "suffix", top).select("domain", mean)
    low = _level(named.select("host", "domain", "n", "k"), "host", "domain", mid)
    s = F.col("a") + F.col("b")
    return low.select(
        "host", "a", "b", (F.col("a") / s - Z95 * F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))).alias("low")
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], max_bad: float = 0.5,
    domain_labels: int = 2, suffix_labels: int = 1,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate_low; one row per page.

    ``outcomes``: page_id, bad (0 or 1).
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum("bad").alias("k")
    )
    hosts = (
        rows.join(labelled, "page_id", "left").groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    )
    known = reputations(stored(hosts, "url-hosts"), domain_labels, suffix_labels)
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return (
        rows.withColumn("hit", rule).join(known.select("host", "low"), "host", "left")
        .select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce(F.col("hit.verdict"), F.when(F.col("low") > max_bad, "block").otherwise("allow")).alias("verdict"),
            F.col("low").alias("bad_rate_low"),
        )
    )
