"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``size`` consecutive words (one window if it is shorter).  A
document contains a window only if it contains every one of its word shingles, so a prefix of one
shingle is enough at containment 1, and the rarest one makes the fewest candidates.  Rarity is
counted over all documents.  The join key is that shingle (one word); the length bound keeps
occurrences that fit into the document, the position bound fixes where the window must start, and
the words there are compared one by one.

Windows go to the documents in blocks of at most ``block`` windows, each broadcast: a block has a
fixed size whatever the benchmark's, and further blocks read the documents again.  No document row is
shuffled; only verified hits are.

Defined results: null, empty or wordless texts have no words and no hits; wordless and null items
have no windows; repeated rows are reported each, repeated items count by their id; an empty
benchmark leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import ascii_lower, stored

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Stands before the words of a document so that documents without hits keep a row; no word has a space.
HEAD = " "


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows with the ids (as strings) of the items that have them."""
    words = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return (
        words.select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at") + 1, size).alias("window"))
        .groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def with_prefix(found: DataFrame, docs: DataFrame, few: int) -> DataFrame:
    """Every window with its rarest shingle (``key``), counted over the whole collection, and where it stands."""
    vocabulary = stored(found.select(F.explode("window").alias("key")).distinct(), "benchmark-words")
    small = vocabulary.count() <= few
    used = docs.select(F.explode(item_words(F.col("text"))).alias("key"))
    used = used.join(F.broadcast(vocabulary) if small else vocabulary, "key", "left_semi")
    counts = used.groupBy("key").agg(F.count("*").alias("n"))
    places = found.withColumn("id", F.xxhash64("window")).select("id", "window", F.posexplode("window").alias("at", "key"))
    ranked = places.join(counts, "key", "left").groupBy("id", "window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at")).alias("first")
    )
    return found.join(ranked.select("window", "first.key", "first.at"), "window")


def hits(docs: DataFrame, block: DataFrame, head: bool) -> DataFrame:
    """(row, doc_id, n_words, start, len, items): verified windows; with ``head`` one more row per document."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", item_words(F.col("text")).alias("w")
    ).select("row", "doc_id", "w", (F.concat(F.array(F.lit(HEAD)), "w") if head else F.col("w")).alias("keys"))
    each = rows.select("row", "doc_id", "w", F.posexplode("keys").alias("pos", "word"))
    each = each.withColumn("pos", F.col("pos") - (1 if head else 0))
    start = F.col("pos") - F.col("at")
    length = F.size("window")
    fits = (start >= 0) & (start + length <= F.size("w"))
    same = F.slice("w", F.when(fits, start + 1).otherwise(1), length) == F.col("window")
    joined = each.join(
        F.broadcast(block), (F.col("word") == F.col("key")) & ((F.col("word") == HEAD) | (fits & same)), "inner"
    )
    return joined.select(
        "row", "doc_id", F.size("w").cast("bigint").alias("n_words"), start.alias("start"), length.alias("len"), "items"
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, size: int = 10, block: int = 50_000, few: int = 1_000_000
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, ``items`` (sorted ids), contaminated.

    ``few``: distinct benchmark words up to which their list is broadcast for counting; beyond, it is shuffled.
    """
    found = stored(windows(items, size), "benchmark-windows")
    keyed = stored(with_prefix(found, docs, few), "benchmark-keys")
    spark = docs.sparkSession
    head = spark.range(1).select(
        F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"),
        F.lit(HEAD).alias("key"), F.lit(0).alias("at"),
    )
    blocks = max(1, -(-keyed.count() // block))
    # Blocks by hash; the size bound below holds for each of them, not only on average.
    part = F.pmod(F.xxhash64("window"), F.lit(blocks))
    out = None
    for b in range(blocks):
        some = keyed.filter(part == b) if blocks > 1 else keyed
        some = head.unionByName(some) if b == 0 else some
        one = hits(docs, some, b == 0)
        out = one if out is None else out.unionByName(one)
    span = F.struct("start", "len")
    grouped = out.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list(F.when(F.col("len") > 0, span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(s["start"] + s["len"] - F.greatest(a["end"], s["start"]), F.lit(0))).cast("bigint").alias("n"),
        ),
        lambda a: a["n"],
    )
    return grouped.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items",
        (F.size("spans") > 0).alias("contaminated"),
    )


