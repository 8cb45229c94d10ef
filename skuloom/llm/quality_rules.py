"""Quality rules with thresholds learnt per language and source.

Every document gets five rates in whole thousandths.  Their distribution is kept as a mergeable
quantile sketch: counts per equal-width bucket, one sketch per (language, source).  Sketches add
up, so those of a language and of the whole corpus are sums of the finer ones and need no second
pass.  A group with few documents takes the thresholds of its language, a small language those of
the corpus.  The threshold of a rate is Tukey's outer fence, upper quartile + 3 times the spread
(at least ``slack``), so a group without outliers loses nothing.  Documents are then joined with
the thresholds of their group.

Defined results: a null or empty text has no words and fails the base rule; null language or source
is a group of its own; repeated rows are judged one by one; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.llm.common import let, space_words, stored, without

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# Smallest spread per rate, in thousandths.
SLACK = {"symbols": 20, "dup_lines": 170, "repeats": 150, "capitals": 60, "word_length": 1500}
RATES = tuple(SLACK)
# Rates above this share the last bucket; only mean word length can get there.
TOP = 100_000
BUCKET = {"word_length": 100}


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more in ``words``.

    Window hashes are packed with their position into one number and sorted, so equal windows become
    neighbours (compared by their full hash); work is n log n in the text.
    """

    def marked(w, h):
        bits = F.length(F.bin(F.size(h)))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

        def positions(s):
            def same(x, y):
                return F.coalesce(
                    (F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits))
                    & (F.get(h, x.bitwiseAND(mask).cast("int")) == F.get(h, y.bitwiseAND(mask).cast("int"))),
                    F.lit(False),
                )

            return F.sort_array(
                F.filter(
                    F.transform(
                        s,
                        lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x.bitwiseAND(mask)).otherwise(-1),
                    ),
                    lambda p: p >= 0,
                )
            )

        packed = F.sort_array(F.transform(h, lambda x, k: F.call_function("shiftleft", x, bits).bitwiseOR(k.cast("bigint"))))
        return F.aggregate(
            let(packed, positions),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("bigint"), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    def count(w):
        hashes = F.slice(F.transform(w, lambda x, k: F.xxhash64(x, F.get(w, k + 1), F.get(w, k + 2))), 1, F.size(w) - 2)
        return F.when(
            F.size(w) > 3,
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(marked(w, h))),
        ).otherwise(F.lit(0).cast("bigint"))

    return let(words, count)


def measures(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the base counts, and the rates, one row per document; ``carry`` names columns that pass through."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    base = docs.select("doc_id", "lang", "source", *carry, t.alias("t")).select(
        "doc_id", "lang", "source", *carry,
        space_words(F.col("t")).alias("words"),
        F.length(without(F.col("t"), SPACES)).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))[0].alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).alias("capitals"),
    )
    counted = base.select(
        "doc_id", "lang", "source", *carry,
        F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.n").cast("bigint").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.d")).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), "capitals",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def rate(part: str, whole: str) -> Column:
        return F.coalesce(F.expr(f"1000 * cast({part} AS bigint) div nullif(cast({whole} AS bigint), 0)"), F.lit(0).cast("bigint"))

    return counted.select(
        "doc_id", "lang", "source", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbols"),
        rate("n_dup_lines", "n_lines").alias("dup_lines"),
        rate("n_repeat_words", "n_words").alias("repeats"),
        rate("capitals", "word_chars").alias("capitals"),
        F.least(rate("word_chars", "n_words"), F.lit(TOP)).cast("bigint").alias("word_length"),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """Quantile sketches: (level, lang, source, rate, bucket, n) for groups, languages and the corpus."""
    pairs = F.explode(
        F.array(*[
            F.struct(F.lit(r).alias("rate"), F.expr(f"{r} div {BUCKET.get(r, 1)}").alias("bucket")) for r in RATES
        ])
    )
    group = (
        rows.filter(~F.col("base_failed")).select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", F.col("p.rate").alias("rate"), F.col("p.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    none = F.lit(None).cast("string")
    lang = group.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    corpus = lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    return (
        group.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n")
        .unionByName(lang.select(F.lit(1).alias("level"), "lang", none.alias("source"), "rate", "bucket", "n"))
        .unionByName(corpus.select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "rate", "bucket", "n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n, one upper fence per rate) from the quartiles of each sketch."""
    keys = ["level", "lang", "source", "rate"]
    by = Window.partitionBy(*keys)
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.select(*keys, "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(by).alias("n"))
    quartiles = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("n"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("n"), F.col("bucket"))).alias("q3"),
    )
    return quartiles.groupBy("level", "lang", "source").agg(
        F.max("n").alias("n"),
        *[
            F.max(
                F.when(
                    F.col("rate") == r,
                    (F.col("q3") + 1) * BUCKET.get(r, 1)
                    + 3 * F.greatest((F.col("q3") - F.col("q1")) * BUCKET.get(r, 1), F.lit(SLACK[r])),
                )
            ).alias(f"{r}_max")
            for r in RATES
        ],
    )


def _judged(rows: DataFrame, limit: DataFrame, min_group: int) -> DataFrame:
    """Rows of ``measures`` with ``kept`` and the first broken rate in ``broken``."""
    names = [f"{r}_max" for r in RATES]

    def at(level: int, prefix: str) -> DataFrame:
        part = limit.filter(F.col("level") == level)
        if level < 2:
            part = part.filter(F.col("n") >= min_group)
        keys = ["lang", "source"][: 2 - level]
        return part.select(
            *[F.col(k).alias(f"{prefix}{k}") for k in keys], F.struct(*names).alias(f"{prefix}fence")
        )

    group, lang, corpus = at(0, "g_"), at(1, "l_"), at(2, "c_")
    # At most one row for the corpus, so the outer join below repeats nothing; an aggregate states that bound.
    corpus = corpus.agg(F.first("c_fence").alias("c_fence"))
    joined = (
        rows.join(group, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
        .join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
        .join(F.broadcast(corpus), F.lit(True), "left")
        .withColumn("fence", F.coalesce("g_fence", "l_fence", "c_fence"))
    )
    broken = F.coalesce(*[
        F.when(F.col(r) > F.col(f"fence.{r}_max"), F.lit(r)) for r in RATES
    ])
    return joined.withColumns({
        "kept": ~F.col("base_failed") & broken.isNull(), "broken": F.when(~F.col("base_failed"), broken),
    })


def quality_rules(docs: DataFrame, min_group: int = 200) -> DataFrame:
    """Verdict per document: base counts, ``base_failed``, ``kept`` and the first broken rate in ``broken``.

    ``min_group``: fewer documents than this in a sketch, and the next coarser sketch decides.
    """
    rows = stored(measures(docs), "quality-measures")
    limit = stored(fences(sketches(rows)), "quality-fences")
    return _judged(rows, limit, min_group).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken"
    )


def quality_filter(docs: DataFrame, min_group: int = 200) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns.

    A verdict depends on the row itself and its group's fences, so rows are measured once for the fences and again
    on the way through; texts are not joined with their verdicts.
    """
    limit = stored(fences(sketches(stored(measures(docs), "quality-measures"))), "quality-fences")
    whole = docs.withColumn("_document", F.struct(*docs.columns))
    return _judged(measures(whole, carry=("_document",)), limit, min_group).filter("kept").select("_document.*")
