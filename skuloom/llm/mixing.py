"""Mixing sources to target weights.

The words of a source form one stream, in the order of its documents, cut into blocks of fixed
length; the rest at the end is a short block.  Output slots are grouped into shards.  Each slot draws
a source with probability proportional to the source's planned slots, so the counts of a shard are
multinomial; draws beyond a source's plan go to sources that got too few, so the plan is met exactly.
The k-th slot of a source is pass ``k / blocks`` and place ``k mod blocks`` of that pass, and a
pseudorandom permutation of the block numbers (swap-or-not shuffle, another one for every pass) turns the
place into a block.  Blocks are joined by (source, block number).  Nothing is drawn from a random
generator, so reruns and lost tasks give the same mix.

Targets: sources in code point order weigh ``weights`` in turn and share all words; a target stops
at ``most`` times the source's words and the excess is shared again by weight.

Running numbers over all documents of a source are built in two levels (inside a slice, then over the
slice totals), so no task needs a whole source.

Defined results: null and empty texts have size 0 and are taken 0 times; the null source is one
source, the last; repeated rows are separate documents; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.llm.common import space_words, stored

ROUNDS = 24


def uniform(*parts: Column | str) -> Column:
    """A whole number of 60 bits that depends on all parts alike on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def permuted(k: Column, n: Column, *seed: Column, rounds: int = ROUNDS) -> Column:
    """Place ``k`` of a pseudorandom permutation of 0..n-1 (swap-or-not, Hoang, Morris and Rogaway 2012).

    A round pairs x with key - x (mod n) and swaps the pair or not by one bit, so it is a permutation for any n.
    """
    def step(x, i):
        mate = F.pmod(F.pmod(uniform(*seed, i), n) - x, n)
        swap = F.pmod(uniform(*seed, i, F.greatest(x, mate)), F.lit(2)) == 1
        return F.when(swap, mate).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k.cast("bigint"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    With caps c and weights w the targets are min(c, level * w); the level follows from the sources in
    order of c / w: the first one that the remaining share does not fill ends the full ones.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.array(*[F.lit(w) for w in weights])
    rows = sizes.select(
        "source", "source_size",
        F.get(weight, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).cast("bigint").alias("w"),
        (F.col("source_size") * most).alias("cap"),
    )
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    rows = rows.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    )
    level = (F.col("total") - F.col("before")) / F.col("left")
    rows = rows.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    # The level of the first source that is not filled holds for all later ones, whose own would be lower.
    rows = rows.withColumn("share", F.max("level").over(every))
    return rows.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("share") * F.col("w")), F.col("cap").cast("double")).alias("target"),
    )


def streams(rows: DataFrame, slice_rows: int) -> DataFrame:
    """``first``: words of the same source before each document, in the order of ``slice`` and ``row``."""
    keys = ["sid", "slice"]
    totals = rows.groupBy(*keys).agg(F.sum("size").alias("in_slice"))
    before = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys).orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, keys)
        .withColumn("first", F.col("base") + F.col("inner"))
        .drop("base", "inner")
    )


def slot_plan(plan: DataFrame, n_slots: int, shard: int, seed: int) -> DataFrame:
    """(shard, slot, sid, k): every output slot with its source and its running number there.

    ``plan`` has sid and slots, numbered without gaps from ``lo``.
    """
    spark = plan.sparkSession
    cells = max(64, n_slots // 4096)
    width = max(1, -(-n_slots // cells))
    # Sources spread over the cells that their slots cover, so a draw meets only the sources of its cell.
    covered = plan.filter("slots > 0").select(
        "sid", "lo", "slots", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(lo + slots - 1) div {width}"))).alias("cell")
    )
    draws = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.expr(f"id div {shard}").alias("shard"),
        F.pmod(uniform(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(n_slots)).alias("pick"),
    )
    inside = (F.col("pick") >= F.col("lo")) & (F.col("pick") < F.col("lo") + F.col("slots"))
    drawn = (
        draws.withColumn("cell", F.expr(f"pick div {width}")).join(covered, "cell").filter(inside)
        .select("slot", "shard", "sid", F.col("slots").alias("planned"))
    )
    # Multinomial counts per shard, summed up over the shards of each source.
    counts = stored(drawn.groupBy("sid", "shard").agg(F.count("*").alias("n")), "mix-shard-counts")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
    numbered = drawn.join(offsets, ["sid", "shard"]).select("slot", "shard", "sid", "planned", (F.col("base") + rank).alias("k"))
    # Surplus draws, numbered by source, take the missing places, numbered by source in the same way.
    got = plan.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").select(
        "sid", "slots", F.coalesce("got", F.lit(0)).alias("got")
    )
    run = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    balance = stored(
        got.select(
            "sid", "slots", "got",
            F.coalesce(F.sum(F.greatest(F.col("got") - F.col("slots"), F.lit(0))).over(run), F.lit(0)).alias("over_from"),
            F.greatest(F.col("slots") - F.col("got"), F.lit(0)).alias("lack"),
            F.coalesce(F.sum(F.greatest(F.col("slots") - F.col("got"), F.lit(0))).over(run), F.lit(0)).alias("lack_from"),
        ),
        "mix-balance",
    )
    kept = numbered.filter("k < planned").select("shard", "slot", "sid", "k")
    lacking = balance.filter("lack > 0").select(
        F.col("sid").alias("to"), "got", "lack", "lack_from",
        F.explode(F.sequence(F.expr(f"lack_from div {width}"), F.expr(f"(lack_from + lack - 1) div {width}"))).alias("cell"),
    )
    moved = (
        numbered.filter("k >= planned").join(balance.select("sid", "over_from"), "sid")
        .select("shard", "slot", (F.col("over_from") + F.col("k") - F.col("planned")).alias("r"))
        .withColumn("cell", F.expr(f"r div {width}"))
        .join(lacking, "cell").filter("r >= lack_from AND r < lack_from + lack")
        .select("shard", "slot", F.col("to").alias("sid"), (F.col("got") + F.col("r") - F.col("lack_from")).alias("k"))
    )
    return kept.unionByName(moved)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 256, shard: int = 1024,
    seed: int = 0, slice_rows: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its account.

    First table: (shard, slot, source, block, first, words), the packed output: ``words`` words of the
    source's stream from ``first`` on.  Second table: one row per document with doc_id, size, source,
    source_size, target and ``taken``, the words of it that the mix takes, repeats counted.
    ``block`` words fill a slot and ``shard`` slots an output shard.
    """
    sized = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
            F.size(space_words(F.col("text"))).cast("bigint").alias("size"),
        ),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = targets(per_source.select("source", "source_size"), weights, most)
    # Slots of a source: whole passes over its blocks, then the rest in words, the last slot cut to fit.
    full = F.expr(f"source_size div {block}")
    tail = F.col("source_size") - full * block
    plan = (
        goal.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("bigint"))
        .withColumn("want", F.round("target").cast("bigint"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(0))
        .withColumn("rest", F.when(F.col("source_size") > 0, F.col("want") - F.col("passes") * F.col("source_size")).otherwise(0))
        .withColumn("full", full)
        .withColumn("blocks", F.col("full") + (tail > 0).cast("bigint"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {block} - 1) div {block}"))
    )
    plan = plan.withColumn(
        "lo", F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    plan = stored(plan, "mix-plan")
    n_slots = plan.agg(F.sum("slots")).first()[0] or 0
    drawn = slot_plan(plan.select("sid", "slots", "lo"), n_slots, shard, seed)
    placed = drawn.join(plan.select("sid", "source", "source_size", "full", "blocks", "passes", "rest"), "sid")
    turn = F.expr("k div blocks")
    place = F.col("k") - turn * F.col("blocks")
    # The short block keeps the last place of every pass; the full ones are permuted.
    number = F.when(
        place < F.col("full"), permuted(place, F.greatest(F.col("full"), F.lit(1)), F.lit(seed), F.col("sid"), turn)
    ).otherwise(F.col("full"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    slots = placed.withColumn("turn", turn).withColumn("place", place).withColumn("block", number).select(
        "shard", "slot", "sid", "source", "block", (F.col("block") * block).alias("first"),
        F.when(F.col("turn") < F.col("passes"), length)
        .otherwise(F.least(length, F.col("rest") - F.col("place") * block)).alias("words"),
    )
    slots = stored(slots, "mix-slots")
    # Documents cut at block borders, joined with the slots that take the block.
    slices = F.pmod(F.xxhash64("doc_id"), F.greatest(F.expr(f"docs div {slice_rows}"), F.lit(1)))
    ids = plan.select("source", "sid", "source_size", "target")
    rows = sized.join(
        ids.join(per_source.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s").withColumn("slice", slices)
    rows = stored(streams(rows, slice_rows), "mix-streams")
    pieces = rows.filter("size > 0").select(
        "row", "sid", "first", "size",
        F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))).alias("block"),
    )
    overlap = F.greatest(
        F.lit(0),
        F.least(F.col("first") + F.col("size"), F.col("start") + F.col("words")) - F.greatest("first", "start"),
    )
    taken = (
        pieces.join(slots.select("sid", "block", F.col("first").alias("start"), "words"), ["sid", "block"])
        .groupBy("row").agg(F.sum(overlap).cast("bigint").alias("taken"))
    )
    account = rows.join(taken, "row", "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")
    )
    return slots, account
