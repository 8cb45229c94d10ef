"""Money for paid lookups: rounds that write and read a ledger, and the greedy walk that skips what does not fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.operators.groups import stored

MICRO = 1_000_000


def micro(dollars: float) -> int:
    return int(round(dollars * MICRO))


# ------------------------------------------------------------------ rounds


@dataclass(frozen=True)
class Round:
    """A round of lookups: which products take part, and how many searches each may make."""

    name: str
    needs: Callable[[DataFrame], Column]
    searches: int = 1


def spend_rounds(
    products: DataFrame, rounds: list[Round], cap: float, cost: float, outcome: Callable[[DataFrame], DataFrame], order: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """(grants, ledger): the rounds one after the other, each with the money that the one before left.

    ``products`` has product_key; ``order`` ranks them.  In a round the first products that still need it get their searches, as
    many as the money in the ledger pays for.  ``outcome`` gives for granted products (product_key, searches used, and new values of
    columns of ``products``); only used searches are paid, and new values decide who needs the next round.

    ``orderBy().limit()`` keeps the top rows per task and merges them; the ledger has one row per round, whose ``left`` the next
    round reads.  Defined results: without money or need nobody is granted; a product that the outcome does not name used
    nothing; an empty table gives ledger rows of zeros.
    """
    grants, ledger, left, unit = [], [], micro(cap), micro(cost)
    now = products
    for number, this in enumerate(rounds):
        asked = now.filter(this.needs(now))
        most = left // (unit * this.searches) if unit > 0 else 2**31 - 1
        winners = asked.orderBy(*order, "product_key").limit(min(most, 2**31 - 1)).select("product_key", F.lit(True).alias("granted"))
        marked = asked.join(winners, "product_key", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))
        marked = stored(marked.withColumn("round", F.lit(number)), f"budget-round-{number}")
        got = stored(outcome(marked.filter("granted")), f"budget-outcome-{number}")
        none = F.lit(0).cast("long")
        parts = marked.select(F.lit(1).alias("open"), F.col("granted").cast("long").alias("granted"), none.alias("searches")).unionByName(
            got.select(none.alias("open"), none.alias("granted"), F.col("searches").cast("long").alias("searches"))
        )
        total = [F.coalesce(F.sum(c), none).alias(c) for c in ("open", "granted", "searches")]
        spent = F.col("searches") * unit
        entry = stored(
            parts.agg(*total).select(
                F.lit(number).alias("round"), F.lit(this.name).alias("name"), "open", "granted", "searches", spent.alias("spent"),
                F.greatest(none, F.lit(left) - spent).alias("left"),
            ),
            f"ledger-{number}",
        )
        left = entry.first()["left"]  # one row: what the next round may spend
        ledger.append(entry)
        grants.append(marked)
        new = [c for c in got.columns if c in products.columns and c != "product_key"]
        fresh = got.select("product_key", *[F.col(c).alias(f"_new_{c}") for c in new])
        now = now.join(fresh, "product_key", "left").select(
            *[F.coalesce(f"_new_{c}", c).alias(c) if c in new else c for c in products.columns]
        )
    out, book = grants[0], ledger[0]
    for g, e in zip(grants[1:], ledger[1:], strict=True):
        out, book = out.unionByName(g), book.unionByName(e)
    return out, book


# ------------------------------------------------------------------ greedy walk


def greedy_budget(items: DataFrame, cap: float, per_item: float | None = None) -> DataFrame:
    """Walk the items of each run in order; take each that still fits, skip the others.

    Costs are whole micro-dollars.  All items are sorted by range once, so a run of any size lies in consecutive slices.  In a round, items
    that cost more than the money left are out of question, and the others are taken up to the first one that no
    longer fits: sums per slice find the slice it lies in, sums inside that slice find the item.  A slice whose
    cheapest item costs more than is left adds nothing and is skipped whole.  After the round less is left than that item costs, so rounds
    go on only while some later item is cheap enough.  What a round takes is one line (from, to, limit) per run, and
    the items are compared with the lines of their run at the end.

    Defined results: free items and items of negative cost are taken and change nothing; items dearer than ``per_item`` never; a null cost is never taken;
    an empty table gives no rows.
    """
    budget = micro(cap)
    most = budget if per_item is None else min(budget, micro(per_item))
    priced = items.withColumn("micro", F.round(F.col("cost") * MICRO).cast("long"))
    paid = priced.filter((F.col("micro") > 0) & (F.col("micro") <= most)).select("run_id", F.col("ordinal").cast("long").alias("ordinal"), "micro")
    paid = paid.repartitionByRange("run_id", "ordinal").sortWithinPartitions("run_id", "ordinal").withColumn("slice", F.spark_partition_id())
    paid = stored(paid, "greedy-items")
    state = stored(paid.groupBy("run_id").agg(F.lit(None).cast("long").alias("after"), F.lit(budget).cast("long").alias("left")), "greedy-state")
    lines = None
    while True:
        open_ = paid.join(state, "run_id").filter((F.col("micro") <= F.col("left")) & (F.col("after").isNull() | (F.col("ordinal") > F.col("after"))))
        sums = stored(open_.groupBy("run_id", "slice", "left", "after").agg(F.sum("micro").alias("total")), "greedy-slices")
        running = Window.partitionBy("run_id").orderBy("slice")
        upto = sums.withColumn("upto", F.sum("total").over(running))
        # Per run the first slice that can't be taken whole, and the sum in front of it.
        first = upto.filter("upto > left").groupBy("run_id").agg(
            F.min("slice").alias("slice"), F.min_by(F.col("upto") - F.col("total"), "slice").alias("before")
        )
        inside = open_.join(first, ["run_id", "slice"]).withColumn(
            "taken", F.col("before") + F.sum("micro").over(Window.partitionBy("run_id", "slice").orderBy("ordinal"))
        )
        stop = inside.filter("taken > left").groupBy("run_id").agg(
            F.min("ordinal").alias("stop"), F.min(F.col("taken") - F.col("micro")).alias("spent")
        )
        runs = sums.select("run_id", "left", "after").distinct().join(stop, "run_id", "left")
        line = stored(runs.select("run_id", "after", "stop", F.col("left").alias("limit"), (F.col("left") - F.col("spent")).alias("rest")), "greedy-lines")
        lines = line if lines is None else lines.unionByName(line)
        state = stored(line.filter("stop IS NOT NULL").select("run_id", F.col("stop").alias("after"), F.col("rest").alias("left")), "greedy-state")
        if state.isEmpty():
            break
    span = F.struct("after", "stop", "limit")
    per_run = lines.groupBy("run_id").agg(F.collect_list(span).alias("lines"))
    at = F.col("ordinal")
    fits = F.exists(
        "lines",
        lambda x: (x["after"].isNull() | (at > x["after"])) & (x["stop"].isNull() | (at < x["stop"])) & (F.col("micro") <= x["limit"]),
    )
    granted = (F.col("micro") <= 0) | ((F.col("micro") <= most) & F.coalesce(fits, F.lit(False)))
    return priced.join(per_run, "run_id", "left").withColumn("granted", F.coalesce(granted, F.lit(False))).drop("micro", "lines")
