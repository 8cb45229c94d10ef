"""Budgets against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from skuloom.operators.budget import Round, greedy_budget, micro, spend_rounds


def walk(items, cap, per_item):
    granted, left = set(), {}
    for run, ordinal, cost in sorted((i for i in items if i[2] is not None), key=lambda i: (str(i[0]), i[1])):
        m = round(cost * 1_000_000)
        have = left.setdefault(run, micro(cap))
        if m <= 0 or (m <= have and (per_item is None or m <= micro(per_item))):
            granted.add((run, ordinal))
            left[run] = have - max(0, m)
    return granted


@pytest.mark.parametrize(("seed", "per_item"), [(1, None), (2, 0.05), (3, None)])
def test_greedy_budget(spark, seed, per_item):
    rng = random.Random(seed)
    costs = [0.0, 0.01, 0.02, 0.07, 0.3, 0.031, 0.0004, None]
    items = [(r, i * 10**10, rng.choice(costs)) for r in range(4) for i in range(rng.randint(0, 90))]
    items += [(9, i, rng.choice([0.001, 0.2, 0.24, 0.05])) for i in range(1500)]  # one run with most of the rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(items, "run_id long, ordinal long, cost double").repartition(6)
        got = {(x.run_id, x.ordinal) for x in greedy_budget(df, 0.25, per_item).filter("granted").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == walk(items, 0.25, per_item)


def test_greedy_budget_empty(spark):
    assert greedy_budget(spark.createDataFrame([], "run_id long, ordinal long, cost double"), 1.0).collect() == []


@pytest.mark.parametrize("cap", [0.0, 0.05, 0.1, 5.0])
def test_rounds_spend_what_is_left(spark, cap):
    rows = [(f"p{k}", k % 3, k % 2 == 0, k % 5) for k in range(30)]
    products = spark.createDataFrame(rows, "product_key string, effort int, sized boolean, kind int")

    def outcome(granted):
        # Kind 0 needs no paid search, kinds 1 and 2 find a size.
        return granted.select("product_key", (F.col("kind") > 0).cast("int").alias("searches"), F.when(F.col("kind").isin(1, 2), True).alias("sized"))

    rounds = [Round("one", lambda p: F.lit(True)), Round("two", lambda p: ~p["sized"]), Round("three", lambda p: ~p["sized"], 2)]
    grants, ledger = spend_rounds(products, rounds, cap, 0.01, outcome, [F.desc("effort")])
    left, sized = micro(cap), {r[0]: r[2] for r in rows}
    want, book = set(), []
    for n, (need, per) in enumerate([(False, 1), (True, 1), (True, 2)]):
        asked = sorted((r for r in rows if not need or not sized[r[0]]), key=lambda r: (-r[1], r[0]))
        won = asked[: left // (10_000 * per)]
        want |= {(n, r[0], r in won) for r in asked}
        searches = sum(r[3] > 0 for r in won)
        left = max(0, left - searches * 10_000)
        book.append((n, len(asked), len(won), searches, searches * 10_000, left))
        sized |= {r[0]: True for r in won if r[3] in (1, 2)}
    assert {(r["round"], r["product_key"], r["granted"]) for r in grants.collect()} == want
    assert sorted((r["round"], r["open"], r["granted"], r["searches"], r["spent"], r["left"]) for r in ledger.collect()) == book
