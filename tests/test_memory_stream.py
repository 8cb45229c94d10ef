"""The memory stream: any batch borders, replayed batches and compactions give the table that one-by-one upserts give."""

import random

import pytest
from pyspark.sql import functions as F

from skuloom.operators.memory import MEMORY_KEYS, fold_memory, upsert_memory
from skuloom.registry import source
from skuloom.streaming import jobs

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "normalized_brand string, normalized_model_sku string, source_type string, confidence_score int, success_count int, failure_count int, "
    "product_page_url string, dimensions_text string, notes string, first_seen_at string, arrival int"
)


def records(seed, n, keys=6):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (f"b{rng.randrange(keys) ** 2 % keys}", "m", pick("manufacturer", "spec_sheet", "retailer", "other", None), pick(10, 60, 90, None), rng.randrange(3), rng.randrange(2),
         pick("", None, f"u{i}"), pick("", f"d{i}"), pick(None, "", f"n{i}"), pick(None, f"t{i}"), i)
        for i in range(n)
    ]


def table(df):
    return sorted((tuple(r[c] for c in sorted(df.columns) if c != "arrival") for r in df.collect()), key=str)


def one_by_one(spark, start, rows):
    """Rounds of plain upserts: the k-th increment of every key in round k."""
    now, seen = spark.createDataFrame(start, SCHEMA), {}
    rounds = []
    for r in rows:
        k = seen[r[0]] = seen.get(r[0], -1) + 1
        rounds += [[]] * (k + 1 - len(rounds))
        rounds[k] = [*rounds[k], r]
    for part in rounds:
        now = spark.createDataFrame(upsert_memory(now, spark.createDataFrame(part, SCHEMA)).select(*[f.split()[0] for f in SCHEMA.split(", ")]).collect(), SCHEMA)
    return table(now)


@pytest.mark.parametrize(("seed", "borders", "compact"), [(1, [24], 16), (2, [1, 2, 9, 15, 20, 24], 2)])
def test_any_batch_borders(spark, tmp_path, seed, borders, compact):
    start = [r for r in {r[0]: r for r in records(seed + 50, 4)}.values()]
    rows = records(seed, 24)
    log = jobs.MemoryLog(spark, str(tmp_path), spark.createDataFrame(start, SCHEMA), ["arrival"], compact)
    for n, (a, b) in enumerate(zip([0, *borders[:-1]], borders, strict=True)):
        batch = spark.createDataFrame(rows[a:b], SCHEMA).repartition(3)
        log.write(batch, n)
        if n % 2:
            log.write(batch, n)  # a batch that is run again
    assert table(log.now()) == one_by_one(spark, start, rows)


def test_only_touched_records_are_written(spark, tmp_path):
    start = [(f"b{k}", "m", "other", 50, 1, 0, "u", "d", "n", "t", 0) for k in range(50)]
    log = jobs.MemoryLog(spark, str(tmp_path), spark.createDataFrame(start, SCHEMA), ["arrival"])
    log.write(spark.createDataFrame(records(3, 8, keys=3), SCHEMA), 0)
    changed = spark.read.parquet(f"{tmp_path}/changes/batch=0")
    assert changed.count() <= 3 and log.now().count() == 50


def test_stream_of_files(spark, tmp_path):
    """Files in arrival order, the query stopped and started again."""
    rows, folder, outcomes = records(4, 20), str(tmp_path / "table"), str(tmp_path / "in")
    start = spark.createDataFrame([], SCHEMA)
    for a in range(0, 20, 5):
        spark.createDataFrame(rows[a : a + 5], SCHEMA).coalesce(1).write.mode("append").parquet(outcomes)
        if a in (5, 15):
            stream = spark.readStream.schema(start.schema).option("maxFilesPerTrigger", 1).parquet(outcomes)
            out = jobs.run_memory_stream(stream, start, folder, ["arrival"], 2)
    assert table(out) == one_by_one(spark, [], rows)


def test_empty_stream_keeps_the_table(spark, tmp_path):
    memory = source(spark, SF, "source_memory")
    stream = spark.readStream.schema(memory.schema).parquet(str(tmp_path / "none") if (tmp_path / "none").mkdir() is None else "")
    out = jobs.run_memory_stream(stream, memory, str(tmp_path / "t"), ["product_page_url"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, memory.select(*out.columns).collect()), key=str)


def test_fold_is_the_upsert(spark):
    memory, delta = source(spark, SF, "source_memory"), source(spark, SF, "memory_delta")
    touched = delta.select(*MEMORY_KEYS).distinct()
    want = upsert_memory(memory, delta).join(touched, MEMORY_KEYS, "left_semi")
    got = fold_memory(memory, delta, ["product_page_url"]).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.agg(F.count("*")).first()[0] > 0
