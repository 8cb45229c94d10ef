"""Quality classifier against plain Python and held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh3_64_intdigest

from skuloom.llm import quality_classifier as q
from skuloom.llm.queries import op11_quality_classifier
from tests.llm import cases

MASK = (1 << 64) - 1


def plain_mix(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * times & MASK
    return x ^ x >> 31


def plain_slots(text):
    words = [xxh3_64_intdigest(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+", (text or "").encode().lower())]
    pairs = [
        0x9E3779B97F4A7C15 if w in words[max(0, k - 1) : k + 1] else plain_mix((words[k] * 0xD1342543DE82EF95 + w) & MASK)
        for k, w in enumerate(words[1:])
    ]
    return Counter(h >> (64 - q.BITS) for h in words + pairs)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_slots(monkeypatch, piece):
    monkeypatch.setattr(q, "PIECE", piece)
    for _, text, *_ in cases.documents():
        got = Counter(np.concatenate([*q.slots(text.encode() if text is not None else None), np.zeros(0, int)]).tolist())
        assert got == plain_slots(text)


def test_update_follows_the_formula():
    """One slot at a time, as the per-coordinate update is stated."""
    rnd, z, n = random.Random(1), [0.0] * 50, [0.0] * 50
    fast_z, fast_n = np.zeros(50), np.zeros(50)
    for _ in range(200):
        idx = sorted(rnd.sample(range(50), 6))
        x, y = [rnd.random() for _ in idx], rnd.randint(0, 1)
        w = [0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2) for i in idx]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, xi, wi in zip(idx, x, w, strict=True):
            g = (p - y) * xi
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * wi
            n[i] += g * g
        q.follow(fast_z, fast_n, np.array(idx), np.array(x), y)
    assert np.allclose(fast_z, z) and np.allclose(fast_n, n)


def test_shards_are_averaged(spark):
    """One round over two shards: every slot takes the mean of the shards that touched it, by their rows."""
    texts = [(0, 1, 1, 1.0, "good words here"), (0, 2, 2, 0.0, "bad | bad"), (1, 3, 3, 0.0, "bad here")]
    rows = spark.createDataFrame(texts, "shard int, place long, doc_id long, label double, text string")
    sums = Counter(), Counter(), Counter()
    for shard in (0, 1):
        z, n, seen = np.zeros(q.SLOTS + 1), np.zeros(q.SLOTS + 1), set()
        mine = [r for r in texts if r[0] == shard]
        for *_, label, text in mine:
            c = plain_slots(text)
            idx = np.array([*sorted(c), q.SLOTS])
            q.follow(z, n, idx, np.array([*(c[k] / math.sqrt(sum(c.values())) for k in sorted(c)), 1.0]), label)
            seen |= set(idx.tolist())
        for s in seen:
            for total, value in zip(sums, (z[s], n[s], 1), strict=True):
                total[s] += value * len(mine)
    z, n = np.zeros(q.SLOTS + 1), np.zeros(q.SLOTS + 1)
    for s, rows_of in sums[2].items():
        z[s], n[s] = sums[0][s] / rows_of, sums[1][s] / rows_of
    assert np.allclose(q.fit(rows, rounds=1), q.weights(z, n))


def test_scores_and_awkward_rows(spark):
    rnd = random.Random(0)
    w = np.array([rnd.uniform(-1, 1) for _ in range(q.SLOTS + 1)])
    table = [(*r, "s", 0.5) for r in cases.documents()]
    docs = spark.createDataFrame([(r[0], r[1], False, "s", 0.5) for r in table], "doc_id long, text string, held_out boolean, shard string, score double")
    got = Counter((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in q.quality(docs, w).collect())
    want = Counter()
    for doc_id, text, *_ in table:
        c = plain_slots(text)
        logit = w[q.SLOTS] + (sum(w[s] * k for s, k in c.items()) / math.sqrt(sum(c.values())) if c else 0)
        score = 1 / (1 + math.exp(-logit))
        want[doc_id, round(score, 9), int(score >= 0.7)] += 1
    assert got == want


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(400)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(60)] + [(1, 0, 1), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in q.sample(docs, labels, max_rows=50, per_shard=10).select("doc_id", "label", "text").orderBy("doc_id").collect()]
    assert len({r[0] for r in got}) == len(got) <= 50 and dict((r[0], r[1]) for r in got)[1] == 1
    assert got == [tuple(r) for r in q.sample(docs.repartition(7), labels, max_rows=50, per_shard=10).select("doc_id", "label", "text").orderBy("doc_id").collect()]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, held_out boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in q.quality(docs, q.fit(q.sample(docs, labels))).collect()] == [(1, False, 0.5, 0)]
    assert q.quality(docs.limit(0), np.zeros(q.SLOTS + 1)).collect() == []


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op11_quality_classifier(spark, folder).collect() if r["held_out"] and r["doc_id"] in known]
    right = Counter((known[r["doc_id"]], r["predicted"]) for r in rows)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) >= 0.97
    assert right[0, 0] / (right[0, 0] + right[0, 1]) >= 0.85
