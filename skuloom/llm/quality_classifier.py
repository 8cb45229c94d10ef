"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of ASCII letters, digits and non-ASCII bytes, or runs of other signs, with A-Z lower-cased; every word
and every pair of neighbouring words is hashed into one of ``2^BITS`` slots; pairs whose second word is one of the two words
before it share one slot, so that a stuttering text shows whatever its words are.  A text's vector holds for each slot the
number of its n-grams over the root of all n-grams of the text, so a score is one sparse dot product.

Training is distributed: the sample is dealt into shards, every task runs the per-coordinate FTRL-proximal update over
its shard in a fixed order, and Spark averages the state (z, n) of each slot over the shards that touched it.
The average starts the next round.  The model is two arrays of ``2^BITS`` numbers whatever the input.

The classifier is fitted on at most ``max_rows`` labelled documents, one text per labelled id (the ids with the
smallest hashes).  Every document is scored over its whole text, long ones in pieces of ``PIECE`` bytes.

Defined results: null and empty texts get the score of the constant term; without labelled texts every score is 0.5;
ids with several labels count as the largest, null labels and null ids do not train; repeated rows are scored each; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from skuloom.llm.common import stored
from skuloom.llm.shingles import mix, raw_texts

WORD = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
BITS = 18
SLOTS = 1 << BITS
PIECE = 1 << 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
_BASE = np.uint64(0xD1342543DE82EF95)
_SAME = np.uint64(0x9E3779B97F4A7C15)  # the hash of every pair that repeats a word
_SHIFT = np.uint64(64 - BITS)


def pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut between words into pieces of about ``PIECE`` bytes; a longer run without white space stays whole."""
    at = 0
    while len(raw) - at > PIECE:
        cut = re.compile(rb"\s").search(raw, at + PIECE)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def slots(raw: bytes | None) -> Iterator[np.ndarray]:
    """Slots of the words and word pairs of a text, in one array per piece."""
    last = np.zeros(0, np.uint64)
    for piece in pieces(raw.lower()) if raw else ():
        words = WORD.findall(piece)
        if not words:
            continue
        one = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        run = np.r_[last, one]
        at = np.arange(max(1, len(last)), len(run))
        again = (run[at] == run[at - 1]) | ((at > 1) & (run[at] == run[at - 2]))
        two = np.where(again, _SAME, mix(run[at - 1] * _BASE + run[at]))
        last = run[-2:]
        yield (np.r_[one, two] >> _SHIFT).astype(np.int64)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the state (z, n) stands for; most are exactly 0."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def vector(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Different slots of a text and their values; the last slot number is the constant term."""
    count = np.zeros(0, np.int64), np.zeros(0)
    total = 0
    for s in slots(raw):
        total += len(s)
        u, c = np.unique(np.r_[count[0], s], return_inverse=True)
        count = u, np.bincount(c, weights=np.r_[count[1], np.ones(len(s))])
    return np.r_[count[0], SLOTS], np.r_[count[1] / np.sqrt(max(1, total)), 1.0]


def follow(z: np.ndarray, n: np.ndarray, idx: np.ndarray, x: np.ndarray, y: float) -> None:
    """One FTRL-proximal step, in place."""
    zi, ni = z[idx], n[idx]
    w = weights(zi, ni)
    g = (_sigmoid(w @ x) - y) * x
    sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
    z[idx] = zi + g - sigma * w
    n[idx] = ni + g * g


STATE = "slot int, z double, n double, rows long"


def _train(shared):
    """Every run of one shard trains a state of its own, which is emitted where it was touched."""

    def run(batches: Iterator[pa.RecordBatch]):
        shard, state = None, None

        def emitted():
            z, n, touched, rows = state
            at = np.flatnonzero(touched)
            columns = [pa.array(at.astype(np.int32)), pa.array(z[at]), pa.array(n[at]), pa.array(np.full(len(at), rows, np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["slot", "z", "n", "rows"])

        for batch in batches:
            for s, raw, y in zip(batch["shard"].to_pylist(), raw_texts(batch["text"]), batch["label"].to_pylist(), strict=True):
                if s != shard:
                    if state:
                        yield emitted()
                    z, n = shared.value
                    shard, state = s, [z.copy(), n.copy(), np.zeros(SLOTS + 1, bool), 0]
                idx, x = vector(raw)
                follow(state[0], state[1], idx, x, y)
                state[2][idx] = True
                state[3] += 1
        if state:
            yield emitted()

    return run


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, per_shard: int = 1_000) -> DataFrame:
    """Labelled texts (shard, place, label, text) for training, at most ``max_rows``, always the same ones."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    ids = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
    rows = stored(rows, "labelled")
    shards = max(1, min(max_rows, rows.count()) // per_shard)
    return rows.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", "doc_id", "label", "text")


def fit(rows: DataFrame, rounds: int = 3) -> np.ndarray:
    """Weights of all slots and, last, of the constant term from the rows of ``sample``."""
    spark = rows.sparkSession
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((z, n))
        states = dealt.select("shard", "text", "label").mapInArrow(_train(shared), STATE)
        mean = lambda c: (F.sum(F.col(c) * F.col("rows")) / F.sum("rows")).alias(c)
        got = states.groupBy("slot").agg(mean("z"), mean("n")).toArrow()  # one row per slot: at most SLOTS + 1
        at = got["slot"].to_numpy()
        z, n = z.copy(), n.copy()
        z[at], n[at] = got["z"].to_numpy(), got["n"].to_numpy()
    return weights(z, n)


def logits(raws: list[bytes | None], w: np.ndarray) -> np.ndarray:
    """Sparse dot products of whole texts with the weights."""
    out = np.full(len(raws), w[SLOTS])
    for k, raw in enumerate(raws):
        total, count = 0.0, 0
        for s in slots(raw):
            total += w[s].sum()
            count += len(s)
        if count:
            out[k] += total / np.sqrt(count)
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            score = _sigmoid(logits(raw_texts(batch["text"]), shared.value))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, w: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; ``docs`` has doc_id, held_out, text."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(
        _score(shared), f"doc_id {kind}, held_out boolean, score double"
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
