"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary text.  A window is
compressed with both, and the difference of the lengths says which text it resembles.  Windows are single
words written two or three times, which lets a match of a few bytes show in the length; the
differences of the three window forms are added up.  Differences are calibrated on the same labelled documents that the
dictionaries are trained on, so the threshold may be too optimistic for unseen texts: each value has a log odds, a document's features are the sum of the log odds of all
its windows, that sum over the root of their number, and the number; logistic regression makes a probability of
them, shifted so that 0.5 is the threshold with the best F1.

The classifier is fitted on at most ``max_toxic`` toxic and ``max_ordinary`` ordinary labelled documents
of at most ``max_chars`` characters (the ones with the smallest hash of their id).  The toxic dictionary is trained on at most ``most_words``
over-represented words, the ordinary one on at most 200,000 windows of the sample in a fixed random order.  Every document is scored over its whole text.

Defined results: null and empty texts get the score of a text without windows; without both classes in the
sample every score is 0; repeated rows are scored each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.llm.shingles import small_batches

LETTERS = re.compile(r"[^\W\d_]+")
FORMS = ((2, b" "), (3, b" "), (3, b", "))
TOXIC_BYTES, ORDINARY_BYTES = 1536, 4096
LEVEL = 13
BUCKETS = 16
NEUTRAL = 4  # bucket of difference 0
LONGEST = 64  # longer words are windows of this many letters each
CACHE = 300_000


def words_of(text: str | None) -> list[bytes]:
    return [w[i : i + LONGEST].encode() for w in LETTERS.findall(text.lower()) for i in range(0, len(w), LONGEST)] if text else []


class Distance:
    """Difference of a window's lengths under the two dictionaries, as a bucket number."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        def compressor(data):
            shared = zstandard.ZstdCompressionDict(data)
            shared.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False
            )

        self.toxic, self.ordinary, self.known = compressor(toxic), compressor(ordinary), {}

    def __call__(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            diff = 0
            for times, gap in FORMS:
                window = gap + gap.join([word] * times) + gap
                diff += len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
            got = min(BUCKETS - 1, max(0, diff + NEUTRAL))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = got
        return got

    def histogram(self, words: list[bytes]) -> np.ndarray:
        return np.bincount([self(w) for w in words], minlength=BUCKETS).astype(float)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    samples = samples * max(1, -(-8000 // max(1, len(samples))))
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        # Too few different samples to train on: the samples themselves are the dictionary.
        return b"".join(dict.fromkeys(samples))[-size:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights by Newton steps; the last one is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def _features(hist: np.ndarray, odds: np.ndarray) -> np.ndarray:
    n = hist.sum(1)
    total = hist @ odds
    return np.stack([np.clip(total, -20, 20) / 5, np.clip(total / np.sqrt(n + 1), -5, 5), np.log1p(n) / 5], 1)


def fit(toxic: list[str], ordinary: list[str], z_least: float = 6.0, most_words: int = 120) -> dict | None:
    """Dictionaries and calibration from two lists of texts; None without both."""
    if not toxic or not ordinary:
        return None
    rnd = random.Random(0)
    sides = [[words_of(t) for t in texts] for texts in (toxic, ordinary)]
    df = [Counter(w for words in side for w in set(words)) for side in sides]
    n = [len(side) for side in sides]

    def z(word):
        a, b = df[0][word], df[1].get(word, 0)
        p = (a + b) / (n[0] + n[1])
        return (a / n[0] - b / n[1]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)

    # Windows of toxic text that ordinary text lacks; the rest of it is ordinary.
    ranked = sorted(((z(w), w) for w, c in df[0].items() if c >= min(4, n[0])), reverse=True)
    chosen = [w for s, w in ranked if s >= z_least][:most_words] or [w for _, w in ranked[:10]]
    marked = [b" " + w + b" " for w in chosen for _ in range(df[0][w])]
    plain = [b" " + w + b" " for words in sides[1] for w in words]
    rnd.shuffle(marked)
    rnd.shuffle(plain)
    data = _dictionary(TOXIC_BYTES, marked), _dictionary(ORDINARY_BYTES, plain[:200_000])
    distance = Distance(*data)
    hist = [np.array([distance.histogram(w) for w in side]) for side in sides]
    share = [(h.sum(0) + 1) / (h.sum() + BUCKETS) for h in hist]
    odds = np.log(share[0] / share[1])
    x = np.vstack([_features(h, odds) for h in hist])
    y = np.r_[np.ones(n[0]), np.zeros(n[1])]
    w = _logistic(x, y)
    logit = np.hstack([x, np.ones((len(x), 1))]) @ w
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + n[0])
    best = int(f1.argmax())
    cut = (logit[order[best]] + logit[order[min(best + 1, len(y) - 1)]]) / 2
    w[-1] -= cut
    return {"data": data, "odds": odds, "w": w}


def sample(
    docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_ordinary: int = 6000, max_chars: int = 20_000
) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts, toxic and ordinary, always the same rows."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.filter(F.length("text") <= max_chars)
    order = F.xxhash64("doc_id")
    out = []
    for value, most in ((1, max_toxic), (0, max_ordinary)):
        ids = known.filter(F.col("toxic") == value)
        # The ids are cut before the texts are read: 4 times as many as needed, for those that are too long.
        ids = ids.orderBy(order, "doc_id").limit(4 * most).select("doc_id")
        rows = short.join(F.broadcast(ids), "doc_id").select("doc_id", "text").orderBy(order, "doc_id", "text").limit(most).collect()
        out.append([r["text"] for r in rows])
    return out[0], out[1]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        distance = Distance(*model["data"]) if model else None
        for batch in batches:
            texts = batch["text"].to_pylist()
            if model is None:
                score = np.zeros(len(texts))
            else:
                hist = np.array([distance.histogram(words_of(t)) for t in texts]).reshape(-1, BUCKETS)
                x = _features(hist, model["odds"])
                logit = np.hstack([x, np.ones((len(x), 1))]) @ model["w"]
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; ``docs`` has doc_id, held_out, text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(
        _score(shared), f"doc_id {kind}, held_out boolean, score double"
    )
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
