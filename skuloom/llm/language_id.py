"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed and public (a sentencepiece model file; only its list of pieces is used to score).
Training counts pieces per language; scoring gives a word the probability of all its segmentations into
pieces of the vocabulary together (forward algorithm), so no single tokenisation decides.  A text's score is the
posterior of the best language under equal priors.

Piece counts are combined per task and summed by Spark: the model has at most vocabulary times
languages numbers, whatever the corpus.  Words are scored once per task and kept in a cache of bounded size.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text when
nothing was learnt; rows without language do not train; repeated rows count each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.llm.shingles import small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"  # how the vocabulary marks the start of a word
LONGEST = 40  # longer words are scored in runs of this many letters, all of them
FLUSH = 200_000  # words a training task holds
HELD = 600_000  # words whose scores a worker holds
SMOOTH = 0.1


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    runs = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, runs)):
        # Signs such as superscripts, fractions and Roman numerals are word characters, but no letters.
        runs = "".join(c if c.isalpha() else " " for run in runs for c in (*run, " ")).split()
    return [w[i : i + LONGEST] for w in runs for i in range(0, len(w), LONGEST)]


def _piece_counts(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]):
        from sentencepiece import SentencePieceProcessor

        encoder = SentencePieceProcessor(model_proto=model)
        size = encoder.get_piece_size()
        held: dict[str, Counter] = {}
        totals: dict[str, np.ndarray] = {}

        def flush():
            for lang, counter in held.items():
                words = list(counter)
                pieces = encoder.encode(words)
                ids = np.fromiter((p for w in pieces for p in w), np.int64)
                times = np.repeat(np.fromiter(counter.values(), np.int64, len(words)), [len(p) for p in pieces])
                total = totals.setdefault(lang, np.zeros(size))
                total += np.bincount(ids, times, size)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > FLUSH:
                flush()
        flush()
        for lang, total in totals.items():
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(total[ids].astype(np.int64))],
                ["lang", "piece", "n"],
            )

    return run


def learn(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", lang: str = "lang") -> dict:
    """Per-language piece probabilities from the labelled rows of ``docs``."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        model = f.read()
    from sentencepiece import SentencePieceProcessor

    encoder = SentencePieceProcessor(model_proto=model)
    pieces = [encoder.id_to_piece(i) for i in range(encoder.get_piece_size())]
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_piece_counts(model), "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    table = np.full((len(pieces), len(langs)), SMOOTH)
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        np.add.at(table, (found["piece"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]), found["n"].to_numpy())
        table /= table.sum(0)
    ids = {p: i for i, p in enumerate(pieces) if not (encoder.is_control(i) or encoder.is_unknown(i) or encoder.is_byte(i))}
    return {"key": hash(table.tobytes()), "langs": langs, "ids": ids, "p": table, "longest": max(map(len, ids))}


_BASE = np.uint64(0xD1342543DE82EF95)
_SLOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SLOT_BITS = 22
WIDTHS = (4, 8, 12, 16, 24, LONGEST + 1)  # words are scored in groups of similar length


class Pieces:
    """The vocabulary as two slot tables from the hash of a piece to its number."""

    def __init__(self, ids: dict[str, int]):
        self.names = np.zeros(len(ids), np.uint64)
        self.ids = np.fromiter(ids.values(), np.int64, len(ids))
        for k, piece in enumerate(ids):
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            self.names[k] = h
        self.tables = []
        rest = np.arange(len(ids))
        for slot in _SLOTS:
            table = np.full(1 << _SLOT_BITS, -1, np.int32)
            at = (self.names[rest] * slot) >> np.uint64(64 - _SLOT_BITS)
            table[at] = rest
            self.tables.append(table)
            # Pieces whose slot went to another one stand in the next table.
            rest = rest[table[at] != rest]
        if len(rest):
            raise ValueError("two pieces share all their slots")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        for table, slot in zip(self.tables, _SLOTS, strict=True):
            k = table[(h * slot) >> np.uint64(64 - _SLOT_BITS)]
            right = (k >= 0) & (self.names[k] == h)
            out[right] = self.ids[k[right]]
        return out


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Log probability of each word in each language: forward sums over all segmentations, many words at once.

    A letter outside the vocabulary is a piece of its own, equally rare in every language.
    """
    pieces = model.get("pieces")
    if pieces is None:
        pieces = model["pieces"] = Pieces(model["ids"])
    # The last two rows: a letter outside the vocabulary, and no piece at all.
    p = np.vstack([model["p"], np.full((1, len(model["langs"])), 1e-6), np.zeros((1, len(model["langs"])))])
    other, none = len(p) - 2, len(p) - 1
    out = np.zeros((len(words), len(model["langs"])))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    low = 0
    for width in WIDTHS:
        mine = np.flatnonzero((size > low) & (size <= width))
        low = width
        if not len(mine):
            continue
        text = "".join((START + words[k]).ljust(width, "\0") for k in mine)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, width).astype(np.uint64)
        alpha = np.zeros((width + 1, len(mine), len(model["langs"])))
        alpha[0] = 1
        for i in range(width):
            h = np.zeros(len(mine), np.uint64)
            # Words that have a letter here.
            live = np.flatnonzero(codes[:, i])
            for j in range(i, min(width, i + model["longest"])):
                live = live[codes[live, j] != 0]
                if not len(live):
                    break
                h[live] = h[live] * _BASE + codes[live, j]
                found = pieces.find(h[live])
                found[found < 0] = other if j == i else none
                hit = found != none
                alpha[j + 1, live[hit]] += alpha[i, live[hit]] * p[found[hit]]
        out[mine] = np.log(np.maximum(alpha[size[mine], np.arange(len(mine))], 1e-300))
    return out


class _Cache:
    """Scores of words seen by this worker, for one model; emptied when it is full."""

    def __init__(self):
        self.key, self.place, self.table = None, {}, None

    def rows(self, counters: list[Counter], key: int, model: dict) -> np.ndarray:
        if self.key != key or len(self.place) > HELD:
            self.key, self.place, self.table = key, {}, np.zeros((1 << 16, len(model["langs"])))
        new = list(dict.fromkeys(w for c in counters for w in c if w not in self.place))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            at = len(self.place)
            while at + len(part) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(part)] = word_scores(part, model)
            self.place.update(zip(part, range(at, at + len(part)), strict=True))
        return self.table


_CACHE = _Cache()


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        langs = model["langs"]
        for batch in batches:
            counters = [Counter(words_of(t)) for t in batch["text"].to_pylist()]
            if langs:
                table, place = _CACHE.rows(counters, model["key"], model), _CACHE.place
            best, score = [], []
            for c in counters:
                if not c or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                rows = np.fromiter((place[w] for w in c), np.int64, len(c))
                total = np.fromiter(c.values(), np.float64, len(c)) @ table[rows]
                odds = np.exp(total - total.max())
                best.append(langs[int(total.argmax())])
                score.append(float(odds.max() / odds.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(best, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; ``docs`` has doc_id, held_out, text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(
        _predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
