"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected positions are kept: in every run of ``least - reach + 1`` words starts the
minimiser is the start whose 8-word hash is smallest, so any passage of ``least`` words that occurs twice keeps
the same position in both.  Kept suffixes, known by their first ``reach`` words, are dealt to ranges of one
order, sorted, and compared with their neighbours; a suffix without an equal neighbour takes no part in any
repeat.  Around the others matches are extended left and right word by word: every run of ``least`` words that
contains such a suffix is hashed, sorted by range and compared with its neighbours again.  Overlapping repeated
runs of a document are one passage.

A run counts as repeated when two documents have it.  Equal suffixes and runs within a batch collapse before
they are shuffled, so a passage that many documents share costs one entry per batch.  What leaves the first step is a bit field of fixed size; false
members only cost traffic.  Words are known by 64-bit hashes.

Defined results: null and empty texts and texts of fewer than ``least`` words have no repeats; rows with the
same doc_id are separate documents; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import stored
from skuloom.llm.shingles import raw_texts, small_batches, windows, word_hashes

BITS = 27
RANGES = 1024  # ranges of the order of suffixes and runs: the top 10 bits of their hashes
RANGE_BITS = 10
GRAM = 8
BATCH = 1024


def _range_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - RANGE_BITS)).astype(np.int32)


def minimisers(words: np.ndarray, least: int, reach: int) -> np.ndarray:
    """For every run of ``least`` words, where its selected suffix starts."""
    width = least - reach + 1
    order = windows(words, GRAM)[: len(words) - reach + 1]
    view = np.lib.stride_tricks.sliding_window_view(order, width)
    return np.arange(len(view)) + view.argmin(1)


def _split(part: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Columns packed into one blob per value of ``part``."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[g[0]]), b"".join(c[g].tobytes() for c in columns)) for g in np.split(order, cuts)] if len(part) else []


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["part", "kind", "data"],
    )


BLOB = "part int, kind int, data binary"


def _suffixes(least: int, reach: int):
    """Hashes of kept suffixes by range; kind 1 are those that two documents of the batch share."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for raw in raw_texts(batch["text"]):
                words = word_hashes(raw)
                if len(words) >= least:
                    found.append(np.unique(windows(words, reach)[np.unique(minimisers(words, least, reach))]))
            if found:
                key, times = np.unique(np.concatenate(found), return_counts=True)
                rows = [(p, 0, d) for p, d in _split(_range_of(key[times == 1]), key[times == 1])]
                rows += [(p, 1, d) for p, d in _split(_range_of(key[times > 1]), key[times > 1])]
                yield _blobs(rows)

    return run


def _by_part(batches: Iterator[pa.RecordBatch]):
    """(part, {kind: blobs}) of sorted input, one part in memory at a time."""
    at, held = None, {}
    for batch in batches:
        for part, kind, data in zip(*(batch[c].to_pylist() for c in ("part", "kind", "data")), strict=True):
            if part != at and held:
                yield at, held
                held = {}
            at = part
            held.setdefault(kind, []).append(data)
    if held:
        yield at, held


def _repeated_suffixes(batches: Iterator[pa.RecordBatch]):
    """Bit field of the range: suffixes with an equal neighbour."""
    for part, held in _by_part(batches):
        key = np.sort(np.frombuffer(b"".join(held.get(0, [])), np.uint64))
        known = np.frombuffer(b"".join(held.get(1, [])), np.uint64)
        # One entry of another batch beside a known one is repeated as well; it has the same bit.
        slot = np.concatenate([key[1:][key[1:] == key[:-1]], known]) >> np.uint64(64 - BITS)
        slot = slot.astype(np.int64) & ((1 << (BITS - RANGE_BITS)) - 1)
        bits = np.zeros(1 << (BITS - RANGE_BITS - 3), np.uint8)
        np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])


def _bit_field(rows) -> np.ndarray:
    out = np.zeros((RANGES, 1 << (BITS - RANGE_BITS - 3)), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


# Kinds of blobs in the second step: runs to be compared (by range), runs known as repeated and
# the documents they belong to (both by bucket, sent past the ranges under negative numbers).
RUN, KNOWN, DOCUMENT = 0, 1, 2
BUCKETS = 512


def _bucket(row: np.ndarray) -> np.ndarray:
    return ((row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int32)


def _runs(least: int, reach: int, member):
    """Runs of ``least`` words around suffixes that repeat."""

    def run(batches: Iterator[pa.RecordBatch]):
        bits = member.value
        for batch in batches:
            ids, docs = batch["row"].to_pylist(), batch["doc_id"].to_pylist()
            hashes, rows, starts, about = [], [], [], []
            for k, raw in enumerate(raw_texts(batch["text"])):
                words = word_hashes(raw)
                if len(words) < least:
                    continue
                slot = (windows(words, reach)[minimisers(words, least, reach)] >> np.uint64(64 - BITS)).astype(np.int64)
                at = np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)
                if len(at):
                    hashes.append(windows(words, least)[at])
                    rows.append(np.full(len(at), ids[k], np.int64))
                    starts.append(at.astype(np.int32))
                    # No doc_id is sent as the smallest number.
                    about.append((ids[k], docs[k] if docs[k] is not None else -(1 << 63), len(words)))
            if not hashes:
                continue
            h, row, start = map(np.concatenate, (hashes, rows, starts))
            order = np.lexsort((start, row, h))
            h, row, start = h[order], row[order], start[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.append(first, len(h)))
            shared = row[first] != row[first + size - 1]
            known = np.repeat(shared, size)
            send = ~known
            send[first[shared]] = True
            out = [(p, RUN, d) for p, d in _split(_range_of(h[send]), h[send], row[send], start[send])]
            out += [(-1 - p, KNOWN, d) for p, d in _split(_bucket(row[known]), row[known], start[known])]
            own = np.array(about, np.int64)
            out += [(-1 - p, DOCUMENT, d) for p, d in _split(_bucket(own[:, 0]), own[:, 0].copy(), own[:, 1].copy(), own[:, 2].copy())]
            yield _blobs(out)

    return run


def _repeated_runs(batches: Iterator[pa.RecordBatch]):
    """Runs with an equal neighbour of another document, by bucket of the document; others pass through."""
    for part, held in _by_part(batches):
        if part < 0:
            yield _blobs([(-1 - part, kind, data) for kind, blobs in held.items() for data in blobs])
            continue
        cols = []
        for data in held[RUN]:
            m = len(data) // 20
            cols.append((np.frombuffer(data, np.uint64, m), np.frombuffer(data, np.int64, m, 8 * m), np.frombuffer(data, np.int32, m, 16 * m)))
        h, row, start = (np.concatenate([c[k] for c in cols]) for k in range(3))
        order = np.lexsort((row, h))
        h, row, start = h[order], row[order], start[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.append(first, len(h)))
        known = np.repeat(row[first] != row[first + size - 1], size)
        yield _blobs([(p, KNOWN, d) for p, d in _split(_bucket(row[known]), row[known], start[known])])


def _passages(least: int):
    """Overlapping runs of a document joined into passages: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]):
        for _, held in _by_part(batches):
            docs = {}
            for data in held.get(DOCUMENT, []):
                m = len(data) // 24
                for r, d, n in zip(*(np.frombuffer(data, np.int64, m, 8 * m * k).tolist() for k in range(3)), strict=True):
                    docs[r] = (None if d == -(1 << 63) else d, n)
            cols = []
            for data in held.get(KNOWN, []):
                m = len(data) // 12
                cols.append((np.frombuffer(data, np.int64, m), np.frombuffer(data, np.int32, m, 8 * m)))
            if not cols:
                continue
            row, start = (np.concatenate([c[k] for c in cols]) for k in range(2))
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + least)])
            end = np.append(begin[1:], len(row)) - 1
            spans: dict[int, list] = {}
            for r, a, b in zip(row[begin].tolist(), start[begin].tolist(), start[end].tolist(), strict=True):
                spans.setdefault(r, []).append({"start": a, "end": b + least})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[r][0] for r in spans], pa.int64()), pa.array([docs[r][1] for r in spans], pa.int64()),
                    pa.array(list(spans.values()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "passages"],
            )

    return run


def suffix_dedup(docs: DataFrame, least: int = 50, reach: int = 30, text: str = "text") -> DataFrame:
    """Documents with passages of at least ``least`` words that other documents have too.

    doc_id, n_words and ``passages``, sorted disjoint (start, end) in words, end exclusive.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )

    def dealt(df):
        return df.repartition(F.col("part")).sortWithinPartitions("part")

    field = dealt(source.select("text").mapInArrow(_suffixes(least, reach), BLOB)).mapInArrow(_repeated_suffixes, "part int, bits binary")
    member = spark.sparkContext.broadcast(_bit_field(field.toLocalIterator()))
    runs = dealt(source.mapInArrow(_runs(least, reach, member), BLOB)).mapInArrow(_repeated_runs, BLOB)
    out = dealt(runs).mapInArrow(_passages(least), "doc_id bigint, n_words bigint, passages array<struct<start:bigint,end:bigint>>")
    return stored(out, "passages")
