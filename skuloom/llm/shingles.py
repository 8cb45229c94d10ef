"""Word and shingle hashes of texts as numpy arrays (used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

# Fixed odd multipliers of the hashes.
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def raw_texts(column) -> list:
    """UTF-8 bytes of every text of an Arrow column; None for null."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def word_hashes(raw: bytes | None) -> np.ndarray:
    """Hashes of the words between spaces, tabs and line ends, with A-Z lower-cased.

    On bytes, ``lower`` changes A-Z only and ``split`` cuts at exactly these six characters.
    """
    words = raw.lower().split() if raw else []
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; of the whole run if there are fewer."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out *= _BASE
        out += words[k : k + n]
    return mix(out + np.uint64(size))


def small_batches(spark, rows: int = 256) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
