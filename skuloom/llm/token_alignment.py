"""Cross-tokenizer alignment by pointer jumping.

Every text is encoded by two public tokenizers, A (byte-level) and B (pieces).  Byte offsets where a token of both ends cut the tokens into
groups.  A token points to the farthest-right token that overlaps it, a token of B that ends with one of A to itself;
doubling these pointers over all tokens of many texts at once leads each token to the last one of its group.

An id pair is linked in a document where its tokens share a group; the count of a pair is the number of documents that
hold it linked.  Tasks gather documents into blocks of about ``per_block`` links.  A block is one row: the digests of its documents, its
different pairs with the number of its documents that hold them, and which document holds which pair how often.  Pairs are then
summed over blocks, the highest count of each A id is found, and both return to the blocks that hold the pair.  What is
shuffled are the different pairs of blocks, so a pair of every document costs a row per block.

Texts are encoded in pieces of about ``PIECE`` characters, cut in front of a space between ASCII letters.  No token of A or B reaches
over such a place and both end there, so the result is that of the whole text.  Large groups are linked by their different ids.

Defined results: null and empty texts, and texts whose A or B bytes differ from space + text, have no tokens (zeros and an empty
``groups_sha256``); repeated rows are documents of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import stored

PIECE = 1 << 16
CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
PACK = 1 << 18  # tokens of A that are aligned at once
LARGE = 1 << 12  # links of a group that are made from its different ids


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """A tokenizer as ids, the bytes of every id, and their lengths."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.digits = [f"{i}{end}".encode() for i in range(len(pieces)) for end in (",", "|", ";")]


# Fixed pattern of byte-level pre-tokenization: how a text is split before pairs are merged.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str) -> Side:
    """A byte-level vocabulary file.

    Where its ids follow its merges, as they do if the vocabulary was written in the order of training, the id is the rank
    of a merge and the ranks go to the faster library; any other file is left to the library that reads it.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte, vocabulary = byte_letters(), file["model"]["vocab"]
    table = [b""] * (max([*vocabulary.values(), *(t["id"] for t in file["added_tokens"])]) + 1)
    for word, i in vocabulary.items():
        table[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
    special = {t["content"] for t in file["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    split = file["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file["normalizer"]
    if plain and all(vocabulary.get("".join(m)) == 256 + k for k, m in enumerate(merges)) and {len(table[i]) for i in range(256)} == {1}:
        import tiktoken

        ranks = {table[i]: i for w, i in vocabulary.items() if w not in special}
        fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [fast.encode_ordinary(" " + t) for t in texts], table)
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return Side(lambda texts: [x.ids for x in slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], table)


@cache
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    if any(b" " in p.lstrip(b" ") for p in pieces):
        raise ValueError("a piece of B reaches over a space: texts can't be cut there")
    return byte_level(path_a), Side(lambda texts: b.encode(texts, num_threads=1), pieces)


def pieces_of(text: str) -> list[str]:
    """The text in pieces; the space between two pieces is in none of them."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = CUT.search(text, at + PIECE)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def encoded(texts: list[str], a: Side, b: Side) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Ids of A and B for every piece of every text; no pieces where the bytes differ from space + text."""
    parts = [pieces_of(t) if t else [] for t in texts]
    flat = list(chain.from_iterable(parts))
    ids, step = [], 64
    for k in range(0, len(flat), step):
        some = flat[k : k + step]
        for text, x, y in zip(some, a.encode(some), b.encode(some), strict=True):
            raw = b" " + text.encode()
            good = b"".join(map(a.pieces.__getitem__, x)) == raw and b"".join(map(b.pieces.__getitem__, y)) == raw
            ids.append((np.array(x, np.int64), np.array(y, np.int64)) if good else None)
    out, at = [], 0
    for p in parts:
        mine = ids[at : at + len(p)]
        at += len(p)
        out.append([] if any(x is None for x in mine) else mine)
    return out


def jumped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of A and B from their byte ends; both must end at the same byte."""
    n = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    last = ends_a[to_a] == ends_b
    point = np.r_[n + to_b, np.where(last, n + np.arange(len(ends_b)), to_a)]
    while True:
        further = point[point]
        if np.array_equal(further, point):
            break
        point = further
    number = np.cumsum(last) - 1
    group = number[point - n]
    return group[:n], group[n:]


def _pairs(ga, gb, ia, ib, na, nb):
    """(index into A's tokens, packed pair, times) of the links; large groups by their different ids."""
    links = na * nb
    small = links <= LARGE
    times = np.where(small[ga], nb[ga], 0)
    first_b = np.cumsum(nb) - nb
    at = np.repeat(np.arange(len(ia)), times)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    pair = ia[at] << 32 | ib[first_b[ga[at]] + offset]
    yield at, pair, np.ones(len(at), np.int64)
    first_a = np.cumsum(na) - na
    for g in np.flatnonzero(~small):
        ua, ca = np.unique(ia[first_a[g] : first_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(ib[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        for k in range(0, len(ua), 256):
            pair = (ua[k : k + 256, None] << 32 | ub[None, :]).ravel()
            yield np.full(len(pair), first_a[g]), pair, (ca[k : k + 256, None] * cb[None, :]).ravel()


def _summed(doc, pair, times):
    """Different (doc, pair) in order with the sums of their times."""
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.zeros(0, int)
    return doc[new], pair[new], np.add.reduceat(times, new) if len(new) else times


class Block:
    """Documents whose digests and pairs make one row."""

    def __init__(self, a: Side, b: Side, digest: pa.Schema):
        self.a, self.b, self.digest = a, b, digest
        self.ids, self.stats, self.hashes = [], [], []
        self.held, self.tokens, self.found, self.links = [], 0, [], 0

    def add(self, doc_id, pieces) -> None:
        self.ids.append(doc_id)
        self.stats.append([0, 0, 0, 0])
        self.hashes.append(hashlib.sha256() if pieces else None)
        for piece in pieces:
            self.held.append((len(self.ids) - 1, *piece))
            self.tokens += len(piece[0])
            if self.tokens >= PACK:
                self.align()

    def align(self) -> None:
        """Group and link the tokens gathered so far."""
        if not self.held:
            return
        docs, xs, ys = zip(*self.held, strict=True)
        self.held, self.tokens = [], 0
        ia, ib = np.concatenate(xs), np.concatenate(ys)
        ga, gb = jumped(np.cumsum(self.a.lengths[ia]), np.cumsum(self.b.lengths[ib]))
        na, nb = np.bincount(ga), np.bincount(gb)
        # All tokens in the order of groups, those of A first: a place for each, and the sign behind it.
        merged = np.empty(len(ia) + len(ib), np.int64)
        place_a = np.arange(len(ia)) + (np.cumsum(nb) - nb)[ga]
        merged[place_a] = ia * 3 + np.r_[ga[1:] != ga[:-1], True]
        merged[np.arange(len(ib)) + np.cumsum(na)[gb]] = ib * 3 + 2 * np.r_[gb[1:] != gb[:-1], True]
        from_b = np.ones(len(merged), bool)
        from_b[place_a] = False
        text_a, text_b = self.a.digits, self.b.digits
        links_to = np.r_[0, np.cumsum(na * nb)]
        end_a, end_b = np.cumsum([len(x) for x in xs]), np.cumsum([len(y) for y in ys])
        start = a0 = b0 = 0
        for doc, a1, b1 in zip(docs, end_a.tolist(), end_b.tolist(), strict=True):
            stop = a1 + b1
            sign = zip(from_b[start:stop].tolist(), merged[start:stop].tolist(), strict=True)
            text = b"".join([text_b[m] if s else text_a[m] for s, m in sign])[:-1]
            stats, state = self.stats[doc], self.hashes[doc]
            if stats[2]:
                state.update(b";")
            state.update(text)
            first, behind = int(ga[a0]), int(ga[a1 - 1]) + 1
            for k, more in enumerate((a1 - a0, b1 - b0, behind - first, int(links_to[behind] - links_to[first]))):
                stats[k] += more
            start, a0, b0 = stop, a1, b1
        owner = np.repeat(np.array(docs), np.diff(np.r_[0, end_a]))
        for at, pair, times in _pairs(ga, gb, ia, ib, na, nb):
            self.found.append(_summed(owner[at], pair, times))
        if len(self.found) > 8:
            self.found = [_summed(*map(np.concatenate, zip(*self.found, strict=True)))]
        self.links += int(links_to[-1])

    def row(self, number: int) -> tuple:
        self.align()
        empty = (np.zeros(0, np.int64),) * 3
        doc, pair, times = _summed(*map(np.concatenate, zip(*(self.found or [empty]), strict=True)))
        pairs, index, holders = np.unique(pair, return_inverse=True, return_counts=True)
        per_doc = np.bincount(doc, minlength=len(self.ids))
        shas = [h.hexdigest() if h else "" for h in self.hashes]
        columns = [self.ids, *zip(*self.stats, strict=True), shas, per_doc]
        digests = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.digest.types, strict=True)], schema=self.digest)
        with pa.ipc.new_stream(sink := pa.BufferOutputStream(), self.digest) as out:
            out.write_batch(digests)
        whole = sink.getvalue().to_pybytes()
        return number, whole, pairs, holders, index.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()


# What a block knows of its documents is one binary value: an Arrow stream of DIGEST.
DIGEST = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int"
BLOCK = "block long, digests binary, pairs array<long>, holders array<int>, index binary, times binary"
RESULT = (
    "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _schema(kind, text):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text.format(kind=kind)))


def _gathered(path_a, path_b, per_block, schema, digest):
    def run(batches: Iterator[pa.RecordBatch]):
        a, b = sides(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 32, Block(a, b, digest)

        def emitted():
            row = block.row(number)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, schema.types, strict=True)], schema.names)

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = part["text"].to_pylist()
                for doc_id, pieces in zip(part["doc_id"].to_pylist(), encoded(texts, a, b), strict=True):
                    block.add(doc_id, pieces)
                    if block.links >= per_block:
                        yield emitted()
                        number, block = number + 1, Block(a, b, digest)
        if block.ids:
            yield emitted()

    return run


def blocks(docs: DataFrame, path_a: str, path_b: str, per_block: int = 4_000_000) -> DataFrame:
    """One row per block of documents, stored."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_gathered(path_a, path_b, per_block, _schema(kind, BLOCK), _schema(kind, DIGEST)), BLOCK), "blocks")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked, and whether no pair of its A id has more; stored."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select("x.pairs", "x.holders")
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    n = stored(n, "pair-counts")
    top = n.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    both = n.withColumn("a", F.shiftright("pair", 32)).join(top, "a")
    return both.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(schema):
    """Rows of a block: first its pairs in order with their counts, then the block itself."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, best = [], []
        for batch in batches:
            kind = batch["kind"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(kind == 1) + 1).tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                pairs = batch.slice(a, b - 1 - a)
                n.append(pairs["n"].to_numpy(zero_copy_only=False))
                best.append(pairs["best"].to_numpy(zero_copy_only=False))
                yield _documents(batch.slice(b - 1, 1).to_pylist()[0], np.concatenate(n), np.concatenate(best), schema)
                n, best = [], []
            rest = batch.slice(edges[-1])
            if rest.num_rows:
                n.append(rest["n"].to_numpy(zero_copy_only=False))
                best.append(rest["best"].to_numpy(zero_copy_only=False))

    return run


def _documents(r, n, best, schema):
    digests = pa.ipc.open_stream(r["digests"]).read_all().combine_chunks()
    index, times = np.frombuffer(r["index"], np.uint32), np.frombuffer(r["times"], np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(digests.num_rows), digests["n_pairs"].to_numpy())
    sums = {}
    for name, value in (("n_best", best), ("count_sum", n)):
        total = np.zeros(digests.num_rows, np.int64)
        np.add.at(total, owner, value.astype(np.int64)[index] * times)
        sums[name] = pa.array(total)
    columns = [sums[c] if c in sums else digests[c].combine_chunks() for c in schema.names]
    return pa.RecordBatch.from_arrays(columns, schema.names)


def align(docs: DataFrame, path_a: str, path_b: str, per_block: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """The digest of every document, and the linked id pairs (pair = A id * 2^32 + B id) with their counts.

    ``docs`` has doc_id and text; the paths name the vocabulary files, readable on every executor.
    """
    rows = blocks(docs, path_a, path_b, per_block)
    kind = dict(docs.dtypes)["doc_id"]
    counts = pair_counts(rows)
    held = rows.select("block", F.posexplode("pairs").alias("place", "pair"))
    binary = [c for c in rows.columns if c not in ("block", "pairs", "holders")]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in binary]
    found = held.join(counts, "pair").select(F.lit(0).alias("kind"), "block", "place", "n", "best", *none)
    whole = rows.select(
        F.lit(1).alias("kind"), "block", F.lit(0).alias("place"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), *binary
    )
    out = RESULT.format(kind=kind)
    both = found.unionByName(whole).repartition("block").sortWithinPartitions("block", "kind", "place")
    return both.mapInArrow(_looked_up(_schema(kind, RESULT)), out), counts
