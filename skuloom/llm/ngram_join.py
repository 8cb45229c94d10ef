"""N-gram Jaccard join by vertical partitioning of one global n-gram order.

All n-grams have a global order: by how often their part of a fixed-size count sketch was hit over all
documents, then by hash.  Any fixed order gives right results; this one puts common passages last.

* Documents with the same n-gram set form a class; only one member goes on.
* The rare head of the order in every set (as many n-grams as a partner may lack, plus one) is dealt to
  fragments.  Two linked sets share an n-gram of their heads, so one fragment sees both.
* Candidates inside a fragment keep the length bound (0.8 of the size) and the position bound.
* Candidate sets are cut vertically into fragments; each fragment counts its own part of the overlap of
  a pair, and the parts are summed per pair.  Only exact counts decide.

No group is turned into all its pairs.  First every set is tested against a few anchors per n-gram and
size band, which joins large groups of near copies into a component.  Then all pairs of sets in
different components that share a head n-gram are tested; pairs inside a component can add no link
that matters.  Head n-grams met in a single component drop out, and the largest component of an n-gram is only
compared with the others.  Before a pair leaves its join it must pass a bitmap bound: every set has a
fixed-size parity bitmap of its n-grams, two bitmaps differ in at most as many bits as the sets in n-grams, so the
overlap is at most (n1 + n2 - differing bits) / 2.

Sets are known by 64-bit hashes of their n-grams.  Defined results: null, empty and wordless texts have
0 shingles and stand alone; a text of fewer words than ``size`` is one shingle; repeated rows are
reported each and linked; a null doc_id stands in its component but names none; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import stored
from skuloom.llm.components import components
from skuloom.llm.shingles import raw_texts, small_batches, windows, word_hashes

BITS = 20  # the count sketch has 2^20 numbers whatever the input
CHUNKS = 16
FILTER_BITS = 25  # bits of the membership filter of candidate sets
MAP_LONGS = 16  # the parity bitmap of a set, in 64-bit numbers
MAP = [f"m{k}" for k in range(MAP_LONGS)]
ANCHORS = 3
HEAVY = 100_000  # n-grams counted more often skip the per-fragment step, so no fragment holds them all


def _set(raw, size: int) -> np.ndarray:
    return np.unique(windows(word_hashes(raw), size))


def _name(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Bit k tells whether an odd number of n-grams hash to k."""
    odd = np.bincount(((tokens >> np.uint64(8)) & np.uint64(64 * MAP_LONGS - 1)).astype(np.int64), minlength=64 * MAP_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _first_pass(size: int):
    """Class and size of every document, and the partition's part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(1 << BITS, np.uint32)
        shift = np.uint64(64 - BITS)
        names = ["chunk", "counts", "doc_id", "n", "node", *MAP]
        any_row = False
        for batch in batches:
            n, node, maps = [], [], []
            for raw in raw_texts(batch["text"]):
                tokens = _set(raw, size)
                np.add.at(counts, (tokens >> shift).astype(np.int64), 1)
                n.append(len(tokens))
                node.append(_name(tokens) if len(tokens) else None)
                maps.append(_parity(tokens))
            maps = np.array(maps, np.int64).reshape(-1, MAP_LONGS)
            any_row = any_row or bool(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1] * len(n), pa.int32()), pa.array([None] * len(n), pa.binary()),
                    batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                    *[pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAP_LONGS)],
                ],
                names,
            )
        if any_row:
            parts = counts.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
                    *[pa.array([None] * CHUNKS, pa.int64())] * (3 + MAP_LONGS),
                ],
                names,
            )

    return run


def _summed(batches: Iterator[pa.RecordBatch]):
    """Sums of the count sketches, chunk by chunk."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
            total[chunk] = total[chunk] + part if chunk in total else part
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
            ["chunk", "counts"],
        )


def _counts(first: DataFrame) -> np.ndarray:
    """The whole sketch: 2^20 numbers, a fixed size, on the driver."""
    rows = first.filter("chunk >= 0").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(_summed, "chunk int, counts binary").collect()
    out = np.zeros((CHUNKS, (1 << BITS) // CHUNKS), np.uint64)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return out.reshape(-1)


def _heads(size: int, percent: int, fragments: int, counts):
    """The head of every set, dealt to fragments; one row per fragment and batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        freq = counts.value
        seen: set[int] = set()
        shift = np.uint64(64 - BITS)
        for batch in batches:
            toks, nodes, sizes, places = [], [], [], []
            for raw in raw_texts(batch["text"]):
                tokens = _set(raw, size)
                n = len(tokens)
                if not n:
                    continue
                node = _name(tokens)
                if node in seen:
                    continue
                seen.add(node)
                head = n - (percent * n + 99) // 100 + 1
                often = freq[(tokens >> shift).astype(np.int64)]
                # np.unique sorted the hashes, so a stable sort by frequency is the global order.
                order = np.argsort(often, kind="stable")[:head]
                toks.append(tokens[order])
                nodes.append(np.full(head, node, np.int64))
                sizes.append(np.full(head, n, np.uint32))
                places.append(np.arange(head, dtype=np.uint32))
            if not toks:
                continue
            tok, node, n, place = map(np.concatenate, (toks, nodes, sizes, places))
            part = (tok % np.uint64(fragments)).astype(np.int32)
            heavy = freq[(tok >> shift).astype(np.int64)] >= HEAVY
            part = np.where(heavy, -1 - (node % fragments).astype(np.int32), part)
            low = (tok >> np.uint64(32)).astype(np.uint32)
            own = (tok % np.uint64(fragments)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            out = [(int(part[g[0]]), b"".join(x[g].tobytes() for x in (node, low, own, n, place))) for g in np.split(order, cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["fragment", "rows"]
            )

    return run


ENTRY = "token bigint, node bigint, n int, place int"


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(token, node, n, place) of packed rows."""
    parts = []
    for blob in blobs:
        m = len(blob) // 24
        node = np.frombuffer(blob, np.int64, m)
        low, own, n, place = (np.frombuffer(blob, np.uint32, m, 8 * m + 4 * m * k) for k in range(4))
        parts.append(((own.astype(np.int64) << 32) | low, node, n.astype(np.int32), place.astype(np.int32)))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def _shared(percent: int):
    """Rows of n-grams that two sets of fitting sizes share; fragments arrive one after the other."""

    def close(fragment: int, blobs: list[bytes]) -> pa.RecordBatch:
        token, node, n, place = _unpacked(blobs)
        if fragment >= 0:
            order = np.lexsort((node, n, token))
            token, node, n, place = token[order], node[order], n[order], place[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n, place = token[new], node[new], n[new], place[new]
            near = (token[1:] == token[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            keep = np.zeros(len(token), bool)
            keep[1:] |= near
            keep[:-1] |= near
            token, node, n, place = token[keep], node[keep], n[keep], place[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(token), pa.array(node), pa.array(n), pa.array(place)], ["token", "node", "n", "place"]
        )

    def run(batches: Iterator[pa.RecordBatch]):
        at, blobs = None, []
        for batch in batches:
            for fragment, blob in zip(batch["fragment"].to_pylist(), batch["rows"].to_pylist(), strict=True):
                if fragment != at and blobs:
                    yield close(at, blobs)
                    blobs = []
                at = fragment
                blobs.append(blob)
        if blobs:
            yield close(at, blobs)

    return run


def _member_bits(batches: Iterator[pa.RecordBatch]):
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = batch["slot"].to_numpy()
        for chunk in np.unique(slot >> 15):
            mine = slot[(slot >> 15) == chunk] & 0x7FFF
            field = bits.setdefault(int(chunk), np.zeros(1 << 12, np.uint8))
            np.bitwise_or.at(field, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
    if bits:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(bits), pa.int32()), pa.array([b.tobytes() for b in bits.values()], pa.binary())], ["chunk", "bits"]
        )


def _slot(node: np.ndarray) -> np.ndarray:
    return (node.astype(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _membership(nodes: DataFrame) -> np.ndarray:
    """A bit per node name prefix: 4 MB on the driver whatever the input; false members only cost traffic."""
    slot = F.call_function("shiftrightunsigned", F.col("node"), F.lit(64 - FILTER_BITS))
    rows = (
        nodes.select(slot.alias("slot")).withColumn("chunk", F.col("slot").bitwiseAND(F.lit((1 << FILTER_BITS) - (1 << 15))))
        .repartition(F.col("chunk")).select("slot").mapInArrow(_member_bits, "chunk int, bits binary").collect()
    )
    out = np.zeros((1 << (FILTER_BITS - 15), 1 << 12), np.uint8)
    for r in rows:
        out[r["chunk"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _pieces(size: int, pieces: int, member):
    """Candidate sets, cut vertically: (node, piece, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]):
        bits = member.value
        seen: set[int] = set()
        for batch in batches:
            nodes, parts, data = [], [], []
            for raw in raw_texts(batch["text"]):
                tokens = _set(raw, size)
                if not len(tokens):
                    continue
                node = _name(tokens)
                slot = int(_slot(np.array([node]))[0])
                if node in seen or not bits[slot >> 3] >> (slot & 7) & 1:
                    continue
                seen.add(node)
                cuts = np.searchsorted(tokens, np.arange(1, pieces, dtype=np.uint64) * np.uint64((1 << 64) // pieces))
                for k, part in enumerate(np.split(tokens, cuts)):
                    if len(part):
                        nodes.append(node)
                        parts.append(k)
                        data.append(part.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["node", "piece", "tokens"]
                )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]):
    """Partial overlap of two pieces."""
    for batch in batches:
        common = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch["a"], batch["b"], batch["na"], batch["nb"], pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"]
        )


def _bounds(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length and position bounds of a pair that meets at places p1 and p2."""
    need = percent * (n1 + n2)  # overlap * (100 + percent) must reach this
    return (
        (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
        & ((100 + percent) * F.least(n1 - p1, n2 - p2) >= need)
    )


def _map_bound(percent: int, n1: Column, n2: Column, x: str, y: str) -> Column:
    """Bitmap bound of a pair whose bitmaps have the column prefixes x and y."""
    differ = sum((F.bit_count(F.col(x + m).bitwiseXOR(F.col(y + m))) for m in MAP), F.lit(0))
    both = n1.cast("bigint") + n2
    return (100 + percent) * (both - differ) >= 2 * percent * both


def _prefixed(maps: DataFrame, prefix: str, key: str) -> DataFrame:
    return maps.select(F.col("node").alias(key), *[F.col(m).alias(prefix + m) for m in MAP])


def _plausible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the bitmap bound."""
    met = pairs.join(_prefixed(maps, "x", "a"), "a").join(_prefixed(maps, "y", "b"), "b")
    return met.filter(_map_bound(percent, F.col("na"), F.col("nb"), "x", "y")).select("a", "b", "na", "nb")


def _anchored(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of every set with the anchors of its n-gram in its own and the next smaller size band.

    The first anchor has the n-gram at the earliest place: it has fewest rarer n-grams of its own, as the text has that a
    group of near copies was made from.  The others are smallest by a hash of the set, so the n-grams of one group choose the same ones.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = entries.withColumn("band", band)
    early = [F.col("place").cast("bigint"), *[F.lit(0).cast("bigint")] * (ANCHORS - 1)]
    ranked = [
        F.min(F.struct(early[k].alias("early"), F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "place", "label")).alias(f"x{k}")
        for k in range(ANCHORS)
    ]
    anchors = rows.groupBy("token", "band").agg(*ranked)
    anchors = anchors.select("token", "band", F.explode(F.array_distinct(F.array(*[F.struct(f"x{k}.node", f"x{k}.n", f"x{k}.place", f"x{k}.label") for k in range(ANCHORS)]))).alias("x")).select(
        "token", F.explode(F.array("band", F.col("band") + 1)).alias("band"),
        F.col("x.node").alias("b"), F.col("x.n").alias("nb"), F.col("x.place").alias("pb"), F.col("x.label").alias("lb"),
    )
    met = rows.join(anchors, ["token", "band"]).filter(
        (F.col("label") != F.col("lb"))
        & _bounds(percent, F.col("n").cast("bigint"), F.col("place"), F.col("nb").cast("bigint"), F.col("pb"))
    )
    return met.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb")


def _across(entries: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a head n-gram and keep all bounds."""
    per = entries.groupBy("token", "label").agg(F.count("*").alias("c"))
    top = per.groupBy("token").agg(F.max(F.struct("c", "label")).alias("t"), F.count("*").alias("labels"))
    top = top.filter("labels > 1").select("token", F.col("t.label").alias("main"))
    # Both sides are the same table, so it is shuffled once.
    rows = entries.join(top, "token").join(maps, "node")
    left = rows.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("label").alias("la"), "main", *[F.col(m).alias("x" + m) for m in MAP])
    right = rows.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"), F.col("main").alias("mb"), *[F.col(m).alias("y" + m) for m in MAP])
    met = left.join(
        right,
        (left["token"] == right["token"]) & (F.col("la") != F.col("main")) & (F.col("la") != F.col("lb"))
        & ((F.col("lb") == F.col("mb")) | (F.col("a") < F.col("b")))
        & _bounds(percent, F.col("na").cast("bigint"), F.col("pa"), F.col("nb").cast("bigint"), F.col("pb"))
        & _map_bound(percent, F.col("na"), F.col("nb"), "x", "y"),
    )
    return met.select("a", "b", "na", "nb")


def _distinct(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    ).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose summed overlaps reach the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), "piece", F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), "piece", F.col("tokens").alias("tb")), ["b", "piece"])
    counted = both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_overlaps, "a bigint, b bigint, na int, nb int, common bigint")
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.filter((100 + percent) * F.col("common") >= percent * (F.col("na").cast("bigint") + F.col("nb"))).select("a", "b")


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, pieces: int = 4, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    ``percent``: two sets link when 100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    longs = ", ".join(f"{m} bigint" for m in MAP)
    first = stored(
        source.mapInArrow(_first_pass(size), f"chunk int, counts binary, doc_id bigint, n bigint, node bigint, {longs}"), "ngram-first"
    )
    counts = spark.sparkContext.broadcast(_counts(first))
    fragments = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = stored(
        source.select("text").mapInArrow(_heads(size, percent, fragments, counts), "fragment int, rows binary")
        .repartition(F.col("fragment")).sortWithinPartitions("fragment").mapInArrow(_shared(percent), ENTRY),
        "ngram-entries",
    )
    maps = first.filter("n > 0").select("node", *MAP).dropDuplicates(["node"])

    def tested(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs, by exact counts; only their sets are read again and shuffled."""
        member = spark.sparkContext.broadcast(_membership(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
        # A set may be cut in several tasks; copies of a piece are the same.
        sets = source.select("text").mapInArrow(_pieces(size, pieces, member), "node bigint, piece int, tokens binary")
        return stored(_verified(pairs, sets.dropDuplicates(["node", "piece"]), percent), "ngram-links")

    alone = entries.withColumn("label", F.col("node"))
    near = stored(_plausible(_distinct(_anchored(alone, percent)), maps, percent), "ngram-anchored")
    links = tested(near)
    label = stored(components(links), "ngram-labels")
    left = entries.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = stored(_distinct(_across(left, maps, percent)).join(near.select("a", "b"), ["a", "b"], "left_anti"), "ngram-across")
    if not more.isEmpty():
        # The stars of the first round stand for its links.
        stars = label.select(F.col("node").alias("a"), F.col("label").alias("b"))
        label = stored(components(stars.unionByName(tested(more))), "ngram-labels")
    found = first.filter("chunk < 0").select("doc_id", "n", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = found.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
