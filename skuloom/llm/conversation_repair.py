"""Conversation structure repair with Four-Russians block tables.

Cheapest edits make the role initials of a conversation read ``(s?(ua)+)?``: keep a row (0), give it the role user or
assistant (3), delete it (4, required for blank and repeated rows), insert an empty user or assistant row (3); an
undeleted truncated row adds 3.  Among cheapest edits the ASCII-least string of their initials is taken.

Rows become symbols, symbols blocks of four, and the normalised cost vectors pass a block by one table lookup
(``four_russians``).  Blocks are then expanded from the last to the first to mark what lies on a cheapest repair,
so that reading forward along marked edits gives the least string.

Rows are sorted by range once, so a conversation of any size lies in consecutive slices, one per partition.  A
slice inside one conversation yields the transitions of all vectors; these are chained per conversation over its slices (at most one
row per partition), then the marks backward, then the states forward, and each slice is traced on its own.  No task holds a conversation;
the rows of a slice are held as one byte each.  Only the hash of a whole repaired conversation is one stream through
one task, which keeps a hash state: SHA-256 can't be split.

Defined results: rows without conversation id form one conversation; a null role or text counts as one space, the turn null
sorts first; rows with equal turns are taken by role, then text; a turn distance beyond 64 bits gives null gaps; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.llm.common import stored, without
from skuloom.llm.four_russians import DELETE, blocks_of, tables, walk

VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
PIECE = 1 << 20
GONE = 255  # no symbol: the place of a conversation of which no row is left


def damaged(rows: DataFrame, parts: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after the damage that crc32 of ``conv_id:turn`` chooses.

    A dropped row stays with ``gone`` set, so that its conversation is not forgotten.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % parts
    text = F.coalesce(F.col("text").cast("string"), space)
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), fault.alias("fault"),
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(fault.isin(0, 1), F.lit("")).when(fault == 2, without(text, ".!?")).otherwise(text).alias("text"),
    )
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows in global order, stored: ``place`` rises with it, ``slice`` is the partition it was sorted in."""
    # Equal rows may be many; their number in the input lets them be dealt to several partitions.
    keys = ["conv_id", "turn", "role", "text", "equal"]
    out = rows.withColumn("equal", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = out.drop("equal").withColumn("place", F.monotonically_increasing_id())
    return stored(out.withColumn("slice", F.shiftright("place", 33)), "turns")


def _symbol(first: Column) -> Column:
    """Base symbol of a row without regard to repetitions; ``first`` is the role's initial."""
    kind = F.when(first == "s", 0).when(first == "u", 2).when(first == "a", 4).otherwise(6)
    text = F.col("text")
    return F.when(F.col("gone"), GONE).when(~text.rlike(VISIBLE), DELETE).otherwise(kind + (~text.rlike(ENDED)).cast("int"))


SEGMENT = (
    "conv_id {kind}, slice long, place long, border boolean, n long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, min_turn long, max_turn long, turns long, symbols binary, map_to array<int>, map_cost array<long>"
)


class _Segment:
    """What is gathered of one conversation within one slice."""

    def __init__(self, conv, place, border):
        self.conv, self.place, self.border = conv, place, border
        self.symbols, self.blank, self.duplicate, self.truncated, self.illegal, self.turns = [], 0, 0, 0, 0, 0
        self.first = self.last = self.min_turn = self.max_turn = None

    def add(self, symbol, initial, turn, again):
        """Rows in order as arrays; ``initial`` and ``turn`` are lists."""
        left = np.flatnonzero(symbol != GONE)
        if not len(left):
            return
        symbol, again = symbol[left], again[left]
        initial, turn = [initial[i] for i in left], [turn[i] for i in left]
        blank = symbol == DELETE
        self.blank += int(blank.sum())
        self.duplicate += int((again & ~blank).sum())
        self.truncated += int((~again & ~blank & (symbol % 2 == 1)).sum())
        self.symbols.append(np.where(again, DELETE, symbol).astype(np.uint8))
        for i in initial:
            if self.last is None:
                self.first = i
            elif self.last + i not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = i
        for t in turn:
            if t is not None and t != self.max_turn:
                self.turns += 1
                self.max_turn = t
                self.min_turn = t if self.min_turn is None else self.min_turn

    def row(self):
        symbols = np.concatenate(self.symbols) if self.symbols else np.zeros(0, np.uint8)
        to, cost = tables().mapping(blocks_of(symbols)) if self.border else (None, None)
        return (
            self.conv, self.place >> 33, self.place, self.border, len(symbols), self.blank, self.duplicate, self.truncated, self.illegal,
            self.first, self.last, self.min_turn, self.max_turn, self.turns, symbols.tobytes(), to, cost,
        )


def _as_batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def _schema(kind, text):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text.format(kind=kind)))


def _runs(batch, open_key):
    """(start, end, key, continues) of the runs of equal (slice, conv_id) in a batch."""
    slices = batch["slice"].to_numpy(zero_copy_only=False)
    codes = batch["conv_id"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((np.diff(slices) != 0) | (np.diff(codes) != 0)) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            key = int(slices[a]), batch["conv_id"][a].as_py()
            yield a, b, key, key == open_key
            open_key = key


def _segments(schema):
    """Segments of sorted rows; a row of kind 0 in front of a row says that it is the first of its text."""

    def run(batches: Iterator[pa.RecordBatch]):
        segment, done, key, marked = None, [], None, -1
        for batch in batches:
            kind, place = (batch[c].to_numpy(zero_copy_only=False) for c in ("kind", "place"))
            before = np.r_[marked, np.where(kind == 0, place, -1)[:-1]]
            marked = int(place[-1]) if kind[-1] == 0 else -1
            keep = np.flatnonzero(kind == 1)
            again = before[keep] != place[keep]
            batch = batch.take(pa.array(keep))
            if not batch.num_rows:
                continue
            symbol = batch["symbol"].to_numpy(zero_copy_only=False)
            initial, turn, at = batch["initial"].to_pylist(), batch["turn"].to_pylist(), batch["place"].to_pylist()
            for a, b, now, continues in _runs(batch, key):
                if not continues:
                    if segment:
                        segment.border |= now[0] != key[0]  # the last one of its slice
                        done.append(segment.row())
                    segment = _Segment(now[1], at[a], key is None or now[0] != key[0])
                    key = now
                segment.add(symbol[a:b], initial[a:b], turn[a:b], again[a:b])
            if done:
                yield _as_batch(done, schema)
                done = []
        if segment:
            segment.border = True
            yield _as_batch([segment.row()], schema)

    return run


def segments(turns: DataFrame) -> DataFrame:
    """One row per conversation and slice with its symbols, fault counts and transitions, stored."""
    text = [F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2")]
    first = turns.filter("NOT gone").groupBy("conv_id", *text).agg(F.min("place").alias("place"))
    none = lambda kind: F.lit(None).cast(kind)
    initial = F.substring("role", 1, 1)
    marks = first.select(
        F.lit(0).alias("kind"), "place", F.shiftright("place", 33).alias("slice"), none(turns.schema["conv_id"].dataType).alias("conv_id"),
        none("long").alias("turn"), none("int").alias("symbol"), none("string").alias("initial"),
    )
    rows = turns.select(
        F.lit(1).alias("kind"), "place", "slice", "conv_id", "turn", _symbol(initial).cast("int").alias("symbol"), initial.alias("initial")
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    out = rows.unionByName(marks).repartition("slice").sortWithinPartitions("slice", "place", "kind")
    return stored(out.mapInArrow(_segments(_schema(kind, SEGMENT)), SEGMENT.format(kind=kind)), "segments")


CHAIN = "conv_id {kind}, slice long, vector int, ends boolean, marks int, best int"
RELATION = CHAIN + ", before array<int>, leads array<int>"
PLACED = "conv_id {kind}, slice long, vector int, ends boolean, best int, marks int, state int"


def _chained(schema):
    """The vector in front of every slice of a conversation, from the transitions of the slices before it."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("slice").to_pylist()
        vector, out = 0, []
        for r in rows:
            out.append([r["conv_id"], r["slice"], vector, False, 0, 0])
            vector = r["map_to"][vector]
        best, marks, _ = tables().ends(vector)
        out[-1][3:] = True, marks, best
        return pa.Table.from_batches([_as_batch(out, schema)])

    return run


def _relations(schema):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            before, leads = [], []
            for symbols, vector in zip(batch["symbols"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                blocks = blocks_of(symbols)
                state = tables().relation(blocks, tables().forward(blocks, vector)[0])
                before.append([m for m, _ in state])
                leads.append([x for _, to in state for x in to])
            new = {"before": pa.array(before, schema.field("before").type), "leads": pa.array(leads, schema.field("leads").type)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in schema.names], schema.names)

    return run


def _placed(schema):
    """Marks behind every slice, from the last one backward, then the state in front of every slice."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("slice").to_pylist()
        marks, behind = rows[-1]["marks"], []
        for r in reversed(rows):
            behind.append(marks)
            marks = r["before"][marks]
        behind.reverse()
        state, out = 0, []
        for r, m in zip(rows, behind, strict=True):
            out.append((r["conv_id"], r["slice"], r["vector"], r["ends"], r["best"], m, state))
            state = r["leads"][4 * m + state]
        return pa.Table.from_batches([_as_batch(out, schema)])

    return run


def _traced(schema):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            audits, costs = [], []
            known = zip(*(batch[c].to_pylist() for c in ("symbols", "vector", "ends", "best", "marks", "state")), strict=True)
            for symbols, vector, ends, best, marks, state in known:
                blocks = blocks_of(symbols)
                vectors, cost = tables().forward(blocks, vector)
                least, last, end = tables().ends(vectors[-1])
                if marks < 0:  # a conversation within one slice
                    best, marks = least, last
                _, paths = tables().backward(blocks, vectors, marks)
                audits.append(walk(paths, end, state, ends)[0])
                costs.append(cost + best)
            new = {"audit": pa.array(audits, pa.string()), "cost": pa.array(costs, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in schema.names], schema.names)

    return run


TRACED = ["conv_id", "slice", "place", "border", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "min_turn", "max_turn", "turns"]


def traced(parts: DataFrame) -> DataFrame:
    """The segments with their edits (``audit``), their cost and the state in front of them, stored."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    border = parts.filter("border")

    def mapped(function, text):
        return {"func": function(_schema(kind, text)), "schema": text.format(kind=kind)}

    chain = border.select("conv_id", "slice", "map_to").groupBy("conv_id").applyInArrow(**mapped(_chained, CHAIN))
    same = (F.col("s.slice") == F.col("c.slice")) & F.col("s.conv_id").eqNullSafe(F.col("c.conv_id"))
    relation = border.select("conv_id", "slice", "symbols").alias("s").join(chain.alias("c"), same).select("c.*", "s.symbols")
    at = relation.mapInArrow(**mapped(_relations, RELATION)).groupBy("conv_id").applyInArrow(**mapped(_placed, PLACED))
    rows = parts.alias("s").join(at.alias("c"), same, "left").select(
        *[f"s.{c}" for c in TRACED], "s.symbols", F.coalesce("c.vector", F.lit(0)).alias("vector"),
        F.coalesce("c.ends", F.lit(True)).alias("ends"), F.coalesce("c.best", F.lit(0)).alias("best"),
        F.coalesce("c.marks", F.lit(-1)).alias("marks"), F.coalesce("c.state", F.lit(0)).alias("state"),
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    text = ", ".join(f"{c} {types[c]}" for c in [*TRACED, "state"]) + ", audit string, cost long"
    return stored(rows.mapInArrow(**mapped(_traced, text)), "traced")


def repaired(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, slice, number, border, role, text) in order of slice and number.

    ``border`` tells that the conversation may go on in another slice.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = parts.select(
        F.lit(0).alias("kind"), "slice", "place", "conv_id", none("string").alias("role"), none("string").alias("text"), "audit", "state", "border"
    )
    rows = turns.filter("NOT gone").select(
        F.lit(1).alias("kind"), "slice", "place", "conv_id", "role", "text", none("string").alias("audit"), none("int").alias("state"),
        none("boolean").alias("border"),
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, slice long, number long, border boolean, role string, text string"
    return heads.unionByName(rows).repartition("slice").sortWithinPartitions("slice", "place", "kind").mapInArrow(_rewritten(_schema(kind, out)), out)


ROLE_BY_STATE = (None, None, "user", "assistant")


def _rewritten(schema):
    def run(batches: Iterator[pa.RecordBatch]):
        head, letters, state, number = None, iter(()), 0, 0
        out = []

        def put(role, text):
            nonlocal number
            number += 1
            out.append((head[0], head[1], number, head[2], role, text))

        def inserted(letter):
            """Rows inserted from ``letter`` on; the first letter that is none."""
            nonlocal state
            while letter == "I":
                state = (2, 2, 3, 2)[state]
                put(ROLE_BY_STATE[state], "")
                letter = next(letters, None)
            return letter

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("kind", "conv_id", "slice", "border", "audit", "state", "role", "text")]
            for kind, conv, piece, border, audit, at, role, text in zip(*columns, strict=True):
                if kind == 0:
                    inserted(next(letters, None))
                    head, letters, state = (conv, piece, border), iter(audit), at
                    continue
                letter = inserted(next(letters, None))
                if letter == "K":
                    state = 1 if state == 0 and role[:1] == "s" else (2, 2, 3, 2)[state]
                    put(role, text)
                elif letter == "R":
                    state = (2, 2, 3, 2)[state]
                    put(ROLE_BY_STATE[state], text)
            if out:
                yield _as_batch(out, schema)
                out.clear()
        inserted(next(letters, None))
        if out:
            yield _as_batch(out, schema)

    return run


def _lines(schema):
    """Hash of every conversation that lies within its slice; of others the text in pieces, each line led by a line end."""

    def run(batches: Iterator[pa.RecordBatch]):
        key, state, held, size, done = None, None, [], 0, []

        def close():
            nonlocal held, size
            if key is not None:
                if key[2]:
                    if held:
                        done.append((key[1], key[0], state, b"".join(held), None))
                else:
                    done.append((key[1], key[0], 0, None, state.hexdigest()))
            held, size = [], 0

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("slice", "conv_id", "border", "role", "text")]
            for piece, conv, border, role, text in zip(*columns, strict=True):
                line = f"\n{role}:{text}".encode()
                if key != (piece, conv, border):
                    close()
                    key, state = (piece, conv, border), 0 if border else hashlib.sha256(line[1:])
                    if not border:
                        continue
                if not border:
                    state.update(line)
                    continue
                held.append(line)
                size += len(line)
                if size >= PIECE:
                    done.append((conv, piece, state, b"".join(held), None))
                    held, size = [], 0
                    state += 1
            if done:
                yield _as_batch(done, schema)
                done.clear()
        close()
        if done:
            yield _as_batch(done, schema)

    return run


def _streamed(schema):
    """Hash of the pieces of each conversation in order, held as a hash state."""

    def run(batches: Iterator[pa.RecordBatch]):
        key, state, started, done = None, None, False, []
        for batch in batches:
            for conv, data in zip(batch["conv_id"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if not started or conv != key:
                    if started:
                        done.append((key, state.hexdigest()))
                    key, started, state = conv, True, hashlib.sha256(data[1:])
                else:
                    state.update(data)
            if done:
                yield _as_batch(done, schema)
                done.clear()
        if started:
            yield _as_batch([(key, state.hexdigest())], schema)

    return run


def hashed(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from the rows of ``repaired``, read in their order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, slice long, piece long, data binary, repaired_sha256 string"
    lines = stored(rows.mapInArrow(_lines(_schema(kind, out)), out), "lines")
    whole = lines.filter("data IS NULL").select("conv_id", "repaired_sha256")
    apart = lines.filter("data IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "slice", "piece")
    out = f"conv_id {kind}, repaired_sha256 string"
    return whole.unionByName(apart.select("conv_id", "data").mapInArrow(_streamed(_schema(kind, out)), out))


def report(parts: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row per conversation from its traced segments and its hash."""
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("prior", F.last("last", True).over(before)).withColumn("prior_turn", F.last("max_turn", True).over(before))
    pair = F.concat("prior", "first")
    seen = seen.withColumn("illegal", F.col("illegal") + F.when(pair.isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0))
    seen = seen.withColumn("turns", F.col("turns") - F.when(F.col("prior_turn") == F.col("min_turn"), 1).otherwise(0))
    columns = ["n", "blank", "duplicate", "truncated", "illegal", "min_turn", "max_turn", "turns", "cost", "slice", "audit"]
    none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in columns]
    both = seen.select("conv_id", *columns, F.lit(None).cast("string").alias("repaired_sha256")).unionByName(
        hashes.select("conv_id", *none, "repaired_sha256")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    audit = F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("slice", "audit"))))
    rows = both.groupBy("conv_id").agg(
        F.min("min_turn").alias("least"), F.max("max_turn").alias("most"), F.sum("turns").alias("turns"),
        *[total(c) for c in ("n", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(audit, lambda x: x["audit"]), "").alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"),
    )
    gaps = F.try_subtract(F.try_add(F.try_subtract("most", "least"), F.lit(1).cast("long")), F.col("turns"))
    return rows.select(
        "conv_id", F.when(F.col("most").isNull(), F.lit(0).cast("long")).otherwise(gaps).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"), F.col("n").alias("n_rows"),
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows, and per conversation its faults, cost, edits and the hash of its repaired rows.

    ``rows`` has conv_id, turn, role, text, and gone (true: only its conversation counts).
    """
    turns = ordered(rows)
    parts = traced(segments(turns))
    fixed = repaired(turns, parts)
    return fixed, report(parts, hashed(fixed))
