"""Conversation repair against an enumeration of edits and a row-by-row walk."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from skuloom.llm import conversation_repair, four_russians
from skuloom.llm.conversation_repair import damaged, repair
from skuloom.llm.oracle_sql import SQL

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) by a walk that keeps the least edits for each end; rows are (role, text, must go)."""

    def allowed(initials):
        return re.fullmatch("s?(ua)*u?", initials) is not None

    def inserted(known):
        for _ in range(3):
            for initials, (cost, audit, lines) in list(known.items()):
                for role in ("user", "assistant"):
                    put(known, initials + role[0], cost + 3, audit + "I", [*lines, f"{role}:"])
        return known

    def put(known, initials, cost, audit, lines):
        if not allowed(initials):
            return
        end = initials[:1] if len(initials) < 2 and initials != "a" else initials[-1] + "+"
        end = {"u": "u+"}.get(end, end)
        for other in list(known):
            if state(other) == end:
                if known[other][:2] <= (cost, audit):
                    return
                del known[other]
        known[initials] = cost, audit, lines

    def state(initials):
        end = initials[:1] if len(initials) < 2 else initials[-1] + "+"
        return {"u": "u+"}.get(end, end)

    known = inserted({"": (0, "", [])})
    for role, text, gone in rows:
        new = {}
        truncated = 0 if re.search(f"[.!?][{SPACE}]*\\Z", text) else 3
        for initials, (cost, audit, lines) in known.items():
            put(new, initials, cost + 4, audit + "D", lines)
            if not gone:
                if role:
                    put(new, initials + role[0], cost + truncated, audit + "K", [*lines, f"{role}:{text}"])
                for to in ("user", "assistant"):
                    put(new, initials + to[0], cost + 3 + truncated, audit + "R", [*lines, f"{to}:{text}"])
        known = inserted(new)
    return min(v for k, v in known.items() if re.fullmatch("(s?(ua)+)?", k))


def expected(table):
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        role = "user" if fault == 4 else role
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, marked = set(), [0, 0, 0], []
        for _, role, text in rows:
            blank, again = not text.strip(SPACE), (role, text) in seen
            seen.add((role, text))
            truncated = not re.search(f"[.!?][{SPACE}]*\\Z", text)
            for k, bad in enumerate((blank, again, truncated)):
                if bad:
                    faults[k] += 1
                    break
            marked.append((role, text, blank or again))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        turns = {r[0] for r in rows} - {None}
        cost, audit, lines = cheapest(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, sha


def conversations(seed=5, many=120):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Fine.", "What?", "cut off", "", " \t\n", None, "Done!\n ", "a\nb.", "é…", "same text."]
    rows = []
    for conv in [*range(many), None]:
        for turn in range(rnd.randint(1, 9)):
            text = rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.random()}" + rnd.choice([".", "", "?"])
            role = rnd.choice(roles) if rnd.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows + [(1000, 2**40, "user", "Hi."), (1000, -5, "assistant", "Ho."), (1000, None, "system", "Be."), *[(1001, 1, "user", "Copy.")] * 7]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, slice string, place string, kind string"
KEY = lambda r: tuple((x is not None, x) for x in r)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)


def check(spark, rows):
    fixed, out = repair(damaged(frame(spark, rows)))
    got = out.select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(expected(rows), key=KEY)
    return fixed, got


def test_repair(spark):
    rows = conversations()
    fixed, got = check(spark, rows)
    lines = {}
    for r in sorted(fixed.collect(), key=lambda r: (r["slice"], r["number"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in got:
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_one_conversation_over_many_slices(spark, monkeypatch):
    """A third of all rows in one conversation, cut into many slices; pieces of its text are small."""
    monkeypatch.setattr(conversation_repair, "PIECE", 200)
    rnd = random.Random(2)
    hot = [(7, k // 2, rnd.choice(["user", "assistant", "assistant", "tool", "system"]), rnd.choice(["Yes.", "no", f"It is {k}.", ""])) for k in range(700)]
    hot += [(7, 900, "user", "Copy.")] * 300
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = hot + conversations(9, 60)
        check(spark, rows)
        assert conversation_repair.ordered(damaged(frame(spark, rows))).filter("conv_id = 7").select("slice").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nothing_left(spark):
    """Conversations of which every row is dropped stay in the result; an empty table gives none."""
    dropped = [k for k in range(400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    got = repair(damaged(frame(spark, [(k, 0, "user", "Hi.") for k in dropped])))[1].select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == [(k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in dropped]
    assert check(spark, [])[1] == []


def test_statement_agrees_on_awkward_rows():
    rows = conversations(11)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op12_conversation_repair']})").fetchall()
    assert sorted(got, key=KEY) == sorted(expected(rows), key=KEY)


def all_edits(symbols):
    """Every edit string of a symbol string with its cost, with at most two insertions at a place."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def run(at, last, cost, audit, room):
        if at == len(symbols) and last in ("", "a"):
            yield cost, audit
        if room:
            for role in "ua":
                if role in after[last]:
                    yield from run(at, role, cost + 3, audit + "I", room - 1)
        if at < len(symbols):
            symbol = symbols[at]
            yield from run(at + 1, last, cost + 4, audit + "D", 2)
            if symbol != four_russians.DELETE:
                more = 3 * (symbol % 2)
                for role in after[last]:
                    if "suax"[symbol // 2] == role:
                        yield from run(at + 1, role, cost + more, audit + "K", 2)
                    if role != "s":
                        yield from run(at + 1, role, cost + 3 + more, audit + "R", 2)

    return min(run(0, "", 0, "", 2))


@pytest.mark.parametrize("length", range(6))
def test_tables_against_all_edits(length):
    t, rnd = four_russians.tables(), random.Random(length)
    strings = list(itertools.product(range(9), repeat=length))
    for s in rnd.sample(strings, min(len(strings), 400 if length < 5 else 60)):
        blocks = four_russians.blocks_of(bytes(s))
        vectors, cost = t.forward(blocks)
        best, marks, end = t.ends(vectors[-1])
        _, paths = t.backward(blocks, vectors, marks)
        assert (cost + best, four_russians.walk(paths, end, 0, True)[0]) == all_edits(s)
