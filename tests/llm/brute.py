"""Plain Python versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = tuple(ITEM_WORD.findall(ascii_lower(text)))
        for i in range(max(1, len(w) - size + 1)):
            if w:
                windows[w[i : i + size]].add(str(item))
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w = tuple(ITEM_WORD.findall(ascii_lower(text)))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if w[i : i + n] in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w[i : i + n]]
        yield doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def op3_targets(sizes, weights=(1, 2, 3), most=3):
    """sizes: source -> words; the excess over a full source is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in names}
        full |= above


def shingle_set(text, size=5):
    w = SPACE_WORD.findall(ascii_lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def op4(docs, size=5, percent=80):
    sets = [(d, shingle_set(t, size)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(i)
    seen = set()
    for rows in where.values():
        for x in range(len(rows)):
            for y in range(x):
                pair = rows[y], rows[x]
                if pair in seen:
                    continue
                seen.add(pair)
                a, b = sets[pair[0]][1], sets[pair[1]][1]
                if 100 * len(a & b) >= percent * len(a | b):
                    root[find(pair[0])] = find(pair[1])
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    for i, (d, s) in enumerate(sets):
        yield d, len(s), least[find(i)]


def op5_base(doc, text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            rep |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return (
        doc, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed,
    )


def op9_base(text):
    text = text or ""
    key = "password|passwd|secret|token|api_?key"
    either = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", key)
    out = []
    for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    names = ("assign", "access", "hex")
    n = Counter(k for _, k, _ in out)
    return n[0], n[1], n[2], sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in out)), [(s, k, e) for s, k, e in out]
