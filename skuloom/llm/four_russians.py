"""Block tables for the repair of role sequences (used inside tasks).

A conversation is a string of symbols, one per row: ``2 * class + truncated`` with the classes system, user, assistant,
other; ``DELETE`` for rows that must go; ``PAD`` for no row.  The role initials that remain are accepted by four
states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row; 0 and 3 may end.

The cheapest costs of the four states form a vector.  Reduced by its least entry, with entries above ``CAP`` taken as
unreachable, only a few hundred vectors exist.  ``STEP`` and ``BLOCK`` hold for every such vector and every symbol, or
every block of ``LENGTH`` symbols, the next vector and what was subtracted, so that a block costs one lookup.

A state above the least one by more than ``CAP`` cannot be part of a cheapest repair: inserting a user and an assistant row leads to
state 3 for at most 6 more, and state 3 does what states 0 and 1 can do for at most 4 more.
"""

from __future__ import annotations

from functools import cache

import numpy as np

KEEP, REROLE, DROP, ADD, TRUNCATED = 0, 3, 4, 3, 3
CAP = 12
DEAD = 1 << 20
DELETE, PAD, SYMBOLS = 8, 9, 10
LENGTH = 4
FORCED = (2, 2, 3, 2)  # the state after a user or assistant row of free choice
ENDS = (0, 3)


def row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of everything that may happen to a row, ASCII-least first."""
    if symbol == PAD:
        return [("", 0, state)]
    out = [("D", DROP, state)]
    if symbol != DELETE:
        kind, more = symbol // 2, TRUNCATED * (symbol % 2)
        # A system row is kept only in front; a user or assistant row where the state allows it.
        if kind == 0 and state == 0:
            out.append(("K", KEEP + more, 1))
        if kind in (1, 2) and FORCED[state] == kind + 1:
            out.append(("K", KEEP + more, kind + 1))
        out.append(("R", REROLE + more, FORCED[state]))
    return out


def _closed(v: list[int]) -> list[int]:
    """Costs with any inserted rows."""
    for _ in range(2):
        for state in range(4):
            v[FORCED[state]] = min(v[FORCED[state]], v[state] + ADD)
    return v


def _reduced(v: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(v)
    return tuple(x - least if x - least <= CAP else DEAD for x in v), least


def _step(v: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    new = [DEAD] * 4
    for state in range(4):
        if v[state] < DEAD:
            for _, cost, to in row_edits(symbol, state):
                new[to] = min(new[to], v[state] + cost)
    return _reduced(_closed(new))


class Tables:
    """All normalised vectors and the transitions between them."""

    def __init__(self):
        first, _ = _reduced(_closed([0, DEAD, DEAD, DEAD]))
        self.vectors, number, at = [first], {first: 0}, 0
        rows = []
        while at < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                to, less = _step(self.vectors[at], symbol)
                if to not in number:
                    number[to] = len(self.vectors)
                    self.vectors.append(to)
                row.append((number[to], less))
            rows.append(row)
            at += 1
        self.step = np.array([[a for a, _ in r] for r in rows])
        self.less = np.array([[b for _, b in r] for r in rows])
        # One symbol more at a time: the block number is written in base SYMBOLS, first symbol first.
        to, cost = np.arange(len(rows))[:, None], np.zeros((len(rows), 1), int)
        for _ in range(LENGTH):
            cost = (cost[:, :, None] + self.less[to]).reshape(len(rows), -1)
            to = self.step[to].reshape(len(rows), -1)
        self.block_to, self.block_cost = to.astype(np.int16), cost.astype(np.int32)
        self.expanded: dict = {}

    def expand(self, vector: int, block: int, marks: int) -> tuple[int, tuple]:
        """A block traced backward.

        ``marks`` are the states behind the block that lie on a cheapest repair.  Returns the states in front
        of it that do, and for each state the ASCII-least letters through the block and the state they end in.
        """
        key = vector, block, marks
        got = self.expanded.get(key)
        if got is None:
            if len(self.expanded) > 200_000:
                self.expanded.clear()
            got = self.expanded[key] = self._expand(*key)
        return got

    def _expand(self, vector, block, marks):
        symbols = [block // SYMBOLS ** (LENGTH - 1 - i) % SYMBOLS for i in range(LENGTH)]
        costs, total = [self.vectors[vector]], 0
        for symbol in symbols:
            total += self.less[vector, symbol]
            vector = self.step[vector, symbol]
            costs.append([x + total if x < DEAD else DEAD for x in self.vectors[vector]])
        path = [("", state) if marks >> state & 1 else None for state in range(4)]
        for symbol, here, there in zip(symbols[::-1], costs[-2::-1], costs[:0:-1], strict=True):
            path = self.traced(symbol, here, there, path)
        return sum(1 << s for s in range(4) if path[s]), tuple(path)

    @staticmethod
    def traced(symbol, here, there, path):
        """The least letters from every state before a row, given those behind it."""
        new = [None] * 4
        for state in range(4):
            if here[state] < DEAD:
                ways = [
                    (letter + path[to][0], path[to][1])
                    for letter, cost, to in row_edits(symbol, state)
                    if path[to] and here[state] + cost == there[to]
                ]
                new[state] = min(ways) if ways else None
        return with_inserts(here, new)

    def forward(self, blocks: list[int], vector: int = 0) -> tuple[list[int], int]:
        """Vectors at all block borders and the cost, by lookup."""
        to, cost = self.block_to, self.block_cost
        seen, total = [vector], 0
        for b in blocks:
            total += cost[vector, b]
            vector = int(to[vector, b])
            seen.append(vector)
        return seen, int(total)

    def mapping(self, blocks: list[int]) -> tuple[list[int], list[int]]:
        """For every vector in front: the vector behind and the cost."""
        vector = np.arange(len(self.vectors))
        total = np.zeros(len(vector), np.int64)
        for b in blocks:
            total += self.block_cost[vector, b]
            vector = self.block_to[vector, b]
        return vector.tolist(), total.tolist()

    def ends(self, vector: int) -> tuple[int, int, list]:
        """Cheapest cost above the vector's least entry, states from which it is reached, and the letters still inserted there."""
        v = self.vectors[vector]
        best = min(v[s] for s in ENDS)
        path = with_inserts(v, [("", s) if s in ENDS and v[s] == best else None for s in range(4)])
        return best, sum(1 << s for s in range(4) if path[s]), path

    def backward(self, blocks: list[int], vectors: list[int], marks: int) -> tuple[int, list]:
        """Blocks expanded from the last to the first: marks in front, and every block's paths in order."""
        paths = [()] * len(blocks)
        for k in range(len(blocks) - 1, -1, -1):
            marks, paths[k] = self.expand(vectors[k], blocks[k], marks)
        return marks, paths

    def relation(self, blocks: list[int], vectors: list[int]) -> list[tuple[int, list[int]]]:
        """For every set of marks behind: the marks in front and where each state in front leads (-1: nowhere)."""
        state = [(m, list(range(4))) for m in range(16)]
        for k in range(len(blocks) - 1, -1, -1):
            known = {}
            for i, (m, leads) in enumerate(state):
                if (m, tuple(leads)) not in known:
                    before, path = self.expand(vectors[k], blocks[k], m)
                    known[m, tuple(leads)] = before, [leads[p[1]] if p else -1 for p in path]
                state[i] = known[m, tuple(leads)]
        return state


def with_inserts(costs, path):
    """The least letters from every state at one place, where rows may be inserted."""
    path = list(path)
    for _ in range(2):
        for state in range(4):
            to = FORCED[state]
            if path[to] and costs[state] < DEAD and costs[state] + ADD == costs[to]:
                way = "I" + path[to][0], path[to][1]
                path[state] = min(path[state], way) if path[state] else way
    return path


def blocks_of(symbols: bytes | np.ndarray) -> list[int]:
    """Numbers of the blocks of a symbol string, filled up with PAD."""
    s = np.frombuffer(symbols, np.uint8) if isinstance(symbols, bytes) else symbols
    s = np.r_[s, np.full(-len(s) % LENGTH, PAD, np.uint8)].reshape(-1, LENGTH).astype(int)
    return (s @ (SYMBOLS ** np.arange(LENGTH - 1, -1, -1))).tolist()


@cache
def tables() -> Tables:
    return Tables()


def walk(paths: list, end: list, state: int, last: bool) -> tuple[str, int]:
    """Letters along the expanded blocks from a state; behind the last segment also the rows inserted at the end."""
    out = []
    for path in paths:
        letters, state = path[state]
        out.append(letters)
    if last:
        letters, state = end[state]
        out.append(letters)
    return "".join(out), state
