"""Recompression: a run-length grammar of integer sequences, and longest
common extensions read from it.

``Grammar`` holds many sequences one after another, each between separators
that occur once. Rounds alternate: block compression replaces each maximal
block of one symbol by a symbol for (symbol, length); pair compression
splits the alphabet in two by a hash and replaces each pair of a left and a
right symbol. Equal places get equal symbols in a round, so a round's symbols
tell equal stretches without looking inside.

An extension query climbs while both places begin a symbol of the next round
(else it compares one symbol or block, after which both do), and on a
difference goes down to it. A round costs a constant number of steps, and all
queries take them together as arrays. Results are exact; the hash decides
only how fast sequences shrink.
"""
from __future__ import annotations

import numpy as np

SHORT = 8  # rounds end when no sequence has more symbols than this
ROUNDS = 400


class _Round:
    """Symbols of a round, and how they make up those of the next."""

    __slots__ = ("symbols", "parent", "first", "blocks")

    def __init__(self, symbols: np.ndarray, heads: np.ndarray, blocks: bool):
        self.symbols, self.blocks = symbols, blocks
        self.first = np.append(heads, symbols.size).astype(np.int32)  # of a symbol of the next round
        self.parent = np.repeat(np.arange(heads.size, dtype=np.int32), np.diff(self.first))


class Grammar:
    def __init__(self, sequences: list[np.ndarray]):
        """``sequences``: integers from 0 on. Sequence k stands at
        ``starts[k]`` of ``symbols``."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        words = max((int(s.max()) for s in sequences if len(s)), default=-1) + 1
        self.starts = 1 + np.concatenate(([0], np.cumsum(sizes + 1)))[:len(sequences)]
        text = np.empty(int(sizes.sum()) + sizes.size + 1, np.int32)
        marks = np.concatenate(([0], self.starts + sizes))
        text[marks] = words + np.arange(marks.size)
        for at, s in zip(self.starts.tolist(), sequences):
            text[at:at + len(s)] = s
        self.symbols = text
        self.rounds: list[_Round] = []
        self._low, self._high = words, words + marks.size  # separators
        self._next = self._high
        for k in range(ROUNDS):
            text = self._blocks(text)
            ends = np.flatnonzero((text >= self._low) & (text < self._high))
            if np.diff(ends).max(initial=0) - 1 <= SHORT:
                break
            text = self._pairs(text, k)
        self.top = text

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """A new symbol for each distinct key."""
        distinct, number = np.unique(keys, return_inverse=True)
        out = (self._next + number).astype(np.int32)
        self._next += distinct.size
        return out

    def _blocks(self, text: np.ndarray) -> np.ndarray:
        heads = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        if heads.size == text.size:
            return text
        out, length = text[heads], np.diff(np.append(heads, text.size))
        long = np.flatnonzero(length > 1)
        out[long] = self._named(out[long].astype(np.int64) << 32 | length[long])
        self.rounds.append(_Round(text, heads, True))
        return out

    def _pairs(self, text: np.ndarray, k: int) -> np.ndarray:
        x = (text.astype(np.uint32) + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * k)
        side = (x >> np.uint32(31)).astype(bool)
        free = (text < self._low) | (text >= self._high)
        left, right = side & free, ~side & free
        pair, other = left[:-1] & right[1:], right[:-1] & left[1:]
        if other.sum() > pair.sum():
            pair = other
        if not pair.any():
            return text
        second = np.concatenate(([False], pair))
        heads = np.flatnonzero(~second)
        out = text[heads]
        at = np.flatnonzero(pair)
        # as many symbols before a pair's first as heads before it
        mine = at - np.cumsum(second)[at]
        out[mine] = self._named(text[at].astype(np.int64) << 32 | text[at + 1])
        self.rounds.append(_Round(text, heads, False))
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on (i != j)."""
        return self._first_difference(i, j, 1) - i

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i, it included, equal those up to j."""
        return i - self._first_difference(i, j, -1)

    def _first_difference(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """The place in i's stretch where it first differs from j's."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        stop = np.full(a.size, len(self.rounds))
        active = np.arange(a.size)
        for k, r in enumerate(self.rounds):
            if not active.size:
                break
            x, y = a[active], b[active]
            # where both begin a symbol of the next round they go up at once
            inner = (self._rest(r, x, way, True) > 0) | (self._rest(r, y, way, True) > 0)
            ended = np.zeros(active.size, bool)
            at = np.flatnonzero(inner)
            x[at], y[at], ended[at] = self._step(r, x[at], y[at], way)
            a[active], b[active] = x, y
            stop[active[ended]] = k
            active = active[~ended]
            a[active], b[active] = r.parent[a[active]], r.parent[b[active]]
        while active.size:
            active = active[self.top[a[active]] == self.top[b[active]]]
            a[active] += way
            b[active] += way
        for k in range(len(self.rounds) - 1, -1, -1):
            r, at = self.rounds[k], np.flatnonzero(stop > k)
            x, y = a[at], b[at]
            x, y = (r.first[x], r.first[y]) if way > 0 else (r.first[x + 1] - 1, r.first[y + 1] - 1)
            a[at], b[at], _ = self._step(r, x.astype(np.int64), y.astype(np.int64), way)
        return a

    @staticmethod
    def _rest(r: _Round, x: np.ndarray, way: int, behind: bool = False) -> np.ndarray:
        """Symbols of x's parent from x on, or before x (``behind``)."""
        p = r.parent[x]
        if behind:
            return x - r.first[p] if way > 0 else r.first[p + 1] - 1 - x
        return r.first[p + 1] - x if way > 0 else x - r.first[p] + 1

    def _step(self, r: _Round, x, y, way: int):
        """Past equal symbols once: the rest of a block, or one symbol. Also
        true where the stretches differ at the new places."""
        same = r.symbols[x] == r.symbols[y]
        if r.blocks:
            rx, ry = self._rest(r, x, way), self._rest(r, y, way)
            n = np.where(same, np.minimum(rx, ry), 0) * way
            return x + n, y + n, ~same | (rx != ry)
        n = same.astype(np.int64) * way
        return x + n, y + n, ~same
