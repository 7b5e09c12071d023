"""A hierarchical navigable small-world graph over one shard of vectors.

Layer 0 holds all vectors, each layer above about one in ``FAN`` of the one
below; a vector is linked to neighbours found in each of its layers: up to
half of the links are those nearer to it than to any neighbour already taken,
so that links lead out of a tight cluster, the rest the nearest. A search walks down the layers, and on layer 0 keeps a beam of the
best ``beam`` vectors seen, always following the best ones not yet followed.
Searches run for many queries in step, so that a step is a few array
operations. Vectors are inserted in growing batches: a batch searches the
graph so far, and is compared with itself.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np

LINKS = 16
FAN = 16
FOLLOW = 4  # vectors a search follows in one step
CELLS = 1 << 22  # visited flags, or pairs compared, held at a time
WALKERS = 256  # queries that walk over links together


def diverse(x: np.ndarray, found: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Places of the ``width`` candidates to link with, for each row of
    candidates (best first, -1: none): up to half of them those nearer to the
    row than to any candidate taken before, and the nearest of the others."""
    out = []
    step = max(1, CELLS // max(1, found.shape[1] ** 2))
    for at in range(0, len(found), step):
        f, s = found[at:at + step], sims[at:at + step]
        v = x[f]
        among = v @ v.transpose(0, 2, 1)
        taken = np.zeros(f.shape, bool)
        for j in range(f.shape[1]):
            taken[:, j] = (f[:, j] >= 0) & ~(taken[:, :j] & (among[:, j, :j] >= s[:, j, None])).any(1)
        taken &= np.cumsum(taken, axis=1) <= width // 2
        rank = np.where(taken, 0, np.where(f >= 0, 1, 2))
        out.append(np.argsort(rank, axis=1, kind="stable")[:, :width])
    return np.concatenate(out) if out else np.empty((0, min(width, found.shape[1])), np.int64)


class Layer:
    """Links among the members of one layer, by row numbers of the shard."""

    def __init__(self, n: int, width: int):
        self.links = np.full((n, width), -1, np.int32)
        self.near = np.full((n, width), -np.inf, np.float32)
        self.members = np.empty(0, np.int32)

    def connect(self, x: np.ndarray, rows: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        """Link each row to what was found for it, and back; a row that gets
        more links than fit keeps the ``diverse`` ones."""
        a = np.repeat(rows, found.shape[1]).astype(np.int64)
        b, s = found.ravel().astype(np.int64), sims.ravel()
        ok = (b >= 0) & (a != b)
        a, b, s = a[ok], b[ok], s[ok]
        a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        touched = np.unique(a)
        old = self.links[touched]
        has = old >= 0
        a = np.concatenate([a, np.repeat(touched, old.shape[1])[has.ravel()]])
        b = np.concatenate([b, old[has].astype(np.int64)])
        s = np.concatenate([s, self.near[touched][has]])
        pair = np.unique(a * self.links.shape[0] + b, return_index=True)[1]
        a, b, s = a[pair], b[pair], s[pair]
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.searchsorted(a, touched)
        place = np.arange(a.size) - np.repeat(first, np.diff(np.append(first, a.size)))
        width = self.links.shape[1]
        count = np.diff(np.append(first, a.size))
        keep = np.ones(a.size, bool)
        full = np.flatnonzero(count > width)
        full, at = full[np.argsort(count[full], kind="stable")], 0
        while at < full.size:  # rows of like counts, at most CELLS places
            n = int(np.searchsorted(np.arange(1, full.size - at + 1) * count[full[at:]].astype(np.int64) ** 2, CELLS, "right"))
            some = full[at:at + max(1, n)]
            at += some.size
            wide = np.arange(count[some].max())[None, :]
            there = wide < count[some][:, None]
            where = np.where(there, first[some][:, None] + wide, 0)
            pick = diverse(x, np.where(there, b[where], -1), np.where(there, s[where], -np.inf), width)
            keep[where[there]] = False
            keep[np.take_along_axis(where, pick, 1)] = True
        a, b, s = a[keep], b[keep], s[keep]
        first = np.searchsorted(a, touched)
        place = np.arange(a.size) - np.repeat(first, np.diff(np.append(first, a.size)))
        self.links[touched], self.near[touched] = -1, -np.inf
        self.links[a, place] = b
        self.near[a, place] = s
        self.members = np.union1d(self.members, rows).astype(np.int32)


class Graph:
    def __init__(self, vectors: np.ndarray):
        """Unit vectors, one a row."""
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.layers: list[Layer] = []

    @classmethod
    def build(cls, vectors: np.ndarray, beam: int, seed: int = 3) -> "Graph":
        g = cls(vectors)
        n = len(vectors)
        if not n:
            return g
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(FAN)).astype(int), 8)
        g.layers = [Layer(n, 2 * LINKS if l == 0 else LINKS) for l in range(int(level.max()) + 1)]
        order, at = rng.permutation(n).astype(np.int32), 0
        while at < n:
            rows = order[at:at + min(1024, max(256, at))]
            at += rows.size
            own = g.x[rows] @ g.x[rows].T
            np.fill_diagonal(own, -np.inf)
            start = None
            for l in range(len(g.layers) - 1, -1, -1):
                layer = g.layers[l]
                here = np.flatnonzero(level[rows] >= l)
                width = LINKS
                if layer.members.size:
                    found, sims = g.search_layer(g.x[rows], start, l, beam if l == 0 else LINKS)
                    start = found[:, :4]
                    found, sims = found[here], sims[here]
                else:
                    found, sims = np.empty((here.size, 0), np.int32), np.empty((here.size, 0), np.float32)
                if here.size:
                    mine = own[np.ix_(here, here)]
                    k = min(width, here.size - 1)
                    top = np.argpartition(-mine, k - 1, axis=1)[:, :k] if k > 0 else np.empty((here.size, 0), int)
                    both = np.concatenate([found, rows[here][top]], axis=1)
                    both_s = np.concatenate([sims, np.take_along_axis(mine, top, 1)], axis=1)
                    best = np.argsort(-both_s, axis=1, kind="stable")
                    both, both_s = np.take_along_axis(both, best, 1), np.take_along_axis(both_s, best, 1)
                    best = diverse(g.x, both, both_s, width)
                    layer.connect(g.x, rows[here], np.take_along_axis(both, best, 1), np.take_along_axis(both_s, best, 1))
        return g

    def search_layer(self, queries: np.ndarray, start: np.ndarray | None, l: int, beam: int):
        """The ``beam`` best rows of a layer found for each query, best first
        (-1 and -inf where fewer were found)."""
        step = max(16, CELLS // max(1, len(self.x)))
        parts = [self._search(queries[i:i + step], None if start is None else start[i:i + step], self.layers[l], beam)
                 for i in range(0, len(queries), step)]
        if not parts:
            return np.empty((0, beam), np.int32), np.empty((0, beam), np.float32)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _search(self, q: np.ndarray, start: np.ndarray | None, layer: Layer, beam: int):
        n_q = len(q)
        if start is None:
            start = np.repeat(layer.members[:4][None, :], n_q, 0)
        seen = np.zeros((n_q, len(self.x) + 1), bool)  # the last column: no row
        seen[:, -1] = True
        ids, sims = np.full((n_q, beam), -1, np.int32), np.full((n_q, beam), -np.inf, np.float32)
        followed = np.ones((n_q, beam), bool)

        def merge(active: np.ndarray, rows: np.ndarray) -> None:
            """Compare the active queries with new rows; keep the best."""
            line = np.arange(active.size)[:, None]
            ordered = np.sort(rows, axis=1)
            twice = np.zeros(rows.shape, bool)
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            new = ~seen[active[:, None], ordered] & ~twice
            width = int(new.sum(1).max(initial=0))
            if not width:
                return
            pick = np.argsort(~new, axis=1, kind="stable")[:, :width]
            rows, new = np.take_along_axis(ordered, pick, 1), np.take_along_axis(new, pick, 1)
            rows = np.where(new, rows, -1)
            seen[active[:, None], rows] = True
            s = np.einsum("qkd,qd->qk", self.x[rows], q[active])
            s[~new] = -np.inf
            all_s = np.concatenate([sims[active], s], axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            all_i = np.concatenate([ids[active], rows], axis=1)
            all_f = np.concatenate([followed[active], ~new], axis=1)
            ids[active], sims[active], followed[active] = all_i[line, top], all_s[line, top], all_f[line, top]

        merge(np.arange(n_q), start)
        active = np.arange(n_q)
        while active.size:
            # rows leave the beam when better ones come, so all open rows in
            # it are better than its worst
            open_ = ~followed[active] & (ids[active] >= 0)
            active = active[open_.any(1)]
            if not active.size:
                break
            open_ = ~followed[active] & (ids[active] >= 0)
            take = np.argsort(~open_, axis=1, kind="stable")[:, :FOLLOW]
            good = np.take_along_axis(open_, take, 1)
            line = active[:, None]
            followed[line, take] = True
            nodes = np.where(good, ids[line, take], -1)
            nxt = np.where(nodes[:, :, None] >= 0, layer.links[nodes], -1)
            merge(active, nxt.reshape(active.size, -1))
        return ids, sims

    def near(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) pairs of similarity ``least`` or more, all pairs of a
        query in one part: the beam's, and all that can be reached from them
        over links between such rows. There is no limit on a query's pairs:
        one that reaches over a sixteenth of the shard is compared with all
        of it, as is every query of a beam as wide as the shard. A part holds
        CELLS pairs at most, or one query's."""
        n = len(self.x)
        if not n or not len(queries):
            return
        every = np.arange(len(queries))
        if beam >= n:
            yield from self._compared(queries, every, least)
            return
        many = []
        for at in range(0, len(queries), WALKERS):
            mine = every[at:at + WALKERS]
            found, large = self._walk(queries[mine], least, beam, max(4 * beam, n // 16))
            many.append(mine[large])
            yield mine[found // n], found % n
        yield from self._compared(queries, np.concatenate(many), least)

    def _compared(self, queries: np.ndarray, which: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, CELLS // len(self.x))
        for at in range(0, which.size, step):
            q, row = np.nonzero(queries[which[at:at + step]] @ self.x.T >= least)
            yield which[at + q], row

    def _walk(self, queries: np.ndarray, least: float, beam: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs as query * rows + row, and the queries given up because they
        have over ``most``."""
        start, n = None, len(self.x)
        for l in range(len(self.layers) - 1, 0, -1):
            if self.layers[l].members.size:
                start = self.search_layer(queries, start, l, LINKS)[0][:, :4]
        ids, sims = self.search_layer(queries, start, 0, min(beam, max(4, n)))
        q, k = np.nonzero((sims >= least) & (ids >= 0))
        found = np.unique(q.astype(np.int64) * n + ids[q, k])
        tried, front = found, found
        large = np.zeros(len(queries), bool)
        while front.size:
            q, row = front // n, front % n
            near = self.layers[0].links[row]
            ok = near >= 0
            pairs = np.unique(np.repeat(q, ok.sum(1)) * n + near[ok])
            pairs = np.setdiff1d(pairs, tried, assume_unique=True)
            tried = np.union1d(tried, pairs)
            keep = [np.einsum("kd,kd->k", self.x[p % n], queries[p // n]) >= least
                    for p in np.array_split(pairs, max(1, pairs.size // (1 << 15)))]
            front = pairs[np.concatenate(keep)]
            found = np.union1d(found, front)
            over = np.bincount(found // n, minlength=large.size) > most
            if over.any():
                large |= over
                found, tried, front = (x[~large[x // n]] for x in (found, tried, front))
        return found, np.flatnonzero(large)

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of ``near`` at once, for few queries."""
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64)), *self.near(queries, least, beam)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def arrays(self) -> list[np.ndarray]:
        return [self.x, *[a for l in self.layers for a in (l.members, l.links[l.members])]]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> "Graph":
        g = cls(arrays[0])
        for members, links in zip(arrays[1::2], arrays[2::2]):
            layer = Layer(0, 0)
            layer.members, layer.links = members, np.full((len(g.x) + 1, links.shape[1]), -1, np.int32)
            layer.links[members] = links
            g.layers.append(layer)
        return g
