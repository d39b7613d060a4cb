"""All pairs of two sets of texts within thresholds: one walk of the targets' radix tree for all queries at once.

A step of the walk takes many places (a query at a node of the tree) to the node's children and computes a row of the
dynamic programme for each, within the band that the thresholds allow. A place whose row is above its query's
threshold goes no further, so texts that begin alike are compared once, and pairs that differ early not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .kernels import Batch
from .params import Costs
from .units import code_type, codes

#: Places of a step; pairs of a result; padded code units above which texts are taken by length.
STEP, PAIRS, UNITS = 1 << 16, 1 << 17, 1 << 23

#: Query, target and distance of pairs, and in anchored mode how much of each text is taken.
Found = tuple[np.ndarray, ...]


def band(k: int, costs: Costs) -> int:
    """The farthest from the diagonal that a distance allows."""
    return max(0, (k - costs.opening) // costs.gap)


def within(queries: list[str], k: np.ndarray, targets: list[str], kind: str, costs: Costs, unit: str) -> Iterator[Found]:
    """Places of all pairs of distinct queries and distinct targets within the queries' thresholds, as the kernels give them."""
    coded = [codes(x, unit) for x in queries], [codes(x, unit) for x in targets]
    item = np.dtype(code_type(unit)).itemsize
    groups = [_by_length(x, item) for x in coded]
    for t in groups[1]:
        tree = Tree([coded[1][i] for i in t], unit)
        for q in groups[0]:
            for found in Walk(tree, [coded[0][i] for i in q], k[q], kind, costs, unit).run():
                yield q[found[0]], t[found[1]], *found[2:]


def _by_length(texts: list[bytes], item: int) -> list[np.ndarray]:
    """All texts, or where padding them would take much, those of about the same length."""
    n = np.array(list(map(len, texts)), np.int64) // item
    if len(n) * int(n.max(initial=0)) <= UNITS:
        return [np.arange(len(n))] if len(n) else []
    power = np.ceil(np.log2(n + 1)).astype(np.int64)
    return [np.flatnonzero(power == x) for x in np.unique(power)]


def _padded(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(texts), code_type(unit))
    n = np.array(list(map(len, texts)), np.int64) // flat.itemsize
    out = np.zeros((len(texts), int(n.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


class Tree:
    """The nodes of depth j are the runs of sorted texts that share their first j code units."""

    def __init__(self, texts: list[bytes], unit: str):
        order = sorted(range(len(texts)), key=texts.__getitem__)  # a text comes before those it begins
        self.order = np.array(order, np.int64)
        self.units, self.n = _padded([texts[i] for i in order], unit)
        unlike = self.units[1:] != self.units[:-1]
        alike = np.full(len(texts), -1, np.int64)  # code units that a text shares with the one before
        if unlike.shape[1]:
            alike[1:] = np.where(unlike.any(1), unlike.argmax(1), unlike.shape[1])
        else:
            alike[1:] = 0
        alike[1:] = np.minimum(alike[1:], np.minimum(self.n[1:], self.n[:-1]))
        depth = self.units.shape[1]
        self.starts, self.ends, self.shortest, self.longest = [], [], [], []
        for j in range(depth + 1):
            cut = np.flatnonzero(alike < j) if j else np.zeros(1, np.int64)
            own = self.n[cut] >= j
            self.starts.append(cut[own])
            self.ends.append(np.append(cut[1:], len(texts))[own])
            self.shortest.append(np.minimum.reduceat(self.n, self.starts[-1]))
            self.longest.append(np.maximum.reduceat(self.n, self.starts[-1]))
        #: The children of a depth's i-th node are nodes children[i] to children[i + 1] of the next depth.
        self.children = [np.searchsorted(self.starts[j + 1], np.append(self.starts[j], len(texts))) for j in range(depth)]
        self.children.append(np.zeros(len(self.starts[depth]) + 1, np.int64))


class Walk:
    """Rows of places are along the query: row d of a place of depth j is the query's first j + d - w units."""

    def __init__(self, tree: Tree, queries: list[bytes], k: np.ndarray, kind: str, costs: Costs, unit: str):
        self.tree, self.anchored, self.affine = tree, kind == "anchored", costs.algorithm == "affine"
        units, self.n = _padded(queries, unit)
        most = int(k.max(initial=0))
        self.w = w = band(most, costs)
        table = None
        if costs.matrix is None:
            q, t = units.astype(np.int64), tree.units.astype(np.int64)
            if unit == "char":  # code points to small numbers
                seen = np.unique(np.concatenate([q.ravel(), t.ravel()]))
                q, t = np.searchsorted(seen, q), np.searchsorted(seen, t)
        else:
            chars, table = costs.matrix.lookup()
            q, t = Batch.places(chars, units, self.n), Batch.places(chars, tree.units, tree.n)
        wide = max(most, int(q.max(initial=0)), int(t.max(initial=0))) >= 1 << 12
        self.type, never = (np.int32, 1 << 27) if wide else (np.int16, 1 << 13)
        self.never, self.gap, self.first = (self.type(min(x, never)) for x in (never, costs.gap, costs.first))
        self.k = k.astype(self.type)
        #: Units of the queries by place; what lies outside of a query costs never.
        rows = max(q.shape[1] + w, t.shape[1] + 2 * w + 1)
        self.table = None
        outside: int = never
        if table is not None:
            outside = len(table)
            self.table = np.full((outside + 1, outside + 1), never, self.type)  # by the target's unit, then the query's
            self.table[:-1, :-1] = np.minimum(table.T, never)
            self.table = self.table.ravel()
            self.across = outside + 1
        self.q = np.full((rows, len(queries)), outside, np.int64 if table is not None else self.type)
        self.q[w : w + q.shape[1]] = np.where(np.arange(q.shape[1]) < self.n[:, None], q, outside).T
        self.t = t.astype(self.q.dtype)
        self.pending: list[list[tuple]] = [[] for _ in tree.starts]
        self.sizes = [0] * len(tree.starts)
        self.out: list[Found] = []
        self.held = 0

    def run(self) -> Iterator[Found]:
        if not len(self.n) or not len(self.tree.n):
            return
        steps = np.arange(self.w + 1)
        rows = np.full((3 if self.affine else 1, 2 * self.w + 1, 1), self.never, self.type)
        if self.affine:
            rows[0, self.w] = 0
            rows[2, self.w + 1 :, 0] = np.minimum(int(self.first) + steps[:-1] * int(self.gap), self.never)
        else:
            rows[0, self.w :, 0] = np.minimum(steps * int(self.gap), self.never)
        for i in range(0, len(self.n), STEP):
            q = np.arange(i, min(i + STEP, len(self.n)))
            none = (np.full(len(q), self.never, self.type), np.zeros(len(q), np.int32)) if self.anchored else ()
            self._arrive(0, q, np.zeros(len(q), np.int64), np.repeat(rows, len(q), axis=2), none)
        while True:
            full = [j for j, x in enumerate(self.sizes) if x >= STEP]
            # the deepest that fills a step, so that few places wait; else the first, so that those after it fill
            j = full[-1] if full else next((j for j, x in enumerate(self.sizes) if x), None)
            if j is None:
                break
            self._step(j, *self._taken(j))
            if self.held >= PAIRS:
                yield from self._pairs()
        yield from self._pairs()

    def _taken(self, j: int) -> tuple:
        """Waiting places of a depth with about STEP children."""
        got, room = [], STEP
        while self.pending[j] and room > 0:
            q, node, rows, best = self.pending[j].pop()
            total = np.cumsum(self.tree.children[j][node + 1] - self.tree.children[j][node])
            m = max(1, int(np.searchsorted(total, room, "right")))
            if m < len(q):
                self.pending[j].append((q[m:], node[m:], rows[:, :, m:], tuple(x[m:] for x in best)))
                q, node, rows, best = q[:m], node[:m], rows[:, :, :m], tuple(x[:m] for x in best)
            room -= int(total[m - 1] if m < len(total) else total[-1])
            self.sizes[j] -= len(q)
            got.append((q, node, rows, best))
        if len(got) == 1:
            return got[0]
        q, node, rows, best = zip(*got, strict=True)
        return np.concatenate(q), np.concatenate(node), np.concatenate(rows, axis=2), tuple(np.concatenate(x) for x in zip(*best, strict=True))

    def _step(self, j: int, q: np.ndarray, node: np.ndarray, rows: np.ndarray, best: tuple) -> None:
        """Takes places of depth j to their children."""
        tree, g, o, w = self.tree, self.gap, self.first, self.w
        begin = tree.children[j][node]
        count = tree.children[j][node + 1] - begin
        parent = np.repeat(np.arange(len(q)), count)
        node = np.arange(len(parent)) + np.repeat(begin - (np.cumsum(count) - count), count)
        q = q[parent]
        if not self.anchored:
            n = self.n[q]
            near = np.flatnonzero((tree.shortest[j + 1][node] <= n + w) & (tree.longest[j + 1][node] >= n - w))
            if len(near) < len(q):
                parent, node, q = parent[near], node[near], q[near]
        if not len(q):
            return
        old, new = np.take(rows, parent, axis=2), np.empty((len(rows), 2 * w + 1, len(q)), self.type)
        unit = self.t[tree.starts[j + 1], j][node]
        if self.table is not None:
            unit = unit * self.across
        match, cross, down = (old[0], old[1], old[2]) if self.affine else (old[0], None, None)
        most = np.minimum(np.minimum(match, cross), down) if self.affine else match
        for d in range(2 * w + 1):
            x = self.q[j + d].take(q)
            sub = (x != unit) + (x & self.never) if self.table is None else self.table.take(x + unit)
            cell = most[d] + sub
            if not self.affine:
                if d < 2 * w:
                    np.minimum(cell, match[d + 1] + g, out=cell)
                if d:
                    np.minimum(cell, new[0, d - 1] + g, out=cell)
                np.minimum(cell, self.never, out=new[0, d])
                continue
            np.minimum(cell, self.never, out=new[0, d])
            new[1:, d] = self.never
            if d < 2 * w:
                np.minimum(np.minimum(match[d + 1], down[d + 1]) + o, cross[d + 1] + g, out=new[1, d])
            if d:
                np.minimum(np.minimum(new[0, d - 1], new[1, d - 1]) + o, new[2, d - 1] + g, out=new[2, d])
            np.minimum(new[1:, d], self.never, out=new[1:, d])
        self._arrive(j + 1, q, node, new, tuple(x[parent] for x in best))

    def _arrive(self, j: int, q: np.ndarray, node: np.ndarray, rows: np.ndarray, best: tuple) -> None:
        """Pairs that end at places of depth j; the places that go on wait for their step. best: the least cost of the whole query, and of how much of the target."""
        tree, w = self.tree, self.w
        least = rows.min(0) if self.affine else rows[0]
        low, k = least.min(0), self.k[q]
        alive = low <= k
        if self.anchored:
            whole, taken = best
            at = self.n[q] - j + w
            here = np.flatnonzero((at >= 0) & (at <= 2 * w))
            ends = least[at[here], here]
            better = ends < whole[here]
            whole[here[better]], taken[here[better]] = ends[better], j
            done = (whole <= k) & (low > whole)
            if done.any():
                x = np.flatnonzero(done)
                self._emit(q[x], tree.starts[j][node[x]], tree.ends[j][node[x]], whole[x], self.n[q[x]], taken[x])
                alive &= ~done
        if not alive.all():
            x = np.flatnonzero(alive)
            q, node, rows, least = q[x], node[x], rows[:, :, x], least[:, x]
            best = tuple(b[x] for b in best)
        start = tree.starts[j][node]
        x = np.flatnonzero(tree.n[start] == j)
        if len(x) and self.anchored:
            size = least[:, x].argmin(0)
            cost, whole, taken = least[size, x], best[0][x], best[1][x]
            own = cost <= whole
            cost, size, taken = np.where(own, cost, whole), np.where(own, size + j - w, self.n[q[x]]), np.where(own, j, taken)
            near = cost <= self.k[q[x]]
            self._emit(q[x][near], start[x][near], start[x][near] + 1, cost[near], size[near], taken[near])
        elif len(x):
            at = self.n[q[x]] - j + w
            x = x[(at >= 0) & (at <= 2 * w)]
            cost = least[self.n[q[x]] - j + w, x]
            near = cost <= self.k[q[x]]
            self._emit(q[x][near], start[x][near], start[x][near] + 1, cost[near])
        more = tree.children[j][node + 1] > tree.children[j][node]
        if not more.all():
            x = np.flatnonzero(more)
            q, node, rows = q[x], node[x], rows[:, :, x]
            best = tuple(b[x] for b in best)
        if len(q):
            self.pending[j].append((q, node, rows, best))
            self.sizes[j] += len(q)

    def _emit(self, q: np.ndarray, start: np.ndarray, end: np.ndarray, *values: np.ndarray) -> None:
        if len(q):
            self.out.append((q, start, end, *values))
            self.held += int((end - start).sum())

    def _pairs(self) -> Iterator[Found]:
        """Results, with a row for each text of a run."""
        if not self.out:
            return
        q, start, end, *values = (np.concatenate(x) for x in zip(*self.out, strict=True))
        self.out, self.held = [], 0
        total = np.cumsum(end - start)
        i = 0
        while i < len(q):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
            n = end[i:j] - start[i:j]
            at = np.repeat(np.arange(i, j), n)
            t = np.arange(len(at)) + np.repeat(start[i:j] - (np.cumsum(n) - n), n)
            yield q[at], self.tree.order[t], *(v[at].astype(np.int32) for v in values)
            i = j
