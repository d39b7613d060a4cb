"""Distances of many pairs at once, in numpy: one step for each character of the longest query of a batch.

Pairs are sorted by length and cut into batches of a bounded number of cells. Within a row of the dynamic
programme, a gap along the target is a running minimum, so no step depends on its neighbour. Where there is a
threshold, only the band around the diagonal that it allows is computed, and pairs above it leave the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import Costs
from .units import code_type, codes, view

#: Cells of a batch; a cost that no alignment has.
CELLS, NEVER = 1 << 18, 1 << 40
#: The same within a band of 32-bit costs; code units of a batch.
BAND_NEVER, UNITS = 1 << 28, 1 << 22

ANCHORED = "distance int, query_size int, target_size int"


class Batch:
    """Padded code units of pairs."""

    def __init__(self, queries: list[str], targets: list[str], unit: str):
        self.q, self.n = _padded(queries, unit)
        self.t, self.m = _padded(targets, unit)
        self.rows = np.arange(len(queries))

    def substitutions(self, costs: Costs) -> Callable[[int], np.ndarray]:
        """Costs of a query's i-th character against all characters of its target."""
        if costs.matrix is None:
            return lambda i: (self.t != self.q[:, i, None]).astype(np.int64)
        chars, table = costs.matrix.lookup()

        q, t = self.places(chars, self.q, self.n), self.places(chars, self.t, self.m)
        return lambda i: table[q[:, i, None], t]

    @staticmethod
    def places(chars: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places of padded texts' characters among sorted ones; raises ValueError for others."""
        at = np.minimum(np.searchsorted(chars, x), len(chars) - 1)
        if ((chars[at] != x) & (np.arange(x.shape[1]) < n[:, None])).any():
            raise ValueError("a text has a character that the cost matrix has no costs for")
        return at

    def banded(self, costs: Costs, w: int) -> Callable[[int, np.ndarray | None], np.ndarray]:
        """Costs of the queries' i-th characters against their targets' places from i - w to i + w; keep: the pairs that stay, from now on."""
        if costs.matrix is None:
            table, q, t = None, self.q, self.t
        else:
            chars, table = costs.matrix.lookup()
            table = np.minimum(table, BAND_NEVER).astype(np.int32)
            q, t = self.places(chars, self.q, self.n), self.places(chars, self.t, self.m)
        # q's character i meets t's places i + d: both are as long as the longest query and its band
        t = np.pad(t, ((0, 0), (w, max(0, q.shape[1] + w - t.shape[1]) + 1)))
        held = [q, t]

        def of(i: int, keep: np.ndarray | None) -> np.ndarray:
            if keep is not None:
                held[:] = [x[keep] for x in held]
            q, t = held
            a, b = q[:, i, None], t[:, i : i + 2 * w + 1]
            return (a != b).astype(np.int32) if table is None else table[a, b]

        return of


def _padded(texts: list[str], unit: str) -> tuple[np.ndarray, np.ndarray]:
    raw = [codes(x, unit) for x in texts]
    flat = np.frombuffer(b"".join(raw), code_type(unit))
    n = np.array(list(map(len, raw)), np.int64) // flat.itemsize
    out = np.zeros((len(raw), int(n.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


def hamming(b: Batch, _: Costs) -> np.ndarray:
    """Mismatches, or -1 where the lengths differ."""
    width = min(b.q.shape[1], b.t.shape[1])
    inside = np.arange(width) < b.n[:, None]
    return np.where(b.n == b.m, ((b.q[:, :width] != b.t[:, :width]) & inside).sum(1), -1)


def rows_of(b: Batch, costs: Costs) -> Iterator[np.ndarray]:
    """Rows 0 to n of the dynamic programme: the least cost of each prefix of the target."""
    sub, g, o = b.substitutions(costs), costs.gap, costs.first
    width = b.t.shape[1]
    steps = np.arange(width + 1) * g
    if costs.algorithm != "affine":
        row = np.broadcast_to(steps, (len(b.rows), width + 1)).copy()
        yield row
        for i in range(b.q.shape[1]):
            new = row + g
            np.minimum(new[:, 1:], row[:, :-1] + sub(i), out=new[:, 1:])
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            yield row
        return
    shape = (len(b.rows), width + 1)
    match, along, down = (np.full(shape, NEVER) for _ in range(3))
    match[:, 0] = 0
    along[:, 1:] = o + steps[:-1]
    yield np.minimum(match, along)
    for i in range(b.q.shape[1]):
        best = np.minimum(np.minimum(match, along), down)
        down = np.minimum(np.minimum(match, along) + o, down + g)
        match = np.full(shape, NEVER)
        match[:, 1:] = best[:, :-1] + sub(i)
        opened = np.minimum.accumulate(np.minimum(match, down) + o - steps, axis=1)
        along = np.full(shape, NEVER)
        along[:, 1:] = opened[:, :-1] + steps[:-1]
        yield np.minimum(np.minimum(match, along), down)


def whole(b: Batch, costs: Costs) -> np.ndarray:
    """Distances of whole texts."""
    out = np.zeros(len(b.rows), np.int64)
    for i, row in enumerate(rows_of(b, costs)):
        ends = b.n == i
        out[ends] = row[ends, b.m[ends]]
    return out


def anchored(b: Batch, costs: Costs) -> np.ndarray:
    """Columns: the least cost that consumes one of the texts, and how much of each text it takes.

    Of equal costs, one that consumes the target comes first, with the least of the query; else the least of the target.
    """
    best, size = np.full(len(b.rows), NEVER), np.zeros(len(b.rows), np.int64)
    out = np.zeros((len(b.rows), 3), np.int64)
    inside = np.arange(b.t.shape[1] + 1) <= b.m[:, None]
    for i, row in enumerate(rows_of(b, costs)):
        last = row[b.rows, b.m]
        better = (last < best) & (i <= b.n)
        best[better], size[better] = last[better], i
        ends = np.flatnonzero(b.n == i)
        if len(ends):
            r = np.where(inside[ends], row[ends], NEVER)
            j = r.argmin(1)
            least = r[np.arange(len(ends)), j]
            by_query = least < best[ends]
            out[ends, 0] = np.where(by_query, least, best[ends])
            out[ends, 1] = np.where(by_query, i, size[ends])
            out[ends, 2] = np.where(by_query, j, b.m[ends])
    return out


def single_gap(b: Batch, costs: Costs) -> np.ndarray:
    """Mismatches with at most one gap of one character, which costs costs.gap; what is left of the longer text is free."""
    width = max(b.q.shape[1], b.t.shape[1]) + 2

    def grown(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, width - x.shape[1])))

    q, t = grown(b.q), grown(b.t)
    k = np.arange(width)

    def before(unlike: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((len(unlike), 1), np.int64), np.cumsum(unlike, axis=1)], axis=1)

    straight = before(q != t)
    out = straight[b.rows, np.minimum(b.n, b.m)]
    for x, y, n, m in ((q, t, b.n, b.m), (t, q, b.m, b.n)):  # x loses the character at p
        ends = np.minimum(n - 1, m)
        shifted = before(np.roll(x, -1, axis=1) != y)
        cost = costs.gap + straight[:, :-1] + shifted[b.rows, np.maximum(ends, 0)][:, None] - shifted[:, :-1]
        out = np.minimum(out, np.where(k <= ends[:, None], cost, NEVER).min(1))
    return out


def band_rows(b: Batch, costs: Costs, w: int) -> Iterator[np.ndarray]:
    """Rows 0 to n of the dynamic programme within w of the diagonal: column w + d is the target's place i + d.

    What lies outside costs more than w gaps; places before the target's start cost NEVER.
    """
    sub, g, o = b.banded(costs, w), costs.gap, costs.first
    steps = np.arange(2 * w + 1, dtype=np.int32) * np.int32(g)
    never = np.int32(BAND_NEVER)
    shape = (len(b.rows), 2 * w + 1)
    if costs.algorithm != "affine":
        row = np.full(shape, never)
        row[:, w:] = np.arange(w + 1) * g
        keep = yield row
        i = 0
        while True:
            if keep is not None:
                row = row[keep]
            new = row + sub(i, keep)
            np.minimum(new[:, :-1], row[:, 1:] + g, out=new[:, :-1])
            row = np.minimum(np.minimum.accumulate(new - steps, axis=1) + steps, never)
            keep = yield row
            i += 1
    match, along, down = (np.full(shape, never) for _ in range(3))
    match[:, w] = 0
    along[:, w + 1 :] = o + np.arange(w) * g
    keep = yield np.minimum(match, along)
    i = 0
    while True:
        if keep is not None:
            match, along, down = match[keep], along[keep], down[keep]
        best = np.minimum(np.minimum(match, along), down)
        fresh = np.full_like(down, never)
        fresh[:, :-1] = np.minimum(np.minimum(match, along)[:, 1:] + o, down[:, 1:] + g)
        down = np.minimum(fresh, never)
        match = np.minimum(best + sub(i, keep), never)
        opened = np.minimum.accumulate(np.minimum(match, down) + o - steps, axis=1)
        along = np.full_like(down, never)
        along[:, 1:] = np.minimum(opened[:, :-1] + steps[:-1], never)
        keep = yield np.minimum(np.minimum(match, along), down)
        i += 1


def near(b: Batch, costs: Costs, k: np.ndarray, kind: str) -> np.ndarray:
    """What whole() or anchored() gives, exact where it is at most k, else a distance above k.

    Only places within the band that k allows are computed, and pairs whose whole row is above k leave the batch.
    """
    most = int(k.max(initial=0))
    w = max(0, (most - costs.opening) // costs.gap)
    out = np.full((len(b.rows), 3), BAND_NEVER, np.int64)
    alive, n, m, k = b.rows, b.n, b.m, k.astype(np.int64)
    best, size = np.full(len(alive), BAND_NEVER, np.int64), np.zeros(len(alive), np.int64)
    rows = band_rows(b, costs, w)
    row, i = next(rows), 0
    while len(alive):
        place = m - i + w  # of the target's end in the row
        here = np.flatnonzero((place >= 0) & (place <= 2 * w) & (i <= n))
        last = row[here, place[here]]
        if kind == "anchored":
            better = last < best[here]
            best[here[better]], size[here[better]] = last[better], i
        ends = np.flatnonzero(n == i)
        if len(ends):
            if kind == "anchored":
                j = i - w + np.arange(2 * w + 1)
                r = np.where((j >= 0) & (j <= m[ends, None]), row[ends], BAND_NEVER)
                at = r.argmin(1)
                least = r[np.arange(len(ends)), at]
                by_query = least < best[ends]
                out[alive[ends], 0] = np.where(by_query, least, best[ends])
                out[alive[ends], 1] = np.where(by_query, i, size[ends])
                out[alive[ends], 2] = np.where(by_query, j[at], m[ends])
            else:
                out[alive[here], 0] = np.where(n[here] == i, last, out[alive[here], 0])
        live = (n > i) & (row.min(1) <= k)
        keep = None
        if live.sum() <= 0.75 * len(alive):
            if kind == "anchored":  # what the target's end has given so far stands for pairs that leave
                gone = ~live & (n > i)
                out[alive[gone]] = np.array([best[gone], size[gone], m[gone]]).T
            keep = np.flatnonzero(live)
            alive, n, m, k, best, size = (x[keep] for x in (alive, n, m, k, best, size))
            if not len(alive):
                break
        row, i = rows.send(keep), i + 1
    return out if kind == "anchored" else out[:, 0]


KERNELS = {"hamming": hamming, "global": whole, "anchored": anchored, "single_gap": single_gap}


def batches(queries: list[str], targets: list[str], kind: str, costs: Costs, unit: str, k: np.ndarray | None = None) -> np.ndarray:
    """A kernel's results in the order of the pairs; with thresholds k, those above them are only known to be so."""
    if k is not None and kind in ("global", "anchored"):
        return _near(queries, targets, kind, costs, unit, k)
    sizes = np.array([len(q) + len(t) for q, t in zip(queries, targets, strict=True)], np.int64)
    out = np.zeros((len(sizes), 3) if kind == "anchored" else len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * (int(sizes[order[j]]) + 2) <= CELLS:
            j += 1
        at = order[i:j]
        out[at] = KERNELS[kind](Batch([queries[k] for k in at], [targets[k] for k in at], unit), costs)
        i = j
    return out


def _near(queries: list[str], targets: list[str], kind: str, costs: Costs, unit: str, k: np.ndarray) -> np.ndarray:
    out = np.zeros((len(k), 3) if kind == "anchored" else len(k), np.int64)
    sizes = np.array([max(len(q), len(t)) for q, t in zip(queries, targets, strict=True)], np.int64)
    order = np.lexsort((sizes, k))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * (2 * int(k[order[j]]) // costs.gap + 3) <= CELLS and (j - i + 1) * 2 * int(sizes[order[j]]) <= UNITS:
            j += 1
        at = order[i:j]
        out[at] = near(Batch([queries[x] for x in at], [targets[x] for x in at], unit), costs, k[at], kind)
        i = j
    return out


def kernel(kind: str, costs: Costs, unit: str = "byte") -> Callable[..., Column]:
    """A vectorised function of two columns, or of three with a threshold above which a distance need not be exact: an integer, or a struct of distance and sizes for 'anchored'; null for null texts."""

    def found(q: pd.Series, t: pd.Series, *k: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        real = (q.notna() & t.notna()).to_numpy()
        return real, batches(q[real].tolist(), t[real].tolist(), kind, costs, unit, *(x[real].to_numpy(np.int64) for x in k))

    def one(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            q = columns[0]
            real, values = found(*columns)
            s = pd.Series(pd.NA, q.index, dtype="Int32")
            s[real] = pd.array(values, "Int32")
            yield s.mask(s < 0)

    def three(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            q = columns[0]
            real, values = found(*columns)
            out = pd.DataFrame({c: pd.Series(pd.NA, q.index, dtype="Int32") for c in ("distance", "query_size", "target_size")})
            for k, c in enumerate(out.columns):
                out.loc[real, c] = pd.array(values[:, k], "Int32")
            yield out

    return F.pandas_udf(three, ANCHORED) if kind == "anchored" else F.pandas_udf(one, "int")


def distance(query: Column, target: Column, kind: str, costs: Costs, unit: str = "byte", k: Column | None = None) -> Column:
    """The distance of two columns, as the kernel gives it; whole unit distances stay in the JVM."""
    if kind == "global" and costs.algorithm == "unit":
        return F.levenshtein(view(query, unit), view(target, unit))
    return kernel(kind, costs, unit)(query, target, *[] if k is None else [k])
