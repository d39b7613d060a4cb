"""Walks of radix trees against kernels that compute every pair, and how many rows a search of texts that begin alike makes."""

import random

import numpy as np
import pytest

from nearkin.functions import walk
from nearkin.functions.costs import CostMatrix
from nearkin.functions.kernels import batches
from nearkin.functions.params import Costs
from nearkin.operators import search, split
from nearkin.plans import cells

UNEVEN = CostMatrix({q: {t: 0 if q == t else 1 + (ord(q) * 7 + ord(t) * 3) % 3 for t in "ACGT"} for q in "ACGT"})
FREE = CostMatrix({q: {t: 0 if q in ("A", t) else 2 for t in "ACGT"} for q in "ACGT"})
COSTS = [Costs("unit"), Costs("linear", UNEVEN, 2), Costs("linear", FREE, 1), Costs("affine", UNEVEN, 1, 2), Costs("affine", FREE, 2, 1), Costs("affine", UNEVEN, 1, 4)]


def texts(chosen, letters, n):
    return sorted({"".join(chosen.choice(letters) for _ in range(chosen.randint(0, chosen.choice([3, 9, 12])))) for _ in range(n)}, key=lambda _: chosen.random())


@pytest.mark.parametrize("costs", COSTS)
@pytest.mark.parametrize("kind", ["global", "anchored"])
def test_walk_finds_what_kernels_find(kind, costs, monkeypatch):
    chosen = random.Random(7)
    for _ in range(30):
        for name, sizes in (("STEP", (3, 50, 1 << 16)), ("PAIRS", (2, 1 << 17)), ("UNITS", (20, 1 << 23))):
            monkeypatch.setattr(walk, name, chosen.choice(sizes))
        unit, letters = chosen.choice(["byte", "char"]), chosen.choice(["AC", "ACGT"]) if costs.matrix else chosen.choice(["AC", "Aé", "ACGTÀ"])
        q, t = texts(chosen, letters, 25), texts(chosen, letters, 25)
        k = np.array([chosen.randint(0, chosen.choice([1, 3, 5])) for _ in q])
        got = [x for f in walk.within(q, k, t, kind, costs, unit) for x in zip(*(v.tolist() for v in f), strict=True)]
        pairs = [(i, j) for i in range(len(q)) for j in range(len(t))]
        values = np.reshape(batches([q[i] for i, _ in pairs], [t[j] for _, j in pairs], kind, costs, unit), (len(pairs), -1)).tolist()
        assert sorted(got) == sorted((*p, *v) for p, v in zip(pairs, values, strict=True) if v[0] <= k[p[0]])


def test_walk_of_long_texts_and_wide_costs():
    q = ["ab" * 3000 + "c", "b", "", chr(0x1F600) + "x"]
    t = ["ab" * 3000, "ab" * 2999 + "bc", "", chr(0x1F600), "\0", "b\0"]
    got = sorted((i, j, d) for f in walk.within(q, np.full(4, 2), t, "global", Costs("unit"), "char") for i, j, d in zip(*(v.tolist() for v in f), strict=True))
    assert got == [(0, 0, 1), (0, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (2, 2, 0), (2, 3, 1), (2, 4, 1), (2, 5, 2), (3, 2, 2), (3, 3, 1), (3, 4, 2), (3, 5, 2)]
    big = CostMatrix({"a": {"a": 0, "b": 70_000}, "b": {"a": 70_000, "b": 0}})
    found = {(i, d) for f in walk.within(["ab", "aa"], np.full(2, 70_000), ["aa"], "global", Costs("linear", big, 40_000), "byte") for i, _, d in zip(*(v.tolist() for v in f), strict=True)}
    assert found == {(0, 70_000), (1, 0)}


def most_rows(df) -> int:
    """The most rows that an operator of a collected table's plan made."""

    def of(node) -> list[int]:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        inner = [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        return ([rows.get().value()] if rows.isDefined() else [0]) + [x for n in inner for x in of(n)]

    return max(of(df._jdf.queryExecution().executedPlan()))


SEARCHES = {
    "lev_forest": lambda q, t: search.forest_search(q, t, 3),
    "anchored_linear": lambda q, t: search.similarity_join(q, t, 2, mode="an", cost_matrix=UNEVEN, gap_cost=2),
    "global_affine": lambda q, t: search.similarity_join(q, t, 3, cost_matrix=UNEVEN, gap_cost=1, gap_open_cost=2),
    "global_linear": lambda q, t: search.similarity_join(q, t, 2, cost_matrix=UNEVEN, gap_cost=2),
    "split_search": lambda q, t: split.split_search(q, t, 12, 12, max_distance=3),
    "anchored_affine": lambda q, t: search.similarity_join(q, t, 2, mode="extension", cost_matrix=UNEVEN, gap_cost=1, gap_open_cost=2),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_texts_that_begin_alike_are_not_all_compared(spark, name):
    chosen = random.Random(3)
    some = sorted({"ACGT" * 6 + "".join(chosen.choice("ACGT") for _ in range(24)) for _ in range(300)})
    rows = spark.createDataFrame([(x,) for x in some], "s string")
    found = SEARCHES[name](rows.select(rows.s.alias("query")), rows.select(rows.s.alias("target")))
    assert len(found.collect()) == 300
    assert most_rows(found) <= 1000  # of 90,000 pairs


def test_cells_are_slices_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(cells, "TEXTS", 7)
    monkeypatch.setattr(cells, "SMALL", 3)
    monkeypatch.setattr(cells, "BLOCKS", 2)
    monkeypatch.setattr(cells, "BYTES", 40)
    chosen = random.Random(1)
    q, t = (spark.createDataFrame([(x,) for x in texts(chosen, "AC", 40)], f"{c} string") for c in ("query", "target"))
    for mode in ("global", "anchored"):
        assert rows(search.similarity_join(q, t, 2, mode=mode)) == rows(search.similarity_join(q, t, 2, mode=mode, strategy="nested"))
        assert rows(search.similarity_join(q, t, max_fraction=0.4, mode=mode)) == rows(search.similarity_join(q, t, max_fraction=0.4, mode=mode, strategy="nested"))
    none = q.limit(0)
    assert search.similarity_join(none, t, 2).collect() == search.similarity_join(q, t.limit(0), 2).collect() == []
