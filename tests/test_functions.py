import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearkin.functions import params
from nearkin.functions.costs import CostMatrix, generate_cost_matrix
from nearkin.functions.distance import dist_matrix, dist_pairwise
from nearkin.functions.kernels import batches
from nearkin.functions.params import Costs

FAR = 10**9


def table(q, t, sub, gap, first):
    """Least costs of all prefixes, by three states."""
    n, m = len(q), len(t)
    a, x, y = ([[FAR] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    a[0][0] = 0
    for j in range(1, m + 1):
        x[0][j] = first + (j - 1) * gap
    for i in range(1, n + 1):
        y[i][0] = first + (i - 1) * gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a[i][j] = sub(q[i - 1], t[j - 1]) + min(a[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1])
            x[i][j] = min(first + a[i][j - 1], gap + x[i][j - 1], first + y[i][j - 1])
            y[i][j] = min(first + a[i - 1][j], first + x[i - 1][j], gap + y[i - 1][j])
    return [[min(a[i][j], x[i][j], y[i][j]) for j in range(m + 1)] for i in range(n + 1)]


def anchored(d):
    n, m = len(d) - 1, len(d[0]) - 1
    ends = [(d[i][m], i, m) for i in range(n + 1)] + [(d[n][j], n, j) for j in range(m + 1)]
    return min(ends, key=lambda e: e[0])


def single_gap(q, t, gap):
    unlike = lambda a, b: sum(x != y for x, y in zip(a, b, strict=False))
    n, m = len(q), len(t)
    return min([unlike(q, t), *(gap + unlike(q[:p] + q[p + 1 :], t) for p in range(n) if p <= min(n - 1, m)), *(gap + unlike(q, t[:p] + t[p + 1 :]) for p in range(m) if p <= min(n, m - 1))])


MATRIX = CostMatrix({q: {t: 0 if q == t else random.Random(q + t).randint(1, 3) for t in "ACGT"} for q in "ACGT"})
ALL = [Costs("unit"), Costs("linear", MATRIX, 2), Costs("affine", MATRIX, 2, 3)]
dna = st.text("ACGT", max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(dna, dna), min_size=1, max_size=30), st.sampled_from(ALL))
def test_kernels(pairs, costs):
    q, t = map(list, zip(*pairs, strict=True))
    sub = (lambda a, b: int(a != b)) if costs.matrix is None else (lambda a, b: costs.matrix.costs[a][b])
    tables = [table(a, b, sub, costs.gap, costs.first) for a, b in pairs]
    assert batches(q, t, "global", costs, "byte").tolist() == [d[-1][-1] for d in tables]
    assert [tuple(x) for x in batches(q, t, "anchored", costs, "byte").tolist()] == [anchored(d) for d in tables]
    assert batches(q, t, "single_gap", Costs("unit", None, 2), "byte").tolist() == [single_gap(a, b, 2) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(dna, dna, st.integers(0, 7)), min_size=1, max_size=30), st.sampled_from(ALL))
def test_banded_kernels(rows, costs):
    """Within a threshold the banded kernels give what the full ones give."""
    q, t, k = map(list, zip(*rows, strict=True))
    full, near = (batches(q, t, "global", costs, "byte", *x).tolist() for x in ([], [np.array(k)]))
    assert [a if a <= n else None for a, n in zip(full, k, strict=True)] == [b if b <= n else None for b, n in zip(near, k, strict=True)]
    full, near = (batches(q, t, "anchored", costs, "byte", *x).tolist() for x in ([], [np.array(k)]))
    assert [a if a[0] <= n else None for a, n in zip(full, k, strict=True)] == [b if b[0] <= n else None for b, n in zip(near, k, strict=True)]


def test_gap_names_and_wide_characters():
    m = CostMatrix({"A": {"A": 0, "C": 2, "gap": 4}, "C": {"A": 2, "C": 0, "gap": 4}, "gap": {"A": 4, "C": 4, "gap": 0}})
    assert m.chars == ["A", "C"] and m.off_diagonal() == [2, 2]
    wide = generate_cost_matrix("àè", mismatch=5)
    wide.covers("à", "char")
    with pytest.raises(ValueError, match="char"):
        wide.covers("", "byte")
    with pytest.raises(ValueError):
        batches(["aà"], ["aè"], "global", Costs("linear", generate_cost_matrix("aà"), 1), "char")


def test_golden():
    one = lambda q, t, kind, c: batches([q], [t], kind, c, "byte")[0].tolist()
    far = generate_cost_matrix("ACGT", match=0, mismatch=5)
    a, b = "TGCAGCGTTGATCTGCCGGGAGAGACCCAGTACTTC", "TGCAGCGTTGATCTGACGGGAGAGACCCAGTACTTC"
    assert one(a, b, "global", Costs("linear", far, 2)) == 4
    assert one(a, b, "global", Costs("affine", far, 2, 5)) == 5
    assert one("ACGT", "AT", "global", Costs("linear", far, 2)) == 4
    assert one("ACGT", "AT", "global", Costs("affine", far, 2, 5)) == 9
    assert one("ACGTTT", "ACG", "anchored", Costs("affine", far, 2, 5)) == [0, 3, 3]
    assert one("AACGT", "ACGT", "anchored", Costs("affine", far, 2, 5)) == [7, 5, 4]
    assert [one("CART", t, "anchored", Costs("unit")) for t in ("CAR", "CARTON", "CARBON", "")] == [[0, 3, 3], [0, 4, 4], [1, 4, 3], [0, 0, 0]]
    assert one("ABCDEFGHIJKLMNO", "ABEFGHIJKLMNO", "single_gap", Costs("unit", None, 2)) == 11
    assert one("GTT", "GACCC", "single_gap", Costs("unit", None, 1)) == 2
    skew = CostMatrix({"A": {"A": 0, "C": 1}, "C": {"A": 3, "C": 0}})
    assert one("A", "C", "global", Costs("linear", skew, 9)) == 1
    assert one("C", "A", "global", Costs("linear", skew, 9)) == 3


@pytest.mark.parametrize("alias, mode", [("HM", "hamming"), ("Levenshtein", "global"), ("gb", "global"), ("EN", "anchored"), ("extension", "anchored")])
def test_modes(alias, mode):
    assert params.normalize_mode(alias) == mode


def test_validation():
    m = generate_cost_matrix("AC")
    with pytest.raises(ValueError):
        params.normalize_mode("edit")
    with pytest.raises(ValueError):
        CostMatrix({"A": {"A": 0, "C": 1}})
    with pytest.raises(ValueError):
        CostMatrix({"A": {"A": -1}})
    with pytest.raises(ValueError):
        CostMatrix({"A": {"A": 0.5}})
    for bad in ({"gap_cost": 0}, {"gap_cost": 1.5}, {"gap_cost": 1, "gap_open_cost": -1}, {"gap_open_cost": 1}):
        with pytest.raises(ValueError):
            params.costs("global", m, **bad)
    diagonal = generate_cost_matrix("AC", match=1, mismatch=2)
    with pytest.raises(ValueError):
        params.costs("global", diagonal)
    assert params.costs("global", diagonal, zero_diagonal=False).algorithm == "linear"
    with pytest.warns(UserWarning):
        assert params.costs("hamming", m).algorithm == "hamming"
    with pytest.warns(UserWarning):
        assert params.costs("global", None, 3).algorithm == "unit"
    assert params.costs("global", m).algorithm == "unit"
    assert params.costs("global", m, 2).algorithm == "linear"
    assert params.costs("anchored", m, 2, 1).first == 3
    with pytest.raises(ValueError):
        m.covers("ACG")
    n = generate_cost_matrix("AC", "N", 0, 2)
    assert n.costs["N"]["A"] == n.costs["C"]["N"] == 0 and n.costs["A"]["C"] == 2
    assert params.costs("global", n).edits(5) is None


def test_distances(spark, rows):
    pairs = spark.createDataFrame([(1, "ACG", "ACGT"), (2, "", ""), (3, None, "A"), (4, "é", "e"), (5, "AAAA", "ACGT")], "id int, query string, target string")
    assert [r[0] for r in dist_pairwise(pairs, "lv").orderBy("id").select("distance").collect()] == [1, 0, None, 2, 3]
    assert [r[0] for r in dist_pairwise(pairs, "lv", unit="char").orderBy("id").select("distance").collect()] == [1, 0, None, 1, 3]
    assert [r[0] for r in dist_pairwise(pairs, "hm").orderBy("id").select("distance").collect()] == [None, 0, None, None, 3]
    an = dist_pairwise(pairs, "an").orderBy("id").select("distance", "query_size", "target_size").collect()
    assert tuple(an[0]) == (0, 3, 3) and tuple(an[1]) == (0, 0, 0) and tuple(an[2]) == (None, None, None)
    q = spark.createDataFrame([("ACGT",), ("AAAA",), ("ACGT",)], "query string")
    assert dist_matrix(q, q.withColumnRenamed("query", "target"), "gb").count() == 9


def test_wide_and_sql(spark, rows):
    from nearkin.functions.distance import wide
    from nearkin.functions.sql import register

    q = spark.createDataFrame([(0, "ACGT"), (1, "AAAA")], "i long, query string")
    t = spark.createDataFrame([(5, "ACG"), (6, "ACGT")], "j long, target string")
    m = dist_matrix(q, t, "gb", query_id="i", target_id="j")
    assert rows(wide(m, [5, 6]), "query_id", "5", "6") == [(0, 1, 0), (1, 3, 3)]
    assert wide(m).columns == ["query_id", "query", "5", "6"]
    register(spark)
    r = spark.sql("select hamming_distance(a, b) h, anchored_distance(a, b).distance d, single_gap_distance(a, b) s, hamming_distance(a, 'x') n from values ('ACGT', 'AGGT') t(a, b)").first()
    assert tuple(r) == (1, 1, 1, None)
