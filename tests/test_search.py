import random

import pytest

from nearkin.functions.costs import CostMatrix, generate_cost_matrix
from nearkin.functions.kernels import batches
from nearkin.functions.params import costs as make_costs
from nearkin.operators import search, split
from nearkin.operators.sets import LengthSet, SequenceSet
from nearkin.sources import tables


def texts(n, seed, alphabet="ACGT", longest=14):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


def changed(s, r):
    out = []
    for c in s:
        x = r.random()
        out += [] if x < 0.08 else [c, r.choice("ACGT")] if x < 0.16 else [r.choice("ACGT")] if x < 0.24 else [c]
    return "".join(out)


RANDOM = CostMatrix({q: {t: 0 if q == t else 1 + (ord(q) + 3 * ord(t)) % 3 for t in "ACGT"} for q in "ACGT"})
FREE = generate_cost_matrix("ACGT", "N")
CASES = [
    ("hamming", None, {}, 3), ("global", None, {}, 0), ("global", None, {}, 3), ("anchored", None, {}, 2),
    ("global", RANDOM, {"gap_cost": 2}, 4), ("anchored", RANDOM, {"gap_cost": 2}, 3),
    ("global", RANDOM, {"gap_cost": 1, "gap_open_cost": 2}, 4), ("anchored", RANDOM, {"gap_cost": 2, "gap_open_cost": 1}, 4),
    ("global", FREE, {"gap_cost": 2}, 2),
]


@pytest.mark.parametrize("mode, matrix, gaps, k", CASES)
def test_search_is_all_pairs_filtered(spark, rows, mode, matrix, gaps, k):
    r = random.Random(5)
    targets = texts(120, 1) + ["", "A"]
    queries = [changed(x, r) for x in targets[:60]] + texts(20, 2) + [""]
    queries = queries + queries[:3] + [None]
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    t = spark.createDataFrame([(x,) for x in [*targets, *targets[:5], None]], "target string")
    got = rows(search.similarity_join(q, t, k, mode=mode, cost_matrix=matrix, **gaps))
    pairs = [(a, b) for a in queries if a is not None for b in set(targets)]
    c = make_costs(mode, matrix, **gaps)
    found = batches([a for a, _ in pairs], [b for _, b in pairs], mode, c, "byte").tolist()
    if mode == "anchored":
        want = [(a, b, *x) for (a, b), x in zip(pairs, found, strict=True) if x[0] <= k]
    else:
        want = [(a, b, x) for (a, b), x in zip(pairs, found, strict=True) if 0 <= x <= k]
    assert got == sorted(want, key=repr)
    assert rows(search.similarity_join(q, t, k, mode=mode, cost_matrix=matrix, strategy="nested", **gaps)) == got


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_single_gap(spark, rows, gap):
    targets, queries = texts(100, 3, longest=9), texts(60, 4, longest=9)
    got = rows(search.single_gap_search(spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame([(x,) for x in targets], "target string"), 2, gap))
    from nearkin.functions.params import Costs

    pairs = [(a, b) for a in queries for b in set(targets)]
    found = batches([a for a, _ in pairs], [b for _, b in pairs], "single_gap", Costs("unit", None, gap), "byte").tolist()
    assert got == sorted(((a, b, x) for (a, b), x in zip(pairs, found, strict=True) if x <= 2), key=repr)


def test_thresholds(spark, rows):
    q = spark.createDataFrame([("a" * 100, 1), ("a" * 100, 3)], "query string, k int")
    t = spark.createDataFrame([("a" * 100 + "b" * n,) for n in (0, 2, 28, 29)], "target string")
    assert {r[2] for r in rows(search.similarity_join(q, t, max_fraction=0.29))} == {0, 2, 28}  # 0.29 * 100 is below 29
    assert sorted(r[2] for r in rows(search.similarity_join(q, t, "k"))) == [0, 0, 2]
    assert {r[2] for r in rows(search.similarity_join(q, t, 2.9, max_fraction=0.9))} == {0, 2}
    for bad in ({}, {"max_distance": -1}, {"max_fraction": -0.5}):
        with pytest.raises(ValueError):
            search.similarity_join(q, t, **bad)
    assert rows(search.similarity_join(q.limit(0), t, 1)) == []
    assert [r[1:] for r in rows(search.similarity_join(q.limit(1), t, 30, limit=2))] == [("a" * 100, 0), ("a" * 100 + "bb", 2)]


def test_bytes_and_characters(spark, rows):
    q, t = spark.createDataFrame([("é",)], "query string"), spark.createDataFrame([("e",)], "target string")
    assert rows(search.similarity_join(q, t, 1)) == []
    assert rows(search.similarity_join(q, t, 1, unit="char")) == [("é", "e", 1)]


def test_dist_search_checks(spark):
    q = spark.createDataFrame([("A",)], "query string")
    t = q.withColumnRenamed("query", "target")
    with pytest.raises(ValueError):
        search.dist_search(q, t, 1, tree_class="list")
    with pytest.raises(ValueError):
        search.dist_search(q, t, 1, mode="anchored", tree_class="forest")
    with pytest.raises(ValueError):
        search.dist_search(q, t, 1, cost_matrix=RANDOM, tree_class="forest")
    with pytest.raises(ValueError):
        search.similarity_join(q.selectExpr("'AX' query"), t, 1, cost_matrix=RANDOM)
    with pytest.raises(ValueError):
        search.single_gap_search(q, t, None)
    assert search.dist_search(q, t, 0, tree_class="forest").count() == 1


def test_prefixes(spark, rows):
    words = SequenceSet(spark, ["plane", "plan", "planet", "play", "oak", "é", "éa"])
    assert [r[1] for r in rows(words.prefix_search(["pla"]))] == ["plan", "plane", "planet", "play"]
    assert len(rows(words.prefix_search(["", ""]))) == 14
    assert [r[1] for r in rows(words.prefix_search(["é"]))] == ["é", "éa"]
    assert rows(words.prefix_search([])) == []


@pytest.mark.parametrize("kind", [SequenceSet, LengthSet])
def test_sets(spark, rows, kind):
    r = random.Random(7)
    stored, have = kind(spark), set()
    for step in range(3):
        new = [r.choice(["", "A", "C", "AC", "ACG", "T", "GG"]) for _ in range(6)]
        want = []
        for x in new:
            want.append(x not in have if step < 2 else x in have)
            have.add(x) if step < 2 else have.discard(x)
        flags = stored.insert(new) if step < 2 else stored.erase(new)
        assert [tuple(x) for x in flags.orderBy("pos").collect()] == list(zip(range(6), new, want, strict=True))
        assert {x[0] for x in stored.to_df().collect()} == have and stored.size() == len(have)
    probe = ["A", "A", "none", None]
    assert [x["flag"] for x in stored.find(probe).orderBy("pos").collect()] == [p in have for p in probe]
    assert stored.validate()
    assert stored.charset() == sorted(set("".join(have)))


def test_tree(spark, rows):
    words = SequenceSet(spark, ["plane", "planet", "play", "oak"])
    assert rows(words.graph()) == sorted([("", "oak"), ("", "pla"), ("pla", "ne"), ("pla", "y"), ("ne", "t")], key=repr)
    assert rows(words.graph(depth=1, root_label="root")) == [("root", "oak"), ("root", "pla")]
    assert words.to_string() == "(root)\n oak:1\n pla\n  ne:1\n   t:1\n  y:1\n\n"
    assert SequenceSet(spark).to_string() == "(root)\n\n" and SequenceSet(spark, [""]).to_string() == "(root):1\n\n"
    assert words.validate() and rows(SequenceSet(spark).graph()) == []


def test_a_tree_for_each_length(spark, rows):
    by_length = LengthSet(spark, ["a", "b", "ab", "", "ac", "xyz"])
    assert by_length.to_strings() == {0: "(root):1\n\n", 1: "(root)\n a:1\n b:1\n\n", 2: "(root)\n a\n  b:1\n  c:1\n\n", 3: "(root)\n xyz:1\n\n"}
    assert rows(by_length.graph()) == sorted([("", "a"), ("", "b"), ("", "a"), ("a", "b"), ("a", "c"), ("", "xyz")], key=repr)
    assert rows(by_length.graph(1, "root")) == sorted([("root", "a"), ("root", "b"), ("root", "a"), ("root", "xyz")], key=repr)
    assert by_length.validate()
    assert rows(by_length.search(["a"], 1)) == sorted([("a", "a", 0), ("a", "b", 1), ("a", "ab", 1), ("a", "ac", 1), ("a", "", 1)], key=repr)


def test_split(spark, rows):
    """Reversed left sides and right sides are each anchored at the cut."""
    q = spark.createDataFrame([("TTGACCATG", 4), ("CCAGTGGATC", 5)], "query string, at int")
    t = spark.createDataFrame([("ATTGACCAT", 5), ("CAGTGGATCAA", 4)], "target string, at int")
    assert rows(split.split_search(q, t, "at", "at")) == sorted([("TTGACCATG", "ATTGACCAT", 0), ("CCAGTGGATC", "CAGTGGATCAA", 0)], key=repr)
    one = q.limit(1).select("query")
    assert rows(split.split_search(one, one.withColumnRenamed("query", "target"), -1, -1, edge_trim=2)) == [("TTGACCATG", "TTGACCATG", 0)]


ACCENTS = CostMatrix({q: {t: 0 if q == t else 5 if {q, t} == {"à", "è"} else 2 for t in "aàè"} for q in "aàè"})


def test_costs_of_wide_characters(spark, rows):
    q = spark.createDataFrame([("aaaà",)], "query string")
    t = spark.createDataFrame([("aaaè",), ("aaaa",)], "target string")
    for mode in ("global", "anchored"):
        with pytest.raises(ValueError, match="char"):
            search.similarity_join(q, t, 3, mode=mode, cost_matrix=ACCENTS, gap_cost=9)
        assert [r[1:3] for r in rows(search.similarity_join(q, t, 5, mode=mode, cost_matrix=ACCENTS, gap_cost=9, unit="char"))] == [("aaaa", 2), ("aaaè", 5)]
        assert [r[1:3] for r in rows(search.similarity_join(q, t, 3, mode=mode, cost_matrix=ACCENTS, gap_cost=9, unit="char"))] == [("aaaa", 2)]


def test_tables_and_stream(spark, rows, tmp_path):
    s = SequenceSet(spark, ["ab", "cd"])
    tables.write_set(s, str(tmp_path / "set"))
    assert rows(tables.read_set(spark, str(tmp_path / "set")).to_df()) == [("ab",), ("cd",)]
    from nearkin.streaming.search import search_stream

    spark.createDataFrame([("ab",), ("ax",)], "query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query string").parquet(str(tmp_path / "in"))
    seen = []
    run = search_stream(stream, s.to_df(), lambda df, _: seen.extend(df.collect()), str(tmp_path / "state"), target="sequence", max_distance=1)
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, seen)) == [("ab", "ab", 0), ("ax", "ab", 1)]


@pytest.mark.parametrize("mode, matrix, gaps, k", CASES)
def test_limit_is_a_part(spark, rows, mode, matrix, gaps, k):
    t = spark.createDataFrame([(x,) for x in texts(40, 6)], "target string")
    q = t.withColumnRenamed("target", "query")
    every = rows(search.similarity_join(q, t, k, mode=mode, cost_matrix=matrix, **gaps))
    first = rows(search.similarity_join(q.distinct(), t, k, mode=mode, cost_matrix=matrix, limit=1, **gaps))
    assert set(first) <= set(every) and len(first) == len({r[0] for r in every})
