"""Words whose lower case depends on what stands beside them, benchmarks of any size, and what is read and shuffled."""

import random

import pytest
from test_operators import brute_hits

from nearkin.llm import decontamination

COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(params=["broadcast", "shuffled", "full bitmap"])
def way(request, monkeypatch):
    """The benchmark's windows are broadcast or shuffled, and the bitmap is large or takes nearly everything."""
    if request.param != "broadcast":
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    if request.param == "full bitmap":
        monkeypatch.setattr(decontamination, "BITMAP_BITS", 1 << 15)
        monkeypatch.setattr(decontamination, "MOST_BITS", 1)


def found(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_final_sigma(spark, way):
    items = [(1, "ΟΔΟΣ T one ΛΟΓΟΣ three ΟΣ five six"), (2, "ΑΣ b"), (3, "ας b"), (4, "ΑΣ Α ΑΣ Α ΑΣ Α ΑΣ Α")]
    docs = [(1, "x ΟΔΟΣ.T one ΛΟΓΟΣ:three ΟΣ'five six y"), (2, "ΑΣ'b"), (3, "ΑΣ b"), (4, "ας.b"), (5, "ασ b"), (6, "ΑΣ.Α ΑΣ.Α ΑΣ.Α ΑΣ.Α"), (7, "ΑΣ'Α ΑΣ'Α ΑΣ'Α ΑΣ'Α")]
    got = found(spark, docs, items)
    assert got == {i: brute_hits(t, items) for i, t in docs}
    assert got[6][1:3] == (8, 1) == got[7][1:3]


def test_many_windows(spark, way):
    """More windows than bits of the smallest bitmap, of all lengths, in documents that are hit at their edges."""
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 5, 7, 8, 9, 30])))) for i in range(300)] + [(7, "late item of id seven"), (None, "aa"), (400, "")]
    docs = [(i, r.choice([" ", "-", " . "]).join(word() for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100, items[5][1]), (101, None), (102, "late ITEM of id seven")]
    assert found(spark, docs, items) == {i: brute_hits(t, [(k, t2) for k, t2 in items]) for i, t in docs}


def test_windows_across_pieces(spark, monkeypatch):
    """Occurrences begin and end everywhere in the pieces that a document is scanned in."""
    monkeypatch.setattr(decontamination, "PIECE", 5)
    r = random.Random(5)
    items = [(1, "a b a c a b a d a b"), (2, "x y z"), (3, "q")]
    docs = [(i, " ".join(["o"] * i + items[r.randrange(3)][1].split() + ["o"] * 3 + ["a b a c a b a d"][: i % 2])) for i in range(20)]
    assert found(spark, docs, items) == {i: brute_hits(t, items) for i, t in docs}


def test_no_text_is_shuffled(spark):
    """The plan broadcasts the set, and only places and ids of what it takes are exchanged."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = decontamination.contamination(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan
