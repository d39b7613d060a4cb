"""Texts whose polynomial hashes collide: Thue-Morse runs of letters and of words."""

import numpy as np
from test_operators import brute_substrings, keyed

from nearkin.llm import substrings
from nearkin.llm.words import BASES, Words, prefix, runs


def thue_morse(n, a, b):
    return [b if k.bit_count() & 1 else a for k in range(n)]


def test_runs_collide_and_words_do_not():
    """What the operator has to withstand: runs of 1,024 words with one hash."""
    for n, equal in ((8, False), (2048, True)):
        sums = []
        for pair in (("x", "y"), ("y", "x")):
            data = np.frombuffer(" ".join(thue_morse(n, *pair)).encode(), np.uint8)
            h = Words(data, np.array([0, len(data)])).hashes()
            sums.append(int(runs(prefix(h, BASES[0]), np.array([0]), np.array([n]), BASES[0])[0]))
        assert (sums[0] == sums[1]) is equal
    texts = ["".join(thue_morse(2048, *p)) for p in ("ab", "ba")] + ["a" * n for n in range(1, 130)] + ["a" * n + "b" for n in range(1, 130)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    assert len(set(words.hashes().tolist())) == len(texts) and words.run(2, 5) == b"a aa aaa"


def test_thue_morse(spark):
    head = " ".join("abcdefghijkl")
    x, y = ("".join(thue_morse(1024, *p)) for p in ("ab", "ba"))
    long = [" ".join(thue_morse(2048, *p)) for p in ("no", "on")]
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, long[0]), (4, f"z {long[1]} z"), (5, long[1]), (6, f"{head} m {y}"), (7, f"{head}  m\n{y} {head} {x}"), (8, None), (8, head), (9, "")]
    want = brute_substrings([r for r in rows if r[0] != 8] + [(8, head)], 13)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = keyed(substrings.digest_substrings(df.filter("doc_id != 8 or text is not null")), "n_words", "n_removed", "kept_sha256")
    assert got == {i: w[:3] for i, w in want.items()}
    assert got[2][1] == 0 and got[7][1] > 13
    assert substrings.digest_substrings(df).count() == len(rows)
