"""Near copies against all pairs compared by their whole shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from nearkin.llm import simhash, similar
from nearkin.llm.components import forest


def near_copies(seed=21):
    """Rows in which most near copies differ in more than four bits of their fingerprints."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(2, 6)))
    texts = [None, "", " \t", "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    for copies in [0] * 10 + [2] * 8 + [40]:
        words = [word() for _ in range(r.randint(60, 160))]
        texts.append(" ".join(words))
        for _ in range(copies):
            changed = list(words)
            for at in r.sample(range(len(words)), r.randint(1, max(1, len(words) // 30))):
                changed[at] = word()
            texts.append(r.choice([" ", "\n"]).join(changed))
    texts += [texts[-1].upper(), texts[8]]
    return list(enumerate(texts))


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("most", [512, 6])
def test_similar_documents(spark, most):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, node long, keys int, root int")
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df, most=most).collect()} == want
    if most > 6:
        kept = similar.keep_one_similar(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
        assert similar.similar_documents(df.limit(0)).collect() == []


def test_stage_takes_near_copies(spark, tmp_path):
    rows = near_copies()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(rows).values()))


def test_similar_links():
    r = random.Random(22)
    base = [r.sample(range(10_000), 40) for _ in range(5)]
    sets = [np.unique(np.array(b[: r.randint(30, 40)] + r.sample(range(10_000), r.randint(0, 8)), np.uint64)) for b in base for _ in range(12)]
    near = {(i, j) for i in range(60) for j in range(60) if i != j and 10 * len(set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j]))}
    a, b = similar.similar_links(list(range(60)), sets, 0.8)
    assert set(zip(a, b, strict=True)) <= near

    def reached(pairs):
        label = list(range(60))
        for _ in range(60):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert reached(near) == reached(set(zip(a, b, strict=True)))


def signed(sets):
    found = similar.signatures([np.unique(np.array(s, np.uint64)) for s in sets])
    size = 8 * similar.FINGERPRINT
    return np.array([np.frombuffer(x[:size], np.uint64) for x in found]), np.array([np.frombuffer(x[size:], np.uint16) for x in found])


def test_signatures_are_simhash_and_golay():
    """The first word is the fingerprint of simhash, and each key the Golay codeword nearest to its segment's counts."""
    r = np.random.default_rng(23)
    sets = [r.integers(0, 1 << 64, n, dtype=np.uint64) for n in (1, 2, 5, 254, 255, 256, 1000)]
    marks, keys = signed(sets)
    checks = simhash.golay_tables()[0]
    words = [[2 * int(b) - 1 for b in f"{m << 11 | int(checks[m]):023b}"] for m in range(1 << 12)]
    assert min(sum(a != b for a, b in zip(words[0], w, strict=True)) for w in words[1:]) == 7
    for s, m, k in zip(sets, marks, keys, strict=True):
        assert int(m[:1].view(np.int64)[0]) == simhash.fingerprint([int(x) for x in s])
        counts = similar.majorities(np.unique(s))
        assert np.array_equal(counts[:64] > 0, [int(b) for b in f"{int(m[0]):064b}"])
        for at in range(0, similar.SEGMENTS, 9):
            segment = counts[64 * similar.FINGERPRINT + 23 * at :][:23]
            assert k[at] == np.argmax(np.array(words) @ segment)
    assert similar.signatures([np.zeros(0, np.uint64)]) == [None]


@pytest.mark.parametrize("common, first, second", [(4, 1, 0), (8, 1, 1), (16, 2, 2), (80, 20, 0), (80, 10, 10)])
def test_similar_sets_share_golay_keys(common, first, second):
    """Of pairs at 0.8 exactly all meet by a key with fingerprints that are linked; unrelated fingerprints are not linked."""
    r = np.random.default_rng(24)
    hashes = r.integers(0, 1 << 64, (1000, common + first + second), dtype=np.uint64)
    (m, k), (n, g) = signed(hashes[:, : common + first]), signed(np.delete(hashes, np.s_[common : common + first], 1))
    assert (k == g).any(1).all()
    assert (np.bitwise_count(m ^ n).sum(1) <= similar.BITS).all() and (np.bitwise_count(m ^ np.roll(n, 1, 0)).sum(1) > similar.BITS).all()


@pytest.mark.parametrize("shifts, block", [(256, 1 << 17), (4, 1 << 17), (256, 50)])
def test_units_of_keys(monkeypatch, shifts, block):
    """Nodes that links of fingerprints connect in a key are one unit, whatever the sizes of keys and blocks."""
    monkeypatch.setattr(similar, "SHIFTS", shifts)
    monkeypatch.setattr(similar, "BLOCK", block)
    r = random.Random(25)
    bits = 64 * similar.FINGERPRINT
    rows = []
    for key in range(40):
        for _ in range(r.choice([1, 2, 5])):
            now = r.getrandbits(bits)
            for _ in range(r.choice([1, 1, 3, 30])):
                rows.append((key, len(rows) + 1, now))
                for at in r.sample(range(bits), r.choice([20, similar.BITS, similar.BITS + 1])):
                    now ^= 1 << at
    want = set()
    for key in range(40):
        left = [x for x in rows if x[0] == key]
        while left:
            unit, left = [left[0]], left[1:]
            for x in unit:
                near = [y for y in left if (x[2] ^ y[2]).bit_count() <= similar.BITS]
                unit += near
                left = [y for y in left if y not in near]
            if len(unit) > 1:
                want.add(frozenset(y[1] for y in unit))
    columns = [np.array([x[0] for x in rows], np.int32), np.array([x[1] for x in rows], np.int64)]
    columns += [np.array([x[2] >> 64 * k & 0xFFFFFFFFFFFFFFFF for x in rows], np.uint64).view(np.int64) for k in range(similar.FINGERPRINT)]
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", *(f"f{k}" for k in range(similar.FINGERPRINT))])
    found = {}
    for b in similar._units(table.slice(k, 17) for k in range(0, len(rows), 17)):
        for unit, n, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault((unit, n), set()).add(node)
    assert {frozenset(x) for x in found.values()} == want and all(n == len(x) for (_, n), x in found.items())


def test_links_of_clusters_are_few(monkeypatch):
    """Keys full of near copies keep a bounded number of links, which connect as all do."""
    monkeypatch.setattr(similar, "BLOCK", 100)
    keys = np.repeat(np.arange(8), 250)
    a, b = similar.fingerprint_links(keys, [np.zeros(2000, np.uint64)] * similar.FINGERPRINT)
    child, root = forest(a, b)
    assert len(a) <= (similar.LINKS + 1) * 2000 and len(child) == 8 * 249 and set(root) == set(range(0, 2000, 250))
