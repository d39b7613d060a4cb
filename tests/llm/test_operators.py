"""Operators against plain versions on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from nearkin.llm import decontamination, differencing, encoding, markup, packing, quality, simhash, substrings, token_files, topk, toxicity, warc

DOCS = "doc_id long, text string, row_id long, fp long, slab int, words string, k int, score string, doc string, c0 int"
SPACE = b" \t\n\r\x0b\x0c"


def corpus(n=120, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcéX") for _ in range(r.randint(1, 4)))
    shared = [[word() for _ in range(r.randint(14, 60))] for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [[word() for _ in range(r.randint(0, 40))] for _ in range(3)]
        if r.random() < 0.6:
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts.insert(r.randint(0, 3), s[a : r.randint(a, len(s))])
        texts.append(r.choice([" ", "\n", "  ", "\t"]).join(w for p in parts for w in p))
    texts += texts[:5] + [None, "", "   ", "one", "a b c", "x " * 400, "a b " * 300, " ".join(shared[0]), "  \x1c é　b"]
    texts.append(" ".join(word() for _ in range(30_000)) + " " + " ".join(shared[1]))
    return list(enumerate(texts))


def frame(spark, rows):
    extra = (7, 8, 9, "w", 3, "s", "d", 4)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows_(request):
    rows = corpus()
    r = random.Random(2)
    r.shuffle(rows)
    return rows


def keyed(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# 1


def brute_substrings(rows, k):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i, w in words.items():
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), kept)
    return out


@pytest.mark.parametrize("k", [2, 13])
def test_substrings(spark, rows_, k, monkeypatch):
    monkeypatch.setattr(substrings, "SLAB_BYTES", 3000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1)
    df = frame(spark, rows_)
    want = brute_substrings(rows_, k)
    assert keyed(substrings.digest_substrings(df, k), "n_words", "n_removed", "kept_sha256") == {i: w[:3] for i, w in want.items()}
    cut = substrings.remove_substrings(df, k)
    assert cut.columns == df.columns
    kept = keyed(cut, "text", "score")
    assert {i: (t or "").encode().split() for i, (t, _) in kept.items()} == {i: w[3] for i, w in want.items()}
    original = dict(rows_)
    assert all(kept[i][0] == original[i] for i, w in want.items() if not w[1])


def test_substrings_without_ids_and_same_ids(spark):
    t = " ".join("abcdefghijklmnop")
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((r[0] or 0, r[2]) for r in substrings.digest_substrings(df).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 16)]
    assert substrings.digest_substrings(df.limit(0)).collect() == []


# 2


def brute_hits(text, items, n=8):
    words = decontamination_words(text)
    hit, found = set(), set()
    for i, t in items:
        w = decontamination_words(t)
        if not w or i is None:
            continue
        m = min(n, len(w))
        windows = {tuple(w[p : p + m]) for p in range(len(w) - m + 1)}
        at = [p for p in range(len(words) - m + 1) if tuple(words[p : p + m]) in windows]
        if at:
            found.add(i)
            hit.update(q for p in at for q in range(p, p + m))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2


def decontamination_words(text):
    out, now = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c >= "\x80" or c.isdigit() and c.isascii() or "a" <= c <= "z":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


@pytest.mark.parametrize("most", [20_000, 3])
def test_decontamination(spark, rows_, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    texts = [t for _, t in rows_ if t]
    items = [(i, " ".join(t.split()[3 : 3 + n]).upper()) for i, (t, n) in enumerate(zip(texts[:12], [9, 8, 20, 5, 3, 1, 12, 8, 2, 30, 10, 7], strict=True))]
    items += [(50, None), (51, ""), (52, "É é! İx ẞ straße ΑΣ ς"), (None, texts[0]), (3, texts[20])]
    rows = [*rows_, (900, "İx ẞ straße ΑΣ ς É-é... " + (items[0][1] or "")), (901, "--É é İx ẞ straße ΑΣ ς!")]
    got = keyed(decontamination.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {i: brute_hits(t, items) for i, t in rows}


def test_decontaminate_cuts_and_drops(spark):
    items = [(1, "the quick brown fox jumps over a dog"), (2, "one two three four five six seven eight nine")]
    docs = [(1, "Keep, this. THE quick, brown fox jumps over a dog! and this."), (2, items[0][1] + " " + items[1][1]), (3, " ..clean text"), (4, None)]
    kept = keyed(decontamination.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")), "text", "c0")
    assert kept == {1: ("Keep, this. and this.", 4), 3: (" ..clean text", 4), 4: (None, 4)}
    none = decontamination.contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert {r["n_hit"] for r in none.collect()} == {0}


# 3


def brute_components(rows):
    prints = {}
    for i, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[p : p + 4]), 42) for p in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("most", [40, 8, 1])
def test_simhash_full_keys(spark, most):
    r = np.random.default_rng(5)
    fps = {0x0123456789ABCDEF ^ int(x) << 43 for x in r.integers(0, 1 << 20, 60)}  # two segments are equal in all
    for x in sorted(fps)[:25]:
        fps.add(x ^ sum(1 << int(b) for b in r.choice(63, r.integers(1, 6), replace=False)))
    fps = sorted(fps)
    root = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            least = min(root[y] for y in fps if (x ^ y).bit_count() <= 4)
            changed |= least < root[x]
            root[x] = min(least, root[x])
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), most))
    got = {x: x for x in fps} | {x["node"]: x["root"] for x in found.collect()}
    assert len(set(root.values())) < len(fps) and got == root


@pytest.mark.parametrize("most", [4096, 1])
def test_simhash(spark, rows_, most):
    rows = rows_[:90] + [(1000 + k, rows_[0][1]) for k in range(3)]
    df = frame(spark, rows)
    want = brute_components(rows)
    assert keyed(simhash.near_duplicates(df, most=most), "fingerprint", "component_id") == want
    if most > 1:
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_simhash_keys_meet():
    r = random.Random(3)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 4)):
            y ^= 1 << b
        keys, at = simhash.fingerprint_keys(np.array([x, y], np.uint64).view(np.int64))
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_spanning_links():
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = np.array(sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(40)}), np.uint64).view(np.int64)
    a, b = simhash.spanning_links(fps)
    assert all(int(np.int64(x) ^ np.int64(y)).bit_count() <= 64 for x, y in zip(a, b, strict=True))
    from nearkin.llm.components import forest

    node, root = forest(np.array(a), np.array(b))
    full = [(x, y) for k, x in enumerate(fps) for y in fps[k + 1 :] if (int(x) & (1 << 64) - 1 ^ int(y) & (1 << 64) - 1).bit_count() <= 4]
    n2, r2 = forest(np.array([x for x, _ in full]), np.array([y for _, y in full]))
    assert dict(zip(node, root, strict=True)) == dict(zip(n2, r2, strict=True))


def test_components(spark):
    from nearkin.llm.components import components, forest

    r = random.Random(11)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000, 2000 + k) for k in range(300)] + [(3000 + k, 3001 + k) for k in range(200)] + [(9000, 8000 + k) for k in range(100)] + [(-5, 3)]
    a, b = (np.array([p[k] for p in pairs if p[0] != p[1]]) for k in (0, 1))
    node, root = forest(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict(zip(node.tolist(), root.tolist(), strict=True))


def test_simhash_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "zz"), (6, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (6, 6)], key=str)
    assert simhash.keep_one(df).count() == 3
    assert simhash.near_duplicates(df.limit(0)).collect() == []


# 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav class="x"><ul><li><a href="/">Home</a><li>More</ul></nav>
<div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header><p>One<br>two <b>thr</b>ee&nbsp;x<p>Shared line</p><section class="comments"><p>First!</p></section></article><footer>&copy; us</footer>"""


def test_markup_and_differencing(spark):
    assert differencing.main_text(markup.lines(PAGE), None)[0] == "A & B One two three x Shared line"
    assert markup.lines(None) == [] and markup.lines("plain &lt;text") == [("plain <text", markup.PLAIN)]
    a, b = (f"<body><div>Menu of the host</div><div>Own text of page {k}</div><div>End of the page</div></body>" for k in "ab")
    rows = [(1, "http://h.example/a/1", PAGE), (2, "http://h.example/a/2?x#y", a), (3, "http://h.example/a/3", b), (4, None, None), (5, "http://other.example/", a), (6, "http://h.example/b/1", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in differencing.extract(df).collect()}
    assert got[1][0] == "A & B One two three x Shared line"
    assert got[3] == ("Own text of page b", 18)
    assert got[4] == ("", 0) == got[6]
    assert got[5][0] == "Menu of the host Own text of page a End of the page"
    assert differencing.extract(df.limit(0)).collect() == []


def test_common_subsequence():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = [a[i] for i in sorted(differencing.shared(a, b))]
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(x in rest for x in found)


# 5 and 6


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json")]


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder(files, rows_):
    r = random.Random(6)
    alphabet = "ab Zé\n\t '.,1٣sΣ́ 　\x1c\x85中İ!<|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += [t or "" for _, t in rows_] + ["it's we'll 'tis %'s o'%s", "x<|endoftext|>y", "᠎ a"]
    for path in files:
        for most in (700_000, 200):
            got = encoding.Encoder(path, most).encode(texts)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(path, texts)


def test_token_files(spark, files, rows_, tmp_path):
    manifest = token_files.write_tokens(frame(spark, rows_), files[0], 2, str(tmp_path))
    order = sorted(rows_)
    want = [ids + [2] for ids in library(files[0], [t or "" for _, t in order])]
    got = sorted(token_files.read_tokens(manifest).collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    some = token_files.read_tokens(manifest, [order[3][0], order[50][0]], sums=True).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in some) == [(order[k][0], zlib.crc32(struct.pack(f"<{len(want[k])}I", *want[k]))) for k in (3, 50)]
    path = max(tmp_path.glob("*.zst"), key=lambda p: p.stat().st_size)
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception):
        token_files.read_tokens(manifest).collect()


def test_token_files_without_ids(spark, files):
    df = spark.createDataFrame([(None, "a"), (2, None), (2, "b"), (1, "c")], "doc_id long, text string")
    got = token_files.read_tokens(token_files.write_tokens(df, files[0], 2)).collect()
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in got)[0] == (0, None, 2)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 1, 2, 2]
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0), files[0], 2)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    r = np.random.default_rng(seed)
    window = 64
    lengths = [r.integers(1, 200, 300), np.full(500, 7), r.integers(60, 70, 100), np.array([1]), np.array([], int), np.array([64, 128])][seed]
    doc, start, n, seq, at = packing.pack(lengths, window)
    for d, length in enumerate(lengths):
        own = sorted(zip(start[doc == d], n[doc == d], strict=True))
        assert [s for s, _ in own] == np.cumsum([0, *(x for _, x in own)])[:-1].tolist() and sum(x for _, x in own) == length
    for s in set(seq.tolist()):
        own = sorted(zip(at[seq == s], n[seq == s], strict=True))
        assert [a for a, _ in own] == np.cumsum([0, *(x for _, x in own)])[:-1].tolist()
        total = sum(x for _, x in own)
        assert total == window or total & (total - 1) == 0
    if len(lengths) and seed < 3:  # most documents stay whole
        assert len(doc) < len(lengths) + (lengths // window).sum() + 0.6 * len(lengths)


def test_nnls():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = r.random((6, 15)), r.random(6) * 10
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 1e-9]).max(initial=0) < 1e-6


def test_pack_documents(spark, files, rows_):
    got = packing.pack_documents(frame(spark, rows_), files[1], 1, 256).collect()
    want = {i: ids + [1] for (i, _), ids in zip(rows_, library(files[1], [t or "" for _, t in rows_]), strict=True)}
    seen = defaultdict(list)
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        seen[r["doc_id"]].append((r["start"], r["length"]))
    assert {i: sum(n for _, n in x) for i, x in seen.items()} == {i: len(x) for i, x in want.items()}
    totals = Counter()
    for r in got:
        totals[r["sequence_id"]] += r["length"]
    assert all(n == 256 or n & (n - 1) == 0 for n in totals.values())


# 7


def test_warc(spark, tmp_path):
    source = warc.response(7, "http://h.example/a", "2020-01-02T03:04:05Z", PAGE)
    headers, block = warc.parse(source)
    made = dict((h["warc-type"], (h, b)) for h, b in map(warc.parse, warc.derive(source)))
    conversion, metadata = made["conversion"], made["metadata"]
    for h, _ in made.values():
        assert h["warc-refers-to"] == headers["warc-record-id"] and h["warc-date"] == h["warc-refers-to-date"] == "2020-01-02T03:04:05Z" and h["warc-target-uri"] == "http://h.example/a"
    assert b"two three x" in conversion[1] and b"<" not in conversion[1]
    import json

    about = json.loads(metadata[1])
    assert about["source-payload-digest"] == headers["warc-payload-digest"] == warc.digest(PAGE.encode()) and about["conversion"] == conversion[0]["warc-record-id"]
    assert ["Content-Type", "text/html; charset=utf-8"] in about["http-headers"]
    with pytest.raises(ValueError):
        warc.parse(source[:-9] + b"x" + source[-8:])
    rows = [(1, "http://h.example/1", PAGE), (2, None, None), (None, "http://h.example/é\n", "<p>é"), (1, "http://h.example/1", PAGE)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int")
    found = warc.build_derivatives(warc.responses(df), str(tmp_path)).collect()
    stored = [warc.parse(x) for p in tmp_path.glob("*.gz") for x in warc.read_records(p.read_bytes())]
    assert sorted((h["warc-record-id"], h["warc-block-digest"]) for h, _ in stored) == sorted((r["record_id"], r["block_digest"]) for r in found)
    assert len(found) == 8 and len({r["record_id"] for r in found}) == 6 and {r["page_id"] for r in found} == {1, 2, None}
    assert warc.build_derivatives(warc.responses(df.limit(0))).collect() == []


# 8 and 9


def labelled(n=400, seed=8):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        words = ["".join(r.choice("abcde") for _ in range(r.randint(2, 5))) for _ in range(r.randint(5, 60))]
        if bad:
            words = [w + "%%%" if r.random() < 0.7 else w for w in words]
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["Rotten", "awfulness", "awfully"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return docs, labels


@pytest.mark.parametrize("op, column, modulus, remainder", [(toxicity.score_toxicity, 2, 4, 2), (quality.score_quality, 1, 5, 0)])
def test_classifiers(spark, op, column, modulus, remainder):
    docs, labels = labelled()
    docs += [(900, None), (901, ""), (None, docs[0][1]), (902, "xx " * 30_000), docs[0]]
    table = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1), labels[1]], "doc_id long, quality int, toxic int")
    got = op(frame(spark, docs), table).collect()
    assert len(got) == len(docs)
    truth = {x[0]: x[column] for x in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % modulus == remainder else (i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = op(frame(spark, docs), other).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)
    assert op(frame(spark, docs).limit(0), table).collect() == []
    assert op(frame(spark, docs), table.limit(0)).count() == len(docs)


# 10


@pytest.mark.parametrize("kind", ["spread", "equal"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    r = np.random.default_rng(9)
    n = 600
    v = r.normal(size=(n, 6))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if kind == "equal" else v * r.lognormal(0, 1, size=(n, 1))
    v[100:300] = v[7]
    v[400:403] = 0
    rows = [(i, [float(x) for x in row], "clash") for i, row in enumerate(v)]
    rows += [(1000, None, ""), (1020, [1.0, None], ""), (1040, [float("nan")] * 6, ""), (1060, [float("inf")] * 6, ""), (None, [1.0] * 6, ""), (1080, [2.0, 1.0], ""), (1100, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = defaultdict(list)
    for x in sorted(topk.top_k(df).collect()):
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    real = [(i, np.floor(64 * np.array(e, np.float32).astype(float)).astype(int)) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    m = np.zeros((len(real), 6), int)
    for k, (_, e) in enumerate(real):
        m[k, : len(e)] = e
    ids = np.array([i for i, _ in real])
    scores = m @ m.T
    for k in np.flatnonzero(ids % 20 == 0):
        order = [x for x in np.lexsort((ids, -scores[k])) if x != k][:20]
        assert got.pop(ids[k]) == [(ids[x], scores[k][x]) for x in order]
    assert not got
    assert topk.top_k(df.limit(0)).collect() == [] and topk.top_k(df.limit(5)).count() == 4
