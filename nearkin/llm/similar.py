"""Near copies: SimHash fingerprints met by Golay-code keys, and five-word shingles compared to 0.8 or more.

A node is a set of distinct shingles; equal sets are one node, whatever the number of documents. Each shingle has
WORDS times 64 hash bits, of which the first 64 are those of `simhash`; a node's count of a bit is the number of
shingles that have it, and its fingerprint is the majority of each. FINGERPRINT words of it are compared. The other
bits are SEGMENTS segments of 23, the length of the binary Golay code, and a segment's key is the codeword nearest
to it: nearest by the sum of the counts' majorities, with signs, as near copies differ in bits whose majority is
small. Nodes of a key whose fingerprints are linked by at most BITS differing bits form a unit. Units of the same
nodes are taken once, and the nodes of a unit are then compared by their whole sets, so a link is never an estimate.

Of sets of similarity 0.8 a segment's keys are equal in 26 of 100 cases by simulation, so none of the 47 is equal in
about one pair of a million, and in fewer above. A bit differs in 15 of 100 cases (19 at worst, in sets of four and
five shingles), 29 (36) of 192, with a standard deviation of 5; unrelated sets differ in 96, with one of 7. Search goes from one node to the next and each leaves it when reached, so that links span each cluster. Units
of more than MOST nodes are dealt into parts, and every two parts meet. Components follow by Spark joins. A key has
a 4,096th of the nodes by chance, and these are compared by fingerprints, which grows with the square of the nodes.

Words are lower-cased; a text of fewer words than a shingle is one shingle, and texts without words are one node.
Rows without an id get their component's id but lend none; repeated rows are one node, and one of them stays. An
empty table gives no rows. Rows are numbered in a stored table, so that all scans have the same numbers; other
columns pass through, whatever their names. A very long text is one set of hashes, which a task holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import numbered, own, partitions, stored
from .simhash import SEED, golay_tables, one_of_each, shingle_hashes

#: Words of a shingle; least similarity of a link; nodes of a unit that meet at once.
SHINGLE, SIMILARITY, MOST = 5, 0.8, 512
#: Words of 64 hash bits; words that are compared; differing bits of a link in them; Golay-coded segments of the rest.
WORDS, FINGERPRINT, BITS, SEGMENTS = 20, 3, 60, 47
#: Nodes of a key that are compared by shifts of the whole block; rows of a block; links of a row that are held.
SHIFTS, BLOCK, LINKS = 256, 1 << 17, 8
#: What gives each word its own hash bits (fixed values), and an odd multiplier that mixes them.
ORDERS = np.append(np.uint64(0), np.random.default_rng(SEED).integers(0, 1 << 63, WORDS - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes((text or "").lower(), size), np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29, 32):
        x = (x ^ x >> np.uint64(shift)) * MIX
    return x ^ x >> np.uint64(31)


def majorities(hashes: np.ndarray) -> np.ndarray:
    """Of each hash bit, the shingles that have it less those that do not."""
    counts = np.zeros(64 * WORDS, np.int32)
    for k in range(0, len(hashes), 255):
        words = np.repeat(hashes[k : k + 255, None], WORDS, axis=1)
        words[:, 1:] = _mixed(words[:, 1:] ^ ORDERS[1:])
        counts += np.unpackbits(words.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return 2 * counts - np.int32(len(hashes))


@lru_cache
def codewords() -> np.ndarray:
    """Signs of the 23 bits of each Golay codeword, as columns by its index."""
    words = np.arange(1 << 12) << 11 | golay_tables()[0]
    return np.ascontiguousarray(np.where(words >> np.arange(22, -1, -1)[:, None] & 1, 1, -1).astype(np.float32))


def golay_keys(counts: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each segment of rows of majorities."""
    segments = counts[:, 64 * FINGERPRINT : 64 * FINGERPRINT + 23 * SEGMENTS].astype(np.float32).reshape(-1, 23)
    found = [(segments[k : k + 512] @ codewords()).argmax(1) for k in range(0, len(segments), 512)]
    return np.concatenate(found).astype(np.uint16).reshape(-1, SEGMENTS)


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """Of each set, the fingerprint's words and the segments' keys; none of an empty one."""
    out: list[bytes | None] = [None] * len(sets)
    some = [k for k, s in enumerate(sets) if len(s)]
    for i in range(0, len(some), 64):
        part = some[i : i + 64]
        counts = np.array([majorities(sets[k]) for k in part])
        marks = np.packbits(counts[:, : 64 * FINGERPRINT] > 0, axis=1).view(">u8").astype(np.uint64)
        for k, m, g in zip(part, marks, golay_keys(counts), strict=True):
            out[k] = m.tobytes() + g.tobytes()
    return out


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of the nodes (node, signature): key, node and the fingerprint's words."""
    own("similar")
    names = ["key", "node", *(f"f{k}" for k in range(FINGERPRINT))]
    for batch in batches:
        for k in range(0, len(batch), 1000):
            b = batch.slice(k, 1000)
            both = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1)
            marks = np.ascontiguousarray(both[:, : 8 * FINGERPRINT]).view(np.int64)
            golay = np.ascontiguousarray(both[:, 8 * FINGERPRINT :]).view(np.uint16).astype(np.int32)
            keys = golay | np.arange(SEGMENTS, dtype=np.int32) << 12
            columns = [keys.ravel(), *(np.repeat(x, SEGMENTS) for x in (b.column(0).to_numpy(), *marks.T))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def fingerprint_links(keys: np.ndarray, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows, sorted by key, that connect what links of at most BITS bits connect in each key."""
    new = np.append(True, keys[1:] != keys[:-1])
    firsts = np.flatnonzero(new)
    ends = np.append(firsts[1:], len(keys))
    end = ends[np.cumsum(new) - 1]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(m[x] ^ m[y]) for m in marks) <= BITS

    def add(x: np.ndarray, y: np.ndarray) -> None:
        a.append(x)
        b.append(y)
        if sum(map(len, a)) > LINKS * max(BLOCK, len(keys)):
            a[:], b[:] = ([x] for x in forest(np.concatenate(a), np.concatenate(b)))

    at = np.flatnonzero((ends - firsts <= SHIFTS)[np.cumsum(new) - 1])
    for shift in range(1, SHIFTS):
        at = at[at + shift < end[at]]
        if not len(at):
            break
        found = at[near(at, at + shift)]
        add(found, found + shift)
    for k in np.flatnonzero(ends - firsts > SHIFTS):
        left = np.arange(firsts[k], ends[k])  # each row leaves once, so a key has no more links than rows
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                linked = near(x, left)
                if linked.any():
                    found = left[linked]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    queue.extend(found)
                    left = left[~linked]
    return np.concatenate(a), np.concatenate(b)


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, n and node of linked nodes of rows (key, node, fingerprint's words) that are sorted by key."""
    own("similar")

    def units(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, nodes, *marks = columns
        child, root = forest(*fingerprint_links(keys, [m.view(np.uint64) for m in marks]))
        tops = np.unique(root)
        place, label = np.append(child, tops), np.append(root, tops)
        order = np.argsort(label, kind="stable")
        place, label = place[order], label[order]
        _, starts, sizes = np.unique(label, return_index=True, return_counts=True)
        ids = np.add.reduceat(_mixed(nodes[place].view(np.uint64)), starts) if len(place) else np.zeros(0, np.uint64)
        found = [np.repeat(ids.view(np.int64), sizes), np.repeat(sizes, sizes), nodes[place]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["unit", "n", "node"])

    held: list[list[np.ndarray]] = []
    rows, most = 0, BLOCK
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += len(batch)
        if rows >= most:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield units([c[:cut] for c in columns])
            held, rows = [[c[cut:] for c in columns]], rows - cut
            most = max(BLOCK, 2 * rows)
    if rows:
        yield units([np.concatenate(c) for c in zip(*held, strict=True)])


def similar_links(nodes: list[int], sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect what pairs of at least this similarity connect."""
    a: list[int] = []
    b: list[int] = []
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            own_set = sets[x]
            able = np.minimum(sizes[left], len(own_set)) >= similarity * np.maximum(sizes[left], len(own_set)) - 1e-9
            near = np.zeros(len(left), bool)
            if able.any():
                some = left[able]
                every = np.concatenate([sets[k] for k in some])
                found = own_set[np.minimum(np.searchsorted(own_set, every), len(own_set) - 1)] == every
                common = np.add.reduceat(found.astype(np.int64), np.append(0, np.cumsum(sizes[some])[:-1]))
                near[able] = common >= similarity * (sizes[some] + len(own_set) - common) - 1e-9
            if near.any():
                a.extend([nodes[x]] * int(near.sum()))
                b.extend(nodes[k] for k in left[near])
                queue.extend(left[near])
                left = left[~near]
    return a, b


def _similar(docs: DataFrame, shingle: int, similarity: float, most: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Numbered rows of docs, and row_id, doc_id, component_id and root of each."""
    n = partitions(docs.sparkSession)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("similar")
        for b in batches:
            for k in range(0, len(b), 64):
                c = b.slice(k, 64)
                found = [shingle_set(x.as_py(), shingle) for x in c.column(2)]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(node), pa.array(signatures(found), pa.binary())], ["row_id", "doc_id", "node", "signature"])

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("similar")
        for b in batches:
            found = [shingle_set(x.as_py(), shingle).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("similar")
        last, nodes, held = None, [], []

        def links() -> pa.RecordBatch:
            a, b = similar_links(nodes, held, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for now, node, hashes in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if now != last:
                    if len(nodes) > 1:
                        yield links()
                    last, nodes, held = now, [], []
                nodes.append(node)
                held.append(np.frombuffer(hashes.as_py(), np.uint64))
        if len(nodes) > 1:
            yield links()

    numbers = numbered(docs, "similar")
    texts = numbers.select("row_id", F.col("doc").getField(key).cast("long").alias("doc_id"), F.col("doc").getField(text).alias("text"))
    rows = stored(texts.mapInArrow(sign, "row_id long, doc_id long, node long, signature binary"), "signatures")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row_id").alias("row_id"), F.first("signature").alias("signature")), "nodes")
    marks = ", ".join(f"f{k} long" for k in range(FINGERPRINT))
    keys = nodes.filter("signature IS NOT NULL").select("node", "signature").mapInArrow(_spread, f"key int, node long, {marks}")
    met = keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_units, "unit long, n long, node long").distinct()
    # a unit of more than `most` nodes has parts of half as many on average, and every two parts meet
    half = max(1, most // 2)
    parts = F.when(F.col("n") > most, F.ceil(F.col("n") / half)).otherwise(1).cast("int")
    met = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")))
    units = met.select("unit", "node", "part", F.explode(others).alias("other"))
    units = stored(units.select("unit", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node"), "units")
    first = units.select("node").distinct().join(nodes.select("node", "row_id"), "node")
    whole = texts.join(first, "row_id").select("node", "text").mapInArrow(sets, "node long, hashes binary")
    together = units.join(whole, "node").select("unit", "p", "q", "node", "hashes").repartition(n, "unit", "p", "q").sortWithinPartitions("unit", "p", "q")
    reached = components(together.mapInArrow(compare, "a long, b long"))
    member = nodes.join(reached, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return numbers, rows.join(member.join(ids, "root").select("node", "root", "component_id"), "node").select("row_id", "doc_id", "component_id", "root")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and component_id of each row."""
    return _similar(docs, shingle, similarity, most, text, key)[1].select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the smallest id, or the first row where none has an id."""
    return one_of_each(*_similar(docs, shingle, similarity, most, text, key))
