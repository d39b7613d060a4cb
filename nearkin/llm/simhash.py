"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each padded to the 23 bits of the perfect
binary Golay code. A segment's keys are the indices of all codewords within four bits of it: one where the
nearest codeword is at most two bits away, else six. Two segments that differ in at most two bits share a key:
the nearest codeword of the point between them is within four bits of both. Of fingerprints that differ in at
most four bits, no two segments can differ in three bits or more each, so two of the three segments share a
key. The keys of two segments together are what fingerprints meet by; differing bits are then counted.

Equal fingerprints are one node, whatever the number of documents. Within the fingerprints of a key, links
that span each cluster are found by search from one fingerprint to the next, each leaving the search when
reached, so pairs are not listed. A key of more than MOST fingerprints is divided by five blocks of their bits, of
which one is equal where at most four bits differ, so five rows take the place of one. Where such a part again has
more than MOST, its fingerprints meet at every point within two bits of both (2,081 points each, and at most 2,081
fingerprints at a point). Neither loses a link, and both grow in proportion. Components follow by Spark joins.

Null and empty texts have no words; a very long text is hashed as one row. Rows without an id get their component's id but lend none; repeated rows are
separate rows of one component. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import numbered, own, partitions, stored

#: Differing bits of a link; bits of the segments; fingerprints of a key that one search takes.
BITS, SEGMENTS, MOST = 4, (22, 21, 21), 4096
#: Bits of the blocks that divide a full key; one block more than BITS.
BLOCKS = (13, 13, 13, 13, 12)
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
SEED = 42


def shingle_hashes(text: str | None, size: int) -> list[int]:
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: -size])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bits that more than half of the hashes have, as a signed 64-bit integer."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, ">u8")
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame, shingle: int = 4) -> DataFrame:
    """row_id, doc_id and fp of rows (row_id, doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("simhash")
        for b in batches:
            fps = [fingerprint(shingle_hashes(x.as_py(), shingle)) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["row_id", "doc_id", "fp"])

    return rows.mapInArrow(run, "row_id long, doc_id long, fp long")


@lru_cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The eleven check bits of each message, and of each syndrome the error patterns of at most four bits, padded with -1."""
    checks = np.zeros(1 << 12, np.int64)
    for m in range(1 << 12):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GOLAY << bit - 11
        checks[m] = r
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << x for x in bits)
            patterns[int(checks[e >> 11]) ^ e & 0x7FF].append(e)
    return checks, np.array([p + [-1] * (6 - len(p)) for p in patterns], np.int64)


def segment_keys(x: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of 23-bit words: six columns, -1 where there are fewer."""
    checks, patterns = golay_tables()
    errors = patterns[checks[x >> 11] ^ (x & 0x7FF)]
    return np.where(errors < 0, -1, (x[:, None] ^ errors) >> 11)


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and each key's fingerprint by its place."""
    u = fps.view(np.uint64)
    segments, shift = [], 0
    for n in SEGMENTS:
        segments.append(segment_keys(((u >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64)))
        shift += n
    keys, places = [], []
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        both = (segments[a][:, :, None] << 12) | segments[b][:, None, :]
        real = (segments[a][:, :, None] >= 0) & (segments[b][:, None, :] >= 0)
        at, i, j = np.nonzero(real)
        keys.append(both[at, i, j] | pair << 24)
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64))


def spanning_links(fps: np.ndarray, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Links that connect what links of at most `bits` bits connect among distinct fingerprints."""
    a: list[int] = []
    b: list[int] = []
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left.view(np.uint64) ^ x.view(np.uint64)) <= bits
            if near.any():
                found = left[near]
                a.extend([int(x)] * len(found))
                b.extend(found.tolist())
                queue.extend(found)
                left = left[~near]
    return a, b


def _cold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, fp) that are sorted by key; no key has more than MOST."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(keys)))
        out: list[tuple] = []
        for size in range(2, 9):  # small groups pair by pair, all groups of a size at once
            at = firsts[sizes == size]
            for i, j in combinations(range(size), 2):
                x, y = fps[at + i], fps[at + j]
                near = _differ(x, y) <= BITS
                out.append((x[near], y[near]))
        for f, n in zip(firsts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            out.append(spanning_links(fps[f : f + n]))
        a, b = (np.concatenate([np.asarray(x[k], np.int64) for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        if len(a):
            a, b = np.unique(np.array([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keys, fps = np.append(keys, batch.column(0).to_numpy()), np.append(fps, batch.column(1).to_numpy())
        if len(keys) >= 1 << 17:
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield links(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
    yield links(keys, fps)


@lru_cache
def _ball() -> np.ndarray:
    return np.array([0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))], np.uint64)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for k in range(0, len(fps), 1000):
            part = fps[k : k + 1000]
            keys, at = fingerprint_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(part[at], pa.int64())], ["key", "fp"])


def _points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for k in range(0, len(fps), 64):
            part = fps[k : k + 64]
            points = part.view(np.uint64)[:, None] ^ _ball()[None]
            yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64).ravel(), pa.int64()), pa.array(np.repeat(part, points.shape[1]), pa.int64())], ["point", "fp"])


def _full(keys: DataFrame, most: int, name: str) -> DataFrame:
    return stored(keys.groupBy("key").count().filter(F.col("count") > most).select("key"), name)


def _met(keys: DataFrame, full: DataFrame, n: int) -> DataFrame:
    """Links of the keys that are not full."""
    return keys.join(full, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_cold, "a long, b long")


def _parts() -> list[Column]:
    """Keys of a full key's parts: the key (26 bits), a block's number (3) and its bits (13)."""
    out, shift = [], 0
    for k, bits in enumerate(BLOCKS):
        block = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        out.append(F.shiftleft("key", 16).bitwiseOR(F.lit(k << 13)).bitwiseOR(block))
        shift += bits
    return out


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all of the column fp's distinct values that differ in at most four bits."""
    spark = distinct.sparkSession
    n = partitions(spark)
    keys = distinct.select("fp").repartition(n).mapInArrow(_keys, "key long, fp long")
    full = _full(keys, most, "full-keys")
    cold = _met(keys, full, n)
    if full.isEmpty():
        return cold
    parts = keys.join(full, "key").select(F.explode(F.array(*_parts())).alias("key"), "fp")
    full_parts = _full(parts, most, "full-parts")
    cold = cold.unionByName(_met(parts, full_parts, n))
    hot = parts.join(full_parts, "key").select("fp").distinct()
    points = hot.mapInArrow(_points, "point long, fp long")
    met = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # at most 2,081
    star = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a != b").select("a", "b")
    return cold.unionByName(star)


def near_duplicates(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id", most: int = MOST) -> DataFrame:
    """row_id, doc_id, fingerprint, component_id and root (the component's fingerprint that stands for it) of each row."""
    return _near(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle, most)


def _near(texts: DataFrame, shingle: int, most: int) -> DataFrame:
    rows = stored(fingerprints(texts, shingle), "fingerprints")
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    reached = components(links(groups, most))
    member = groups.join(reached, groups["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("row_id", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def one_of_each(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of rows (row_id, doc) that stand for each root of found (row_id, doc_id, root)."""
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_id")
    best = found.groupBy("root").agg(F.min(place).alias("place")).select(F.col("place.row_id").alias("row_id"))
    return rows.join(best, "row_id", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in rows.schema["doc"].dataType.names])


def keep_one(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the smallest id, or the first row where none has an id."""
    rows = numbered(docs, "simhash")
    named = rows.select("row_id", F.col("doc").getField(key).cast("long").alias("doc_id"), F.col("doc").getField(text).alias("text"))
    return one_of_each(rows, _near(named, shingle, MOST))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of 4-word shingles, linked at 4 differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
