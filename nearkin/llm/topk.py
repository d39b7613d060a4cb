"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt by length, longest first, into blocks of bounded size, in the narrowest integers that hold them
(by places in the whole order, so that their number does not follow the number of tasks).
Queries are dealt into blocks too. The block of the longest vectors is searched first and gives each query a lower
bound of its k-th score. A block of queries and a block of vectors meet only if the longest vector can reach the bound
of one of the queries, which is found from the blocks' lengths alone, before any vectors are shuffled; a block of
vectors then goes to one task, or to a few where there are fewer blocks than tasks. The bound over a block's largest
length is the local cosine threshold: above 1 the block is skipped for that query; where it is high, candidates are those
whose largest query coordinates lie in the range that the threshold leaves (coordinate pruning); where it is
low, those that are long enough (length pruning). Remaining products are computed exactly in integers, and a
query's best rows of all blocks are merged, ties to the smaller id.

Each component x becomes floor(scale * x). Vectors that are null or hold null or non-finite components take
no part; a vector with fewer components counts as zero in the others; rows that share an id take part each by
itself and are no candidates of one another; rows without an id take no part. Products are exact within
64-bit integers. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, stored

#: Vectors of a block, queries of a block, and coordinates used for pruning.
BLOCK, QUERY_BLOCK, FOCUS = 4096, 512, 3
#: Local cosine thresholds from here on make coordinate pruning worth its cost.
STEEP = 0.6

BLOCKS = "block long, n long, dim int, longest double, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def integral(vectors: DataFrame, scale: int, key: str, column: str) -> DataFrame:
    """id, v (integers) and norm2 of the vectors that take part."""
    x = F.col(column)
    ok = x.isNotNull() & F.col(key).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.filter(ok).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).cast("array<long>").alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Stored blocks of less than twice `size` vectors of similar length, numbered from 0, longest first.

    Each task makes blocks of its range of lengths; those that start in the same `size` places of the whole order
    are then put together, so their number follows that of the vectors and not that of the tasks.
    """
    spark = rows.sparkSession
    n = partitions(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, np.ndarray, float]] = []

        def block() -> pa.RecordBatch:
            nonlocal made
            dim = max(len(v) for _, v, _ in held)
            m = np.zeros((len(held), dim), np.int64)
            for row, (_, v, _) in zip(m, held, strict=True):
                row[: len(v)] = v
            out = _block(base + made, dim, float(np.sqrt(max(x for _, _, x in held))), np.array([k for k, _, _ in held], np.int64).tobytes(), m)
            made += 1
            held.clear()
            return out

        for batch in batches:
            lists, norms = batch.column(1), batch.column(2).to_numpy()
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (key, norm) in enumerate(zip(batch.column(0).to_pylist(), norms.tolist(), strict=True)):
                held.append((key, flat[offsets[k] : offsets[k + 1]], norm))
                if len(held) == size:
                    yield block()
        if held:
            yield block()

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["block"])
                dim = max(p["dim"] for p in parts)
                m = np.concatenate([np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in (_matrix(p["ids"], p["vectors"], p["dim"])[1] for p in parts)])
                yield _block(r["place"], dim, max(p["longest"] for p in parts), b"".join(p["ids"] for p in parts), m)

    placed = rows.repartitionByRange(n, F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id")
    made = stored(placed.mapInArrow(run, BLOCKS), name + "-parts")
    task = F.shiftright("block", 32)
    sizes = made.groupBy(task.alias("task")).agg(F.sum("n").alias("rows"))  # at most n rows
    starts = sizes.select("task", (F.sum("rows").over(Window.orderBy("task")) - F.col("rows")).alias("before"))
    place = F.floor((F.col("before") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) * size) / size)
    parts = made.join(F.broadcast(starts), task == F.col("task")).select(place.alias("place"), F.struct("block", "dim", "longest", "ids", "vectors").alias("part"))
    return stored(parts.groupBy("place").agg(F.collect_list("part").alias("parts")).mapInArrow(merged, BLOCKS), name)


def _block(number: int, dim: int, longest: float, ids: bytes, m: np.ndarray) -> pa.RecordBatch:
    """A block as a row of BLOCKS."""
    row = [[number], [len(m)], [dim], [longest], [ids], [_narrow(m).tobytes()]]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["block", "n", "dim", "longest", "ids", "vectors"])


def _narrow(m: np.ndarray) -> np.ndarray:
    """m in the narrowest integers that hold all of it."""
    least, most = (int(m.min()), int(m.max())) if m.size else (0, 0)
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and vectors; its integers are as wide as its bytes tell."""
    n = len(ids) // 8
    if not n * dim:
        return np.frombuffer(ids, np.int64), np.zeros((n, dim), np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, f"<i{len(vectors) // (n * dim)}").reshape(n, dim).astype(np.int64)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where all partial sums are exact in it."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _focus(q: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors can have this cosine with q at least, by its largest coordinates."""
    length = np.linalg.norm(q)
    spread = np.arccos(min(1.0, cosine)) + 1e-9
    keep = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        angle = np.arccos(np.clip(q[f] / length, -1, 1))
        keep &= (unit[:, f] >= np.cos(min(np.pi, angle + spread)) - 1e-9) & (unit[:, f] <= np.cos(max(0.0, angle - spread)) + 1e-9)
    return keep


def _search(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = _matrix(r["q_ids"], r["q_vectors"], r["q_dim"])
                v_ids, v = _matrix(r["ids"], r["vectors"], r["dim"])
                dim = max(q.shape[1], v.shape[1])
                q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, v))
                bounds = np.frombuffer(r["bounds"], np.int64) if r["bounds"] else None
                lengths, q_lengths = np.linalg.norm(v.astype(float), axis=1), np.linalg.norm(q.astype(float), axis=1)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for a in range(0, len(q), 64):  # products of 64 queries at a time
                    rows = np.arange(a, min(a + 64, len(q)))
                    cosine = np.full(len(rows), -np.inf)
                    if bounds is not None:
                        most = q_lengths[rows] * r["longest"]
                        known = bounds[rows] > np.iinfo(np.int64).min
                        cosine = np.where(known, bounds[rows] / np.maximum(most, 1e-300), -np.inf)
                        cosine = np.where(known & (most == 0), np.where(bounds[rows] > 0, np.inf, -np.inf), cosine)
                    steep = (cosine >= STEEP) & (cosine <= 1 + 1e-9)
                    flat = np.flatnonzero(cosine < STEEP)
                    if len(flat):
                        # vectors are sorted by length, so those long enough for the least demanding query come first
                        least = min((bounds[rows[f]] / max(q_lengths[rows[f]], 1e-300) if np.isfinite(cosine[f]) else -np.inf for f in flat), default=-np.inf)
                        n = int(np.searchsorted(-lengths, -least * (1 - 1e-12) + 1e-9, "right")) if least > 0 else len(v)
                        scores = _products(q[rows[flat]], v[:n])
                        for s, f in zip(scores, flat, strict=True):
                            _keep(out, q_ids[rows[f]], v_ids[:n], s, k, None if bounds is None else bounds[rows[f]])
                    if steep.any():
                        unit = v / np.maximum(lengths, 1e-300)[:, None]
                        for f in np.flatnonzero(steep):
                            some = np.flatnonzero(_focus(q[rows[f]].astype(float), unit, cosine[f]))
                            _keep(out, q_ids[rows[f]], v_ids[some], _products(q[rows[f]][None], v[some])[0], k, bounds[rows[f]])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out]), pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def _needed(bounds: np.ndarray, lengths: np.ndarray) -> float:
    """The least length of a vector that can reach the bound of one of the queries of these lengths."""
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(bounds > 0, bounds / lengths, -np.inf)  # a bound up to zero is in reach of short vectors too
    return float(need.min(initial=np.inf)) * (1 - 1e-9)


def _keep(out: list, query: int, ids: np.ndarray, scores: np.ndarray, k: int, bound: int | None) -> None:
    some = ids != query
    if bound is not None:
        some &= scores >= bound
    ids, scores = ids[some], scores[some]
    best = _best(ids, scores, k)
    out.append((np.full(len(best), query), ids[best], scores[best]))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, the k rows with the largest inner products: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = integral(vectors, scale, key, column)
    blocks = _blocks(rows, BLOCK, "vector-blocks")
    asked = _blocks(rows.filter(F.col("id") % every == 0), QUERY_BLOCK, "query-blocks")
    queries = asked.select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    first = blocks.agg(F.min("block")).first()[0]  # the longest vectors
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n = partitions(spark)
    search = _search(k)

    # first pass: every block of queries with the first block of vectors, which is one row
    longest = blocks.filter(F.col("block") == first)
    pairs = queries.repartition(n).withColumn("block", F.lit(first)).join(F.broadcast(longest), "block").withColumn("bounds", F.lit(None).cast("binary"))
    head = stored(pairs.mapInArrow(search, FOUND), "top-first")

    # second pass: the other blocks, below the bounds that the first pass has left
    kth = head.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                known = {x["query_id"]: x["bound"] for x in r["known"] or () if x["bound"] is not None}
                lengths = np.linalg.norm(_matrix(r["q_ids"], r["q_vectors"], r["q_dim"])[1].astype(float), axis=1)
                bounds = np.array([known.get(int(x), np.iinfo(np.int64).min) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]], pa.int64()), pa.array([bounds.tobytes()], pa.binary()), pa.array([_needed(bounds, lengths)], pa.float64())], ["q_block", "bounds", "need"])

    def ids_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.unique(np.frombuffer(r["q_ids"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["q_block"]), pa.int64()), pa.array(ids, pa.int64())], ["q_block", "query_id"])

    member = queries.select("q_block", "q_ids").mapInArrow(ids_of, "q_block long, query_id long")
    known = member.join(kth, "query_id").groupBy("q_block").agg(F.collect_list(F.struct("query_id", "bound")).alias("known"))  # of a block's queries
    ready = stored(queries.join(known, "q_block", "left").mapInArrow(bounded, "q_block long, bounds binary, need double"), "query-bounds")
    rest = blocks.filter(F.col("block") != first)
    # a table of ranges of blocks, which has at most n rows, leads to those that are long enough
    lengths, n_rest = rest.select("block", "longest"), max(1, rest.count())
    wide = -(-n_rest // n)
    ranges = lengths.groupBy(F.floor(F.col("block") / wide).alias("range")).agg(F.max("longest").alias("most"), F.min("block").alias("low"), F.max("block").alias("high"))
    able = ready.select("q_block", "need").join(F.broadcast(ranges), F.col("most") >= F.col("need"))
    able = able.select("q_block", "need", F.explode(F.sequence("low", "high")).alias("block"))
    parts = F.lit(-(-n // n_rest))  # copies of a block where there are fewer blocks than tasks
    pairs = able.join(lengths, "block").filter("longest >= need").select("q_block", "block", F.pmod(F.xxhash64("q_block"), parts).cast("int").alias("part"))
    asking = pairs.join(queries, "q_block").join(ready.select("q_block", "bounds"), "q_block").repartition(n, "block", "part")
    asked_of = rest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).repartition(n, "block", "part")
    tail = asking.join(asked_of.hint("merge"), ["block", "part"]).mapInArrow(search, FOUND)
    ranked = head.unionByName(tail).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 20 largest integer inner products of each twentieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
