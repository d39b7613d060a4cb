"""All pairs within narrow thresholds, by walks of the targets' radix trees (functions.walk).

Targets are dealt by hash into slices and queries into blocks, so that no frequent beginning makes a task larger than
others; a cell is a slice and a block, and each task walks its cells one after the other and holds one at a time.
Slices and blocks are bounded by texts and by bytes, and no pair is made that is not a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import ANCHORED
from ..functions.params import Costs
from ..functions.walk import within

#: Texts and bytes of a slice or a block, at most (but for one text); texts of a block that is cut smaller, and blocks wanted.
TEXTS, BYTES, SMALL, BLOCKS = 1 << 14, 1 << 22, 1 << 10, 32


def _parts(df: DataFrame, text: str, small: bool) -> Column:
    """How many parts a table's texts are dealt into: a scalar subquery."""
    n = F.count("*")
    parts = F.ceil(n / TEXTS)
    if small:
        parts = F.least(F.ceil(n / SMALL), F.greatest(F.lit(BLOCKS).cast("long"), parts))
    return df.agg(F.greatest(parts, F.ceil(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / BYTES), F.lit(1).cast("long"))).scalar()


def walked(queries: DataFrame, targets: DataFrame, mode: str, costs: Costs, unit: str) -> DataFrame:
    """query, target and distance (and sizes) of distinct queries (query, k) and distinct targets within k, each pair once."""
    slices, blocks = _parts(targets, "target", False), _parts(queries, "query", True)
    own = lambda c, n: F.pmod(F.xxhash64(c), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    q = queries.select(F.col("query").alias("text"), F.col("k").cast("int").alias("k"), own("query", blocks).alias("block"), each(slices).alias("slice"))
    t = targets.select(F.col("target").alias("text"), F.lit(None).cast("int").alias("k"), own("target", slices).alias("slice"), each(blocks).alias("block"))
    cells = q.unionByName(t).select((F.col("slice") * blocks + F.col("block")).alias("cell"), "text", "k")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "k")
    return dealt.mapInArrow(_walks(mode, costs, unit), "query string, target string, " + (ANCHORED if mode == "anchored" else "distance int"))


def _walks(mode: str, costs: Costs, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["query", "target", "distance", "query_size", "target_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            text, k = cell["text"].combine_chunks(), cell["k"].combine_chunks()
            t, q = (text.filter(x).cast("string") for x in (k.is_null(), k.is_valid()))
            for i, j, *values in within(q.to_pylist(), k.drop_null().to_numpy(), t.to_pylist(), mode, costs, unit):
                columns = [q.take(pa.array(i)), t.take(pa.array(j)), *(pa.array(v, pa.int32()) for v in values)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of rows sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch["cell"].to_numpy()
        begins = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()]
        for i, j in zip(begins, [*begins[1:], len(cell)], strict=True):
            if i < j and held and held[-1]["cell"][0] != batch["cell"][i]:
                yield pa.Table.from_batches(held)
                held = []
            if i < j:
                held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)
