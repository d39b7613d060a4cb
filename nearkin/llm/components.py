"""Connected components of a table of links, by rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, stored


#: Parts of a parent's children in a join.
SALTS = 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) with the same components as the links given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        np.minimum.at(label, before, label)  # a root follows its tree
        label = label[label]
        if np.array_equal(before, label):
            break
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as a forest; merged now and then, so that it holds no more than its nodes and one batch."""
    held = np.zeros((2, 0), np.int64)
    for batch in batches:
        more = np.array([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        held = np.array(forest(*np.concatenate([held, more], axis=1)))
    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node that links (a, b) reach, of every node that is not its own root.

    Each task first makes a forest of its links, so a node has at most one parent from each task, and a round is
    cheap. A root with very many children is never a join's one key: edges are salted by child where they look
    up their parent's own parent.
    """
    spark = links.sparkSession
    n = partitions(spark)
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition(n, "a", "b")
    edges = stored(edges.mapInArrow(_contract, "a long, b long"), "links")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    last = None
    while True:
        # large-star: an edge to u becomes one to the least neighbour of u, if that is less than u
        above = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m", salts)
        salted = edges.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        large = stored(salted.join(above, ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "large-star")
        # small-star: a node and its lesser neighbours become children of the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a != b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
