"""Distances without a threshold: of the pairs of a table, and of all pairs of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import params
from .costs import CostMatrix
from .kernels import distance


def charset(*columns: tuple[DataFrame, str]) -> list[str]:
    """Distinct characters of columns: a few, for the check of a cost matrix."""
    found: set[str] = set()
    for df, c in columns:
        chars = df.select(F.explode(F.split(F.col(c), "")).alias("c")).filter("c != ''").distinct()
        found |= {r[0] for r in chars.collect()}
    return sorted(found)


def _spread(df: DataFrame, found: Column, mode: str) -> DataFrame:
    if mode != "anchored":
        return df.withColumn("distance", found)
    return df.withColumn("found", found).withColumns({c: F.col("found")[c] for c in ("distance", "query_size", "target_size")}).drop("found")


def dist_pairwise(pairs: DataFrame, mode: str, query: str = "query", target: str = "target", cost_matrix: CostMatrix | None = None, gap_cost: int | None = None, gap_open_cost: int | None = None, unit: str = "byte") -> DataFrame:
    """pairs with a column distance, and for anchored mode query_size and target_size; null texts have null distances."""
    mode = params.normalize_mode(mode)
    costs = params.costs(mode, cost_matrix, gap_cost, gap_open_cost, zero_diagonal=False)
    if costs.matrix:
        costs.matrix.covers(charset((pairs, query), (pairs, target)), unit)
    return _spread(pairs, distance(F.col(query), F.col(target), mode, costs, unit), mode)


def dist_matrix(queries: DataFrame, targets: DataFrame, mode: str, query: str = "query", target: str = "target", query_id: str | None = None, target_id: str | None = None, cost_matrix: CostMatrix | None = None, gap_cost: int | None = None, gap_open_cost: int | None = None, unit: str = "byte") -> DataFrame:
    """Distances of all pairs, in long form: query_id, target_id, query, target, distance (and sizes).

    Neither side is made distinct. Without id columns, ids are unique numbers in the order of the partitions.
    The operator is a cross product by definition; a cost matrix has n x m rows whatever computes it.
    """
    mode = params.normalize_mode(mode)
    costs = params.costs(mode, cost_matrix, gap_cost, gap_open_cost, zero_diagonal=False)
    if costs.matrix:
        costs.matrix.covers(charset((queries, query), (targets, target)), unit)
    ids = [F.col(x) if x else F.monotonically_increasing_id() for x in (query_id, target_id)]
    q = queries.select(ids[0].alias("query_id"), F.col(query).alias("query"))
    t = targets.select(ids[1].alias("target_id"), F.col(target).alias("target"))
    pairs = q.crossJoin(t).select("query_id", "target_id", "query", "target")
    return _spread(pairs, distance(F.col("query"), F.col("target"), mode, costs, unit), mode)


def wide(matrix: DataFrame, targets: list[int] | None = None, value: str = "distance") -> DataFrame:
    """A row for each query and a column for each target id, for small matrices; the target ids, if given, spare a pass."""
    rows = matrix.groupBy("query_id", "query")
    return (rows.pivot("target_id", targets) if targets else rows.pivot("target_id")).agg(F.first(value))
