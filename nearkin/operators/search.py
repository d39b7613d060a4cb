"""Searches: joins of a bag of queries with a set of targets by prefix or distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import params
from ..functions.costs import CostMatrix
from ..functions.distance import charset
from ..functions.kernels import distance
from ..functions.units import view
from ..functions.walk import band
from ..plans.candidates import MOST_EDITS, candidates
from ..plans.cells import walked

#: tree_class of dist_search: both give the same rows; a forest knows no anchored mode and no costs.
CLASSES = ("tree", "forest")


def _edits(k: Column, costs: params.Costs) -> Column:
    """The most edits of a threshold; null if there is no bound."""
    if costs.algorithm in ("hamming", "unit"):
        return k
    return F.lit(None).cast("int") if costs.edits(0) is None else F.floor(k / min([costs.gap, *costs.matrix.off_diagonal()])).cast("int")


def _found(pairs: DataFrame, mode: str, costs: params.Costs, unit: str) -> DataFrame:
    """pairs within their threshold k, with the distance (and sizes)."""
    if mode == "global" and costs.algorithm == "unit":
        q, t = view(F.col("query"), unit), view(F.col("target"), unit)
        near = pairs.withColumns({"q": q, "t": t}).withColumn("distance", F.expr("levenshtein(q, t, k)")).drop("q", "t")
        return near.filter("distance >= 0").select("query", "target", "distance")
    found = pairs.withColumn("d", distance(F.col("query"), F.col("target"), mode, costs, unit, F.col("k")))
    if mode == "anchored":
        return found.filter("d.distance <= k").select("query", "target", "d.distance", "d.query_size", "d.target_size")
    return found.filter("d <= k").select("query", "target", F.col("d").alias("distance"))


def _within(asked: DataFrame, stored: DataFrame, mode: str, costs: params.Costs, unit: str, strategy: str, most: int | None) -> DataFrame:
    """All pairs within their threshold k: by walks of trees where its band is narrow, else by candidates. most: the threshold, if it is one."""

    def by_candidates(some: DataFrame) -> DataFrame:
        return _found(candidates(some, stored, mode, unit, strategy), mode, costs, unit)

    if mode == "hamming" or strategy == "nested":
        return by_candidates(asked)
    if most is not None:
        return walked(asked, stored, mode, costs, unit) if band(most, costs) <= MOST_EDITS else by_candidates(asked)
    narrow = F.floor((F.col("k") - costs.opening) / costs.gap) <= MOST_EDITS
    return walked(asked.filter(narrow), stored, mode, costs, unit).unionByName(by_candidates(asked.filter(~narrow)))


def similarity_join(
    queries: DataFrame,
    targets: DataFrame,
    max_distance: int | str | Column | None = None,
    max_fraction: float | str | Column | None = None,
    mode: str = "levenshtein",
    cost_matrix: CostMatrix | None = None,
    gap_cost: int | None = None,
    gap_open_cost: int | None = None,
    query: str = "query",
    target: str = "target",
    unit: str = "byte",
    strategy: str = "blocked",
    limit: int | None = None,
) -> DataFrame:
    """query, target and distance of all pairs within the threshold; in anchored mode also query_size and target_size.

    Targets are a set; a query that is given twice has its rows twice. Null texts have no rows. A threshold is a
    number, or a column of the queries. strategy is 'blocked' (trees or segments) or 'nested' (all pairs). limit keeps each
    query's nearest targets, ties by the target's text.
    """
    mode = params.normalize_mode(mode)
    costs = params.costs(mode, cost_matrix, gap_cost, gap_open_cost)
    if strategy not in ("blocked", "nested"):
        raise ValueError(f"strategy must be 'blocked' or 'nested', not {strategy!r}")
    if costs.matrix:
        costs.matrix.covers(charset((queries, query), (targets, target)), unit)
    k = params.threshold(F.col(query), max_distance, max_fraction)
    bag = queries.select(F.col(query).alias("query"), k.alias("k")).filter("query is not null and k >= 0")
    counted = bag.groupBy("query", "k").agg(F.count("*").alias("times"))
    asked = counted.select("query", "k").withColumn("e", _edits(F.col("k"), costs))
    stored = targets.select(F.col(target).alias("target")).filter("target is not null").distinct()
    # a column may give a text several thresholds; numbers give each text one
    one = isinstance(max_distance, int | float) or max_distance is None and isinstance(max_fraction, int | float)
    most = int(max_distance) if isinstance(max_distance, int | float) else None
    found = _within(asked, stored, mode, costs, unit, strategy, most) if one else _per_row(asked, stored, mode, costs, unit, strategy)
    if limit is not None:
        found = nearest(found, limit)
    return _with_multiplicity(found, counted)


def _per_row(asked: DataFrame, stored: DataFrame, mode: str, costs: params.Costs, unit: str, strategy: str) -> DataFrame:
    """The same text may come with several thresholds: all pairs under the greatest, then each threshold's own."""
    most = asked.groupBy("query").agg(F.max("k").alias("k"), F.max("e").alias("e"))
    found = _within(most, stored, mode, costs, unit, strategy, None)
    return found.join(asked.select("query", F.col("k").alias("own")), "query").filter("distance <= own").withColumnRenamed("own", "k")


def _with_multiplicity(found: DataFrame, counted: DataFrame) -> DataFrame:
    keys = ["query", "k"] if "k" in found.columns else ["query"]
    times = counted if "k" in keys else counted.groupBy("query").agg(F.sum("times").alias("times"))
    out = found.join(times, keys).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.drop("k", "times", "nth")


def nearest(found: DataFrame, n: int) -> DataFrame:
    """Each query's n nearest targets."""
    keys = ["query", "k"] if "k" in found.columns else ["query"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "target")))
    return ranked.filter(F.col("rank") <= n).drop("rank")


def forest_search(queries: DataFrame, targets: DataFrame, max_distance: int | str | Column | None = None, max_fraction: float | str | Column | None = None, mode: str = "levenshtein", query: str = "query", target: str = "target", unit: str = "byte") -> DataFrame:
    """The search of a set that is kept by length: Hamming or unit global distance only.

    Each query meets the targets of the lengths that its threshold allows, by an equi-join on length and segment.
    """
    if params.normalize_mode(mode) == "anchored":
        raise ValueError("a set kept by length cannot be searched in anchored mode")
    return similarity_join(queries, targets, max_distance, max_fraction, mode, query=query, target=target, unit=unit)


def dist_search(queries: DataFrame, targets: DataFrame, max_distance: int | str | Column | None = None, max_fraction: float | str | Column | None = None, mode: str = "levenshtein", cost_matrix: CostMatrix | None = None, gap_cost: int | None = None, gap_open_cost: int | None = None, tree_class: str = "tree", query: str = "query", target: str = "target", unit: str = "byte") -> DataFrame:
    """Both tables' search in one call; tree_class is 'tree' or 'forest'."""
    if tree_class not in CLASSES:
        raise ValueError(f"tree_class must be one of {CLASSES}, not {tree_class!r}")
    if tree_class == "forest":
        if cost_matrix is not None or gap_cost is not None or gap_open_cost is not None:
            raise ValueError("a set kept by length knows no costs")
        return forest_search(queries, targets, max_distance, max_fraction, mode, query, target, unit)
    return similarity_join(queries, targets, max_distance, max_fraction, mode, cost_matrix, gap_cost, gap_open_cost, query, target, unit)


def single_gap_search(queries: DataFrame, targets: DataFrame, max_distance: int | str | Column, gap_cost: int = 1, query: str = "query", target: str = "target", unit: str = "byte", strategy: str = "blocked") -> DataFrame:
    """query, target, distance of pairs by mismatches with at most one gap of one character; the longer text's end is free."""
    if max_distance is None:
        raise ValueError("max_distance is needed")
    k = params.threshold(F.col(query), max_distance, None)
    costs = params.Costs("unit", None, gap_cost)
    counted = queries.select(F.col(query).alias("query"), k.alias("k")).filter("query is not null and k >= 0").groupBy("query", "k").agg(F.count("*").alias("times"))
    # an alignment with a gap is an anchored one of at most k mismatches and one more edit
    edits = F.when(F.lit(gap_cost >= 1), F.col("k")).otherwise(F.col("k") + 1)
    asked = counted.select("query", "k").withColumn("e", edits.cast("int"))
    stored = targets.select(F.col(target).alias("target")).filter("target is not null").distinct()
    pairs = candidates(asked, stored, "anchored", unit, strategy)
    found = pairs.withColumn("distance", distance(F.col("query"), F.col("target"), "single_gap", costs, unit)).filter("distance <= k")
    return _with_multiplicity(found, counted).select("query", "target", "distance")


def prefix_search(queries: DataFrame, targets: DataFrame, query: str = "query", target: str = "target") -> DataFrame:
    """query and target of all pairs whose target starts with the query: an equi-join on the prefixes of the queries' lengths."""
    counted = queries.select(F.col(query).alias("query")).filter("query is not null").groupBy("query").agg(F.count("*").alias("times"))
    stored = targets.select(F.col(target).alias("target")).filter("target is not null").distinct()
    lengths = sorted(r[0] for r in counted.select(F.char_length("query").alias("n")).distinct().collect())  # a few small numbers
    if not lengths:
        return counted.join(stored, F.lit(False)).select("query", "target")
    prefixes = F.array(*[F.when(F.char_length("target") >= n, F.substring("target", 1, n)) for n in lengths])
    keyed = stored.withColumn("query", F.explode(F.array_compact(prefixes)))
    return keyed.join(counted, "query").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query", "target")
