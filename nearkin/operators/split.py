"""Search of sequences that were read in different windows: two anchored searches, out from a split point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import CostMatrix
from .search import similarity_join


def _sides(df: DataFrame, text: str, split: int | str | Column, edge_trim: int, key: str) -> DataFrame:
    """key, text, left (reversed) and right; a negative split puts all on the left."""
    n = F.char_length(F.col(text))
    at = F.lit(split) if isinstance(split, int) else F.col(split) if isinstance(split, str) else split
    at = F.when(at < 0, n - edge_trim).otherwise(at).cast("int")
    left = F.reverse(F.expr(f"substring(text, {edge_trim + 1}, greatest(at - {edge_trim}, 0))"))
    right = F.expr(f"substring(text, at + 1, greatest(char_length(text) - {edge_trim} - at, 0))")
    rows = df.select(F.monotonically_increasing_id().alias(key), F.col(text).alias("text"), at.alias("at")).filter("text is not null")
    return rows.select(key, "text", left.alias("left"), right.alias("right"))


def split_search(queries: DataFrame, targets: DataFrame, query_split: int | str | Column, target_split: int | str | Column, edge_trim: int = 0, max_distance: int = 0, query: str = "query", target: str = "target", cost_matrix: CostMatrix | None = None, gap_cost: int | None = None, gap_open_cost: int | None = None, unit: str = "byte") -> DataFrame:
    """query, target and the sum of both sides' anchored distances, at most max_distance; a row for each pair of input rows.

    Sides are paired by their rows, not by their texts, so texts given with several splits do not mix.
    """
    q = _sides(queries, query, query_split, edge_trim, "query_id")
    t = _sides(targets, target, target_split, edge_trim, "target_id")
    found = {}
    for side in ("left", "right"):
        near = similarity_join(q.select(F.col(side).alias("query")).distinct(), t.select(F.col(side).alias("target")).distinct(), max_distance, None, "anchored", cost_matrix, gap_cost, gap_open_cost, unit=unit)
        found[side] = near.select(F.col("query").alias(f"q_{side}"), F.col("target").alias(f"t_{side}"), F.col("distance").alias(f"d_{side}"))
    q, t = (x.withColumnsRenamed({"text": name, "left": f"{name[0]}_left", "right": f"{name[0]}_right"}) for x, name in ((q, "query"), (t, "target")))
    # first the right sides, which are the longer ones where texts are cut near their start and so leave fewer pairs
    pairs = found["right"].join(q, "q_right").join(t, "t_right").join(found["left"], ["q_left", "t_left"])
    total = pairs.withColumn("distance", F.col("d_left") + F.col("d_right"))
    return total.filter(F.col("distance") <= max_distance).select("query", "target", "distance")
