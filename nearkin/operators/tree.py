"""The radix tree of a set of texts, as a table of nodes: for graphs, printing and checks.

A node is the empty path, a text of the set, or a common prefix after which two texts go on differently. Its
parent is the longest other node that is its prefix; its label is what it adds. Paths count in bytes. By length,
the texts of each length have a tree of their own, and the tables have the length (len) as their first column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import view

#: What a printed tree has behind a text of the set (fixed value).
MARK = ":1"


def nodes(texts: DataFrame, column: str = "sequence", unit: str = "byte", by_length: bool = False) -> DataFrame:
    """path, parent (null for the root), label, is_terminal and depth, in the unit's view of the texts."""
    stored = texts.select(view(F.col(column), unit).alias("w")).filter("w is not null").distinct()
    stored = stored.withColumn("len", F.char_length("w") if by_length else F.lit(0))
    prefixes = stored.select("w", "len", F.explode(F.sequence(F.lit(0), F.char_length("w"))).alias("n")).select("len", F.expr("left(w, n)").alias("path"), F.expr("substring(w, n + 1, 1)").alias("next"), (F.col("n") == F.char_length("w")).alias("ends"))
    found = prefixes.groupBy("len", "path").agg(F.countDistinct(F.when(~F.col("ends"), F.col("next"))).alias("branches"), F.max("ends").alias("is_terminal"))
    kept = found.filter("is_terminal or branches >= 2 or path = ''").select("len", "path", "is_terminal")
    if not by_length:  # a tree without texts still has its root
        root = texts.sparkSession.createDataFrame([(0, "", False)], "len int, path string, is_terminal boolean")
        kept = kept.unionByName(root).groupBy("len", "path").agg(F.max("is_terminal").alias("is_terminal"))
    shorter = kept.filter("path != ''").withColumn("n", F.explode(F.sequence(F.lit(0), F.char_length("path") - 1))).select("len", "path", "is_terminal", F.expr("left(path, n)").alias("parent"))
    above = shorter.join(kept.select("len", F.col("path").alias("parent")), ["len", "parent"]).groupBy("len", "path", "is_terminal").agg(F.max_by("parent", F.char_length("parent")).alias("parent"), F.count("*").cast("int").alias("depth"))
    rest = above.select("len", "path", "parent", F.expr("substring(path, char_length(parent) + 1)").alias("label"), "is_terminal", "depth")
    top = kept.filter("path = ''").select("len", "path", F.lit(None).cast("string").alias("parent"), F.lit("").alias("label"), "is_terminal", F.lit(0).alias("depth"))
    every = top.unionByName(rest)
    return every if by_length else every.drop("len")


def edges(texts: DataFrame, column: str = "sequence", depth: int = -1, root_label: str = "", unit: str = "byte", by_length: bool = False) -> DataFrame:
    """parent and child labels of the tree's edges, to a depth; all edges if it is negative."""
    n = nodes(texts, column, unit, by_length)
    tree = ["len"] if by_length else []
    labels = n.select(*tree, F.col("path").alias("parent_path"), F.when(F.col("path") == "", root_label).otherwise(F.col("label")).alias("parent"))
    found = n.filter("parent is not null").select(*tree, F.col("parent").alias("parent_path"), F.col("label").alias("child"), "depth")
    found = found.join(labels, [*tree, "parent_path"])
    return (found if depth < 0 else found.filter(F.col("depth") <= depth)).select(*tree, "parent", "child")


def lines(texts: DataFrame, column: str = "sequence", unit: str = "byte", by_length: bool = False) -> DataFrame:
    """path and line, a printed tree's line of each node; a tree's lines follow one another in the order of their paths."""
    n = nodes(texts, column, unit, by_length)
    line = F.concat(F.repeat(F.lit(" "), F.col("depth")), F.when(F.col("path") == "", "(root)").otherwise(F.col("label")), F.when(F.col("is_terminal"), MARK).otherwise(""))
    return n.select(*["len"] * by_length, "path", line.alias("line"))


def printed(texts: DataFrame, column: str = "sequence", unit: str = "byte") -> str:
    """The tree as text, a line for each node and an empty one: for small sets, as a text is one value."""
    rows = lines(texts, column, unit).orderBy("path").collect()
    return "\n".join([*(r["line"] for r in rows), "", ""])


def is_valid(texts: DataFrame, column: str = "sequence", unit: str = "byte", by_length: bool = False) -> bool:
    """Whether no text is null or repeated, and every inner node that is no text has two children at least."""
    counts = texts.agg(F.count("*"), F.count(column), F.countDistinct(column)).first()
    if len(set(counts)) > 1:
        return False
    n = nodes(texts, column, unit, by_length)
    tree = ["len"] if by_length else []
    children = n.groupBy(*tree, F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    bad = n.join(children, [*tree, "path"], "left").filter("path != '' and not is_terminal and coalesce(children, 0) < 2")
    return bad.isEmpty()
