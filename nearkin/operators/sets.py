"""Sets of texts: immutable tables behind a handle that rebinds them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.costs import CostMatrix
from ..functions.units import size, view
from . import search, tree

Texts = DataFrame | Iterable[str]


def frame(spark: SparkSession, texts: Texts, column: str = "sequence") -> DataFrame:
    """pos (input order) and sequence, of a table's only or named column, or of a list."""
    if isinstance(texts, DataFrame):
        name = column if column in texts.columns else texts.columns[0]
        pos = F.col("pos") if "pos" in texts.columns else F.monotonically_increasing_id()
        return texts.select(pos.cast("long").alias("pos"), F.col(name).alias("sequence"))
    return spark.createDataFrame(list(enumerate(texts)), "pos long, sequence string")


def _first(df: DataFrame) -> Column:
    """Whether a row is the first of its text."""
    return F.row_number().over(Window.partitionBy("sequence").orderBy("pos")) == 1


def membership(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """texts with flag: whether each is in the set; an existence join."""
    marked = stored.select("sequence").distinct().withColumn("is_in", F.lit(True))
    return texts.join(marked, "sequence", "left").select("pos", "sequence", F.coalesce("is_in", F.lit(False)).alias("flag"))


def insert_flags(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """pos, sequence and flag: whether inserting the rows in order adds each; nulls are not added."""
    found = membership(texts, stored)
    return found.select("pos", "sequence", (~F.col("flag") & _first(found) & F.col("sequence").isNotNull()).alias("flag"))


def erase_flags(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """pos, sequence and flag: whether erasing the rows in order removes each."""
    found = membership(texts, stored)
    return found.select("pos", "sequence", (F.col("flag") & _first(found)).alias("flag"))


def char_counts(texts: DataFrame, column: str = "sequence", unit: str = "byte") -> DataFrame:
    """char and count of all characters."""
    chars = texts.select(F.explode(F.split(view(F.col(column), unit), "")).alias("char")).filter("char != ''")
    return chars.groupBy("char").agg(F.count("*").alias("count"))


class SequenceSet:
    """A set of texts in one tree."""

    def __init__(self, spark: SparkSession, sequences: Texts | None = None, column: str = "sequence", unit: str = "byte"):
        self.spark, self.unit = spark, unit
        self.df = spark.createDataFrame([], "sequence string")
        if sequences is not None:
            self.df = frame(spark, sequences, column).select("sequence").filter("sequence is not null").distinct()

    def insert(self, sequences: Texts) -> DataFrame:
        """Adds texts; returns pos, sequence and flag (whether each was new)."""
        new = frame(self.spark, sequences)
        flags = insert_flags(new, self.df)
        self.df = self.df.union(new.select("sequence").filter("sequence is not null")).distinct()
        return flags

    def erase(self, sequences: Texts) -> DataFrame:
        """Removes texts; returns pos, sequence and flag (whether each was there)."""
        gone = frame(self.spark, sequences)
        flags = erase_flags(gone, self.df)
        self.df = self.df.join(gone.select("sequence").distinct(), "sequence", "left_anti")
        return flags

    def find(self, sequences: Texts) -> DataFrame:
        """pos, sequence and flag: whether each is in the set."""
        return membership(frame(self.spark, sequences), self.df)

    def to_df(self) -> DataFrame:
        return self.df

    def size(self) -> int:
        return self.df.count()

    def validate(self) -> bool:
        return tree.is_valid(self.df, unit=self.unit)

    def charset(self) -> list[str]:
        return sorted(r[0] for r in self.char_counts().select("char").collect())

    def char_counts(self) -> DataFrame:
        return char_counts(self.df, unit=self.unit)

    def graph(self, depth: int = -1, root_label: str = "") -> DataFrame:
        return tree.edges(self.df, depth=depth, root_label=root_label, unit=self.unit)

    def to_string(self) -> str:
        return tree.printed(self.df, unit=self.unit)

    def prefix_search(self, queries: Texts) -> DataFrame:
        return search.prefix_search(self._asked(queries), self.df, target="sequence")

    def search(self, queries: Texts, max_distance: int | str | Column | None = None, max_fraction: float | str | Column | None = None, mode: str = "levenshtein", cost_matrix: CostMatrix | None = None, gap_cost: int | None = None, gap_open_cost: int | None = None, limit: int | None = None) -> DataFrame:
        return search.similarity_join(self._asked(queries), self.df, max_distance, max_fraction, mode, cost_matrix, gap_cost, gap_open_cost, target="sequence", unit=self.unit, limit=limit)

    def single_gap_search(self, queries: Texts, max_distance: int | str | Column, gap_cost: int = 1) -> DataFrame:
        return search.single_gap_search(self._asked(queries), self.df, max_distance, gap_cost, target="sequence", unit=self.unit)

    def _asked(self, queries: Texts) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries if "query" in queries.columns else queries.withColumnRenamed(queries.columns[0], "query")
        return self.spark.createDataFrame([(x,) for x in queries], "query string")


class LengthSet(SequenceSet):
    """A set of texts kept by length: searched by Hamming or unit global distance, a tree for each length."""

    def lengths(self) -> DataFrame:
        """len and count."""
        return self.df.groupBy(size(F.col("sequence"), self.unit).alias("len")).agg(F.count("*").alias("count"))

    def validate(self) -> bool:
        """Whether each length's tree is valid."""
        return tree.is_valid(self.df, unit=self.unit, by_length=True)

    def graph(self, depth: int = -1, root_label: str = "") -> DataFrame:
        """The edges of all trees, one for each length."""
        return tree.edges(self.df, depth=depth, root_label=root_label, unit=self.unit, by_length=True).select("parent", "child")

    def to_strings(self) -> dict[int, str]:
        """Each length's tree as text."""
        n = size(F.col("sequence"), self.unit)
        return {k: tree.printed(self.df.filter(n == k), unit=self.unit) for k in sorted(r["len"] for r in self.lengths().collect())}

    def search(self, queries: Texts, max_distance: int | str | Column | None = None, max_fraction: float | str | Column | None = None, mode: str = "levenshtein") -> DataFrame:  # type: ignore[override]
        return search.forest_search(self._asked(queries), self.df, max_distance, max_fraction, mode, target="sequence", unit=self.unit)
