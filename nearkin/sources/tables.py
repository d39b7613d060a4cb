"""Sets and results as Parquet tables, partition-friendly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import LengthSet, SequenceSet


def read_set(spark: SparkSession, path: str, column: str = "sequence", by_length: bool = False) -> SequenceSet:
    """A set from a column of a Parquet table."""
    kind = LengthSet if by_length else SequenceSet
    return kind(spark, spark.read.parquet(path).select(F.col(column).alias("sequence")))


def write_set(stored: SequenceSet, path: str, mode: str = "error") -> None:
    stored.to_df().write.mode(mode).parquet(path)


def write_result(found: DataFrame, path: str, mode: str = "error") -> None:
    found.write.mode(mode).parquet(path)
