"""Distances as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .kernels import kernel
from .params import Costs


def register(spark: SparkSession, unit: str = "byte") -> None:
    """Registers hamming_distance, anchored_distance (a struct with sizes) and single_gap_distance, of unit costs.

    Whole unit distance is the built-in levenshtein, which counts characters.
    """
    for kind in ("hamming", "anchored", "single_gap"):
        spark.udf.register(f"{kind}_distance", kernel(kind, Costs("unit"), unit))
