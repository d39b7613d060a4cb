"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of an id's text has this remainder; false without an id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text and label of at most `most` labelled documents outside the held-out rows, least hashed ids first.

    Rows of one id come in the order of their texts; equal rows are equal examples, and each counts. Documents without an id and rows without a label are left out; an id labelled several times has its greatest label.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key, modulus, remainder))
    known = known.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so that it can be broadcast
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(rows.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most), "labelled")
