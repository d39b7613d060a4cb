"""A corpus from raw documents to packed sequences.

Each stage gets all that the one before it kept, as a stored table: documents scored toxic go; of each
component of near-duplicates one document stays; word windows that an earlier document has are cut out;
documents with passages of two benchmark items or more go, and other benchmark passages are cut out; what is
left is packed into sequences of at most 2048 tokens.

In every stage: nulls may stand in any column, and null texts are taken as empty but stay null; rows without an id
are rejected, merged, cut and packed like others, but give no id to a group and are no source; repeated rows are near
copies of one another, and one of them stays; an empty table gives an empty one; columns of any names pass through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.decontamination import decontaminate
from nearkin.llm.packing import pack_documents
from nearkin.llm.shared import stored
from nearkin.llm.similar import keep_one_similar
from nearkin.llm.substrings import remove_substrings
from nearkin.llm.toxicity import reject_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out quarter, does not reject."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles agree to 0.8 or more."""
    return keep_one_similar(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 13 words that an earlier one has."""
    return _counted(remove_substrings(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return _counted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its sequence."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
