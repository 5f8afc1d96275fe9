"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs. Stages keep the columns they are given, whatever
further ones there are; nulls count as stated at each stage, and an empty table passes
through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vouchlake.llm import exact_dedup, langid, mixing, near_dedup, packing
from vouchlake.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure; null or letterless texts go. Of rows that share
    an id, all go if one is rejected."""
    return langid.confident(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; rows that repeat id and text once."""
    return exact_dedup.keep_first_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id; texts without words
    are near copies of equal ones only. Rows that share that id all stay."""
    return near_dedup.keep_one_of_each(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents a mix of the sources takes, once for each epoch begun, a document at
    a source's cut whole; documents without words are not taken. Null sources are a
    source. Columns named __id, __times or __epoch are not
    allowed in the input."""
    return mixing.mixed_documents(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 ids; a repeated document
    is packed each time."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Compression, signatures and tokenisers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
