"""The corpus pipeline: quality rules, near-duplicate removal, repeated passages, secrets, packing.

Every stage takes all rows that the one before kept, whatever their ids and other columns: null texts count as empty, repeated
rows and rows without an id each count for themselves where the stage says nothing else, texts of any length are taken whole,
and an empty table gives none.  All stages but the last return the columns of their input, also ones with clashing names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrane.llm import packing, passages, quality, secrets, simhash
from terrane.llm.common import remove, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; null and empty texts have no words, so they go.  Equal texts fare alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; of several rows with that id, all.

    Ties can't be, ids being compared.  A group without ids keeps one of its rows.
    """
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one, with a smaller id, holds too; null ids come last.

    Rows of one id are no earlier than each other.  Null texts stay null.
    """
    return passages.cut_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind.  Null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids; a null or empty text is one end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("secrets", secret_scan), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each one's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            break
        docs = written(made, "pipeline")
        remove(made)  # the stage before's table, and what the stage itself wrote
    return made
