"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Each stage works on all rows of its predecessor. Null and empty texts, null doc_ids, repeated rows, empty tables and
other columns are handled as the stage's operator says in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import line_dedup, mixing, packing, quality, scratch, simhash_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the first policy rejects go."""
    return quality.accepted(docs, policy=1)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document of which nothing is left goes."""
    return line_dedup.clean(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup.dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight has them, block after block, permuted in each."""
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence of each piece of each document."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]

#: near-duplicate groups and greedy packing can't be expressed in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        with scratch.scope(spark):  # what the stage wrote on its way goes
            docs = scratch.table(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
