"""The corpus pipeline: each stage works on all that the one before it kept.

Defined cases: null and empty texts are never toxic and equal to each other, so one row of
them passes exact deduplication; a null identifier is a document without near copies; fully
repeated rows leave one; without toxic labels nothing is toxic; columns beside those of
documents are carried up to packing, whatever their names; empty documents give an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meetloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from meetloom.llm.common import documents, labels, remove_table, stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest identifier stays."""
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out towards the target weights of their sources."""
    return mixing.mix_sources(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, a row per piece of a document."""
    return packing.pack_digest(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Neither the classifier nor the tokenizer can be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again.

    A stage's table is removed once the next one is written; the caller owns the last.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove_table(before)
        before = docs
    return docs
