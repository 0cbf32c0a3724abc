"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, extra ones included, whatever their names.

Every stage reads all rows and whole texts of any length. Null texts count as empty, rows that repeat are rows of their
own unless said otherwise, ties are broken by id and then by a hash of the text, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnback.llm import line_quality, mixing, packing, simhash, substring_dedup, work
from turnback.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go.

    Null, empty and blank texts go or stay together, by the training documents without a line; a null id is scored as any
    other; without labels of both kinds all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality.keep(docs, line_quality.fit(docs, labels, keep=line_quality.training_rows()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: that of the least id, then of the least text hash.

    Null and empty texts are one component with what is near the zero fingerprint; rows that repeat id and text are one; a
    null id stays only where its component has no other.
    """
    return simhash.survivors(docs, 6)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has are cut from the texts; no row goes.

    Null texts stay null, short ones whole. Rows with a null id neither lose words nor cost others any; rows of one id
    don't count as earlier than each other.
    """
    return substring_dedup.cut(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights.

    A null source is a source of its own; a source without a word is left out; rows that agree in every column share
    their copies.
    """
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Related documents share sequences of 1024 tokens; one row per piece, with null ids as they are.

    A null or empty text is its end token alone; rows that repeat are packed each, next to each other.
    """
    return packing.pack(docs)


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return functools.wraps(stage)(lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir))


STAGES = [
    ("quality classifier", _shipped(quality)),
    ("SimHash near-dedup", _shipped(near_dedup)),
    ("substring dedup", _shipped(substrings)),
    ("mixing sources to target weights", _shipped(mix)),
    ("packing", _shipped(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the fingerprints and the tokenizer are beyond SQL. tests/llm/test_pipeline.py compares the decisions of
#: each stage with plain Python on its own input (the classifier's scores: with features and marginals in plain Python).
ORACLE_SQL = None
