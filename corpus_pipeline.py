"""A training corpus in five stages: reject poor documents, delete repeated lines, keep one of
each group of near-duplicates, mix sources to their weights, pack into sequences.

Every stage takes what its predecessor kept, written as Parquet and read again, and all but the
last return the columns of ``documents``; intermediate tables of a stage go when it is written.

Defined results
    null or empty text     scored by the measures of no words, and so rejected or kept; has no lines
                           and no copies; the mix takes nothing of size 0
    very long text         scored and hashed in pieces, split by line, tokenized by one task
    repeated rows, ties    exact copies lose all their lines in the second stage if they have three
                           lines or fifty words; others go in the third, but rows of one doc_id
                           with different texts, which all stay; the mix takes a document twice
                           at most
    null doc_id            never trained on; kept by the third stage, but for equal texts
    null source            a source of its own
    empty tables           no rows; without usable labels every document is kept
    other columns          kept by all stages but the last.  Names that begin with two underscores
                           are reserved
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import lines, minhash, mixing, packing, quality
from quarrylens.llm._spark import finished


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, scores 0.3 or more."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand in an earlier document (or further up)."""
    return lines.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more over shingles of five words."""
    return minhash.one_of_each(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources at their targets."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", reject_poor),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be put into SQL; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = finished(spark, f"stage-{name}", partial(stage, spark, docs, sf_dir))
    return docs
