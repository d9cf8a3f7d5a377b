"""One thin query for each operator, over the whole of its table.

Queries with intermediate tables write their result and remove the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, extraction, lines, minhash, mixing, negatives, packing, quality, search, secrets, sharding, sql, substrings, vectors
from ._spark import finished


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return finished(spark, "op1", lambda: mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(_table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return finished(spark, "op4", lambda: minhash.near_duplicates(docs, shingle=3, percent=85))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r[0].cast("string"), r[1].cast("string"))), ",")
    return finished(spark, "op6", lambda: lines.repeated_lines(docs).select("doc_id", "n_lines", "n_removed", runs.alias("removed_runs"), F.sha2("kept_text", 256).alias("kept_sha256")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return finished(spark, "op7", lambda: substrings.repeated_passages(docs, window=35, with_text=False))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return finished(spark, "op8", lambda: vectors.near_duplicate_vectors(rows, cosine=0.9))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return finished(spark, "op9", lambda: packing.packed(docs))


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return finished(spark, "op10", lambda: search.top_k(docs, F.col("doc_id") % 100 == 0))


def op11_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return finished(spark, "op11", lambda: sharding.shard_plan(docs, shards=8).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return finished(spark, "op12", lambda: negatives.hard_negatives(rows, label, F.col("vec_id") % 100 == 0))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return finished(spark, "op13", lambda: conversations.repair_report(conversations.damaged(turns), turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_quality_classifier, op3_html_extraction, op4_minhash_near_dedup, op5_secret_scan, op6_line_dedup, op7_substring_dedup, op8_embedding_near_dedup, op9_best_fit_packing, op10_top_k_search, op11_shard_documents, op12_hard_negatives, op13_conversation_repair)
}

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": sql.MIX_SOURCES, "op6_line_dedup": sql.LINE_DEDUP, "op10_top_k_search": sql.TOP_K_SEARCH, "op11_shard_documents": sql.SHARD_DOCUMENTS, "op12_hard_negatives": sql.HARD_NEGATIVES, "op13_conversation_repair": sql.CONVERSATION_REPAIR}
