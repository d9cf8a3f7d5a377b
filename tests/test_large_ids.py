"""Queries on ids as large tables have them."""

import os

from pyspark.sql import functions as F

from quarrylens.plans.queries import ORACLE_SQL, QUERIES

from .oracle import same


def with_documents(small, folder, docs):
    """The tables of ``small`` with other documents."""
    for name in os.listdir(small):
        if name != "documents.parquet":
            os.symlink(f"{small}/{name}", f"{folder}/{name}")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_given_times_past_today_are_not_taken_for_those_of_a_save(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    far = docs.withColumn("doc_id", F.col("doc_id") * 12_347)
    folder = with_documents(small, tmp_path, far)
    assert same(QUERIES["i27_save_documents"](spark, folder), folder, ORACLE_SQL["i27_save_documents"]) == docs.count()


def test_chunks_of_other_characters_are_indexed(spark, small, tmp_path):
    """A chunk without Latin letters, digits and spaces is a point like any other."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    odd = F.when(F.col("doc_id") % 4 == 1, "!?").when(F.col("doc_id") % 4 == 2, F.repeat(F.lit("日本"), 500))
    folder = with_documents(small, tmp_path, docs.withColumn("text", F.coalesce(odd, "text")))
    assert same(QUERIES["d26_upserted_chunks"](spark, folder), folder, ORACLE_SQL["d26_upserted_chunks"]) == 20
