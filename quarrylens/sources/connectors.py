"""How sources deliver raw documents."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import content_hash
from ..schemas import RAW_DOCUMENT


class SourceConnector(Protocol):
    """Fetches a source's documents as rows of the raw document schema."""

    def fetch(self, spark: SparkSession, source_id: str, endpoint: str) -> DataFrame: ...


def _mime(path):
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending.isin("html", "htm"), "text/html").when(ending == "pdf", "application/pdf").when(ending == "json", "application/json").otherwise("text/plain")


def _documents(rows: DataFrame, source_id: str) -> DataFrame:
    rows = rows.withColumn("content_hash", content_hash(F.col("raw_content"))).withColumn("source_id", F.lit(source_id))
    rows = rows.withColumn("id", F.sha2(F.concat_ws("\x1f", "source_id", "original_uri", "content_hash"), 256)).withColumn("acquisition_time", F.current_timestamp())
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_DOCUMENT.fields])


class FolderConnector:
    """Files of a folder, whole; folders are read in parallel by Spark."""

    def fetch(self, spark: SparkSession, source_id: str, endpoint: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(endpoint)
        return _documents(files.select(F.col("path").alias("original_uri"), F.col("modificationTime").alias("content_timestamp"), F.col("content").alias("raw_content"), _mime(F.col("path")).alias("mime_type")), source_id)


class JsonLinesConnector:
    """Posts as lines of JSON: each line is a document; ``url`` and ``time`` are taken if there."""

    def fetch(self, spark: SparkSession, source_id: str, endpoint: str) -> DataFrame:
        lines = spark.read.text(endpoint).filter(F.trim("value") != "")
        rows = lines.select(
            F.coalesce(F.get_json_object("value", "$.url"), F.concat(F.lit("line:"), F.sha2("value", 256))).alias("original_uri"),
            F.try_to_timestamp(F.get_json_object("value", "$.time")).alias("content_timestamp"),
            F.col("value").cast("binary").alias("raw_content"),
            F.lit("application/json").alias("mime_type"),
        )
        return _documents(rows, source_id)
