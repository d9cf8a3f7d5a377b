"""The three collections derived from the driver's tables, and the same in SQL.

The binding is this repository's own: sources from the distinct ``documents.source``; raw
documents from documents and pages; articles from documents with labels and embeddings.  All
derived values are functions of the rows, so that Spark and DuckDB agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import content_hash
from ..functions.text import host_of
from ..schemas import ENUMS

BASE = "2024-01-01 00:00:00"
EVENT_TYPES = ("MEETING", "STRIKE", "ELECTION", "PROTEST", "AGREEMENT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def _minutes(n: Column) -> Column:
    return F.to_timestamp(F.lit(BASE)) + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.substring("source", 4, 20).try_cast("int")  # join filters may reach other names
    return names.select(
        F.col("source").alias("id"),
        F.col("source").alias("name"),
        _pick(ENUMS["SourceType"], n).alias("type"),
        F.concat(F.lit("https://example.org/"), "source").alias("endpoint"),
        F.when(n % 7 == 0, "DISABLED").when(n % 7 == 1, "ERROR").otherwise("ENABLED").alias("status"),
        (n % 5).alias("priority"),
        (15 * (1 + n % 4)).alias("polling_minutes"),
        F.make_dt_interval(F.lit(0), F.lit(0), 15 * (1 + n % 4)).alias("polling_interval"),
        _minutes(n * 7).alias("last_execution"),
        F.struct(F.lit("API_KEY").alias("type"), F.col("source").alias("username"), F.lit(None).cast("string").alias("password"), F.concat(F.lit("key-"), "source").alias("api_key")).alias("authentication"),
        F.array(F.concat(F.lit("tier"), (n % 3).cast("string")), F.concat(F.lit("group"), (n % 4).cast("string"))).alias("tags"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    texts = docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("original_uri"),
        _minutes(F.col("doc_id") + F.col("doc_id") % 60).alias("acquisition_time"),
        _minutes(F.col("doc_id")).alias("content_timestamp"),
        F.lit("text/plain").alias("mime_type"),
        F.col("text").alias("raw_content"),
    )
    web = pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        host_of(F.col("url")).alias("source_id"),
        F.col("url").alias("original_uri"),
        _minutes(2 * F.col("page_id") + F.col("page_id") % 60).alias("acquisition_time"),
        _minutes(2 * F.col("page_id")).alias("content_timestamp"),
        F.lit("text/html").alias("mime_type"),
        F.col("html").alias("raw_content"),
    )
    return texts.unionByName(web).withColumn("content_hash", content_hash(F.col("raw_content")))


def articles(spark: SparkSession, sf_dir: str, assessed: bool = True) -> DataFrame:
    """Articles; if not ``assessed``, without labels and vectors, and the joins that bring them."""
    docs, labels, vectors = (table(spark, sf_dir, n) for n in ("documents", "labels", "embeddings"))
    n, key = F.col("doc_id"), F.col("doc_id").cast("string")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), 0)))
    entity = lambda x: F.struct(
        F.concat(key, F.lit(":"), x).alias("id"), _pick(ENUMS["EntityType"], F.length(x)).alias("type"), x.alias("name"), F.lower(x).alias("normalized_name"), (F.lit(0.5) + (F.length(x) % 5) / 10).alias("confidence")
    )
    pair = lambda x, i: F.struct(x["id"].alias("source"), F.get("entities", i + 1)["id"].alias("target"), F.lit("NEAR").alias("predicate"), (F.lit(0.25) * (1 + i % 3)).alias("confidence"))
    event = lambda k: F.struct(
        F.concat(key, F.lit("-e"), k.cast("string")).alias("id"),
        _pick(EVENT_TYPES, n + k).alias("type"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((n * 3 + k) % 365).cast("int")).alias("date"),
        F.transform(F.slice("entities", k.cast("int") + 1, 2), lambda e: e["id"]).alias("participants"),
        F.transform(F.slice("entities", k.cast("int") + 3, 1), lambda e: e["id"]).alias("locations"),
    )
    proof = lambda k, j: F.struct(
        F.concat(key, F.lit("-c"), k.cast("string"), F.lit("-v"), j.cast("string")).alias("id"), _pick(ENUMS["EvidenceType"], n + k + j).alias("type"), (F.lit(0.2) * (1 + (n + j) % 4)).alias("confidence")
    )
    claim = lambda k: F.struct(
        F.concat(key, F.lit("-c"), k.cast("string")).alias("id"),
        F.get("entities", k.cast("int"))["id"].alias("source_entity_id"),
        _pick(ENUMS["ClaimType"], n + k).alias("type"),
        _pick(ENUMS["Confidence"], n + 2 * k).alias("confidence"),
        F.transform(F.sequence(F.lit(0), ((n + k) % 2).cast("int")), lambda j: proof(k, j)).alias("evidence"),
    )
    upto = lambda m: F.filter(F.sequence(F.lit(0), (n % m).cast("int")), lambda k: k < (n % m).cast("int"))
    base = docs.join(labels, "doc_id", "left").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left") if assessed else docs
    base = base.withColumn("entities", F.transform(names, entity))
    judged = [
        F.struct(F.col("quality").cast("double").alias("reliability"), (F.col("toxic") == 1).alias("propaganda")).alias("assessment"),
        F.struct(F.col("embedding").alias("vector")).alias("embedding"),
    ]
    return base.select(
        F.concat(F.lit("art-"), key).alias("id"),
        F.concat(F.lit("doc-"), key).alias("raw_document_id"),
        F.struct(
            F.substring_index("text", "\n", 1).alias("title"),
            F.when(n % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n * 7 % 365).cast("int"))).alias("publication_date"),
        ).alias("metadata"),
        F.struct(F.col("lang").alias("domain"), F.col("source").alias("sub_domain"), _pick(EVENT_TYPES, n).alias("event_type")).alias("taxonomy"),
        "entities",
        F.when(F.size("entities") > 1, F.slice(F.transform("entities", pair), F.lit(1), F.size("entities") - 1)).otherwise(F.expr("slice(transform(entities, x -> named_struct('source', '', 'target', '', 'predicate', '', 'confidence', 0D)), 1, 0)")).alias("relationships"),
        F.transform(upto(4), event).alias("events"),
        F.transform(upto(3), claim).alias("claims"),
        *(judged if assessed else []),
        F.struct(_minutes(n * 37 % 1440).alias("extraction_time"), F.lit("rules-1").alias("parser_version")).alias("provenance"),
        F.md5("text").alias("text_hash"),
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Common table expressions of the same three collections, for DuckDB.
VIEWS = f"""
sources AS (
  SELECT source AS id, source AS name, {_list(ENUMS["SourceType"])}[1 + n % 20] AS type, 'https://example.org/' || source AS endpoint,
         CASE WHEN n % 7 = 0 THEN 'DISABLED' WHEN n % 7 = 1 THEN 'ERROR' ELSE 'ENABLED' END AS status,
         n % 5 AS priority, 15 * (1 + n % 4) AS polling_minutes, TIMESTAMP '{BASE}' + to_minutes(n * 7) AS last_execution,
         ['tier' || (n % 3), 'group' || (n % 4)] AS tags
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)
), raw_documents AS (
  SELECT *, 'sha256:' || sha256(raw_content) AS content_hash FROM (
    SELECT 'doc-' || doc_id AS id, source AS source_id, 'doc://' || source || '/' || doc_id AS original_uri,
           TIMESTAMP '{BASE}' + to_minutes(doc_id + doc_id % 60) AS acquisition_time, TIMESTAMP '{BASE}' + to_minutes(doc_id) AS content_timestamp,
           'text/plain' AS mime_type, text AS raw_content FROM documents
    UNION ALL
    SELECT 'page-' || page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), url,
           TIMESTAMP '{BASE}' + to_minutes(2 * page_id + page_id % 60), TIMESTAMP '{BASE}' + to_minutes(2 * page_id), 'text/html', html FROM pages)
), articles AS (
  SELECT d.doc_id AS n, 'art-' || d.doc_id AS id, 'doc-' || d.doc_id AS raw_document_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN d.doc_id % 10 <> 0 THEN DATE '2024-01-01' + CAST(d.doc_id * 7 % 365 AS INTEGER) END AS publication_date,
         lang AS domain, source AS sub_domain, {_list(EVENT_TYPES)}[1 + d.doc_id % 5] AS event_type,
         CAST(quality AS DOUBLE) AS reliability, toxic = 1 AS propaganda, embedding AS vector,
         TIMESTAMP '{BASE}' + to_minutes(d.doc_id * 37 % 1440) AS extraction_time, md5(text) AS text_hash,
         list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'))) AS names
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), entities AS (
  SELECT id AS article_id, i AS place, n || ':' || name AS id, {_list(ENUMS["EntityType"])}[1 + length(name) % 13] AS type, name, lower(name) AS normalized_name,
         0.5::DOUBLE + (length(name) % 5) / 10.0::DOUBLE AS confidence
  FROM (SELECT id, n, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS i FROM articles)
), relationships AS (
  SELECT a.article_id, a.id AS source, b.id AS target, 'NEAR' AS predicate, 0.25::DOUBLE * (1 + a.place % 3) AS confidence
  FROM entities a JOIN entities b ON a.article_id = b.article_id AND b.place = a.place + 1
), article_events AS (
  SELECT a.id AS article_id, a.n, k, n || '-e' || k AS id, {_list(EVENT_TYPES)}[1 + (n + k) % 5] AS type, DATE '2024-01-01' + CAST((n * 3 + k) % 365 AS INTEGER) AS date
  FROM articles a, (VALUES (0), (1), (2)) v(k) WHERE k < n % 4
), claims AS (
  SELECT a.id AS article_id, a.n, k, n || '-c' || k AS id, CASE WHEN len(names) > k THEN n || ':' || names[1 + k] END AS source_entity_id,
         {_list(ENUMS["ClaimType"])}[1 + (n + k) % 8] AS type, {_list(ENUMS["Confidence"])}[1 + (n + 2 * k) % 5] AS confidence
  FROM articles a, (VALUES (0), (1)) v(k) WHERE k < n % 3
), evidence AS (
  SELECT c.article_id, c.id AS claim_id, c.id || '-v' || j AS id, {_list(ENUMS["EvidenceType"])}[1 + (n + k + j) % 6] AS type, 0.2::DOUBLE * (1 + (n + j) % 4) AS confidence
  FROM claims c, (VALUES (0), (1)) v(j) WHERE j <= (n + k) % 2
)"""
