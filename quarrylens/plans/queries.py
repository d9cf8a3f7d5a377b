"""Registered queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.text import canonical_url, normal_title
from ..operators import acquisition, alarms, collections, enrichment, finders, graph, identity, notifications, preparation, retrieval, rules
from ..operators.steps import finished, new_folder
from ..sources.connectors import JsonLinesConnector
from ..sources.feed import PostFetcher
from ..sources.store import SCHEMAS as COLLECTION_SCHEMAS
from ..sources.store import Collection
from ..schemas import ARTICLE as ARTICLE_SCHEMA
from ..schemas import ENUMS
from ..sources.vector_index import VectorIndex
from ..sources.views import VIEWS, articles, raw_documents, sources, table
from ..streaming import streams, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "2024-01-01 01:30:00"
LATER = "2025-01-20 00:00:00"
ARTICLE = "id, raw_document_id, title, CAST(publication_date AS VARCHAR) AS published"
ARTICLE_ORDER = "ORDER BY publication_date DESC NULLS LAST, extraction_time DESC NULLS LAST, id"
DOCUMENT = "id, source_id, original_uri, mime_type, content_hash"
DOCUMENT_ORDER = "ORDER BY content_timestamp DESC NULLS LAST, acquisition_time DESC NULLS LAST, id"
SOURCE = "id, name, type, status, priority"
SOURCE_ORDER = "ORDER BY priority NULLS FIRST, name NULLS FIRST, id"

#: Events with scope, severity and state, for the operations queries.
EVENTS = """
ev AS (
  SELECT *, 'org' || (user_id % 7) AS org, 'tenant' || (user_id % 3) AS tenant, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN value >= 40 THEN 'CRITICAL' WHEN value >= 20 THEN 'HIGH' WHEN value >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         ['INFO', 'WARNING', 'CRITICAL'][1 + event_id % 3] AS level,
         ['PENDING', 'RETRYING', 'FAILED', 'DEAD-LETTER', 'DELIVERED'][1 + event_id % 5] AS delivery,
         ['SUCCEEDED', 'FAILED', 'RUNNING', 'QUEUED'][1 + event_id % 4] AS state
  FROM events
), al AS (
  SELECT event_id AS alarm_id, *, date_trunc('second', ts) AS created_at, ['OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS', 'RESOLVED', 'CLOSED'][1 + event_id % 5] AS status,
         CASE WHEN event_id % 5 = 4 THEN date_trunc('second', ts) END AS closed_at, CASE WHEN event_id % 50 = 4 THEN TIMESTAMP '2025-01-10' END AS archived_at
  FROM ev WHERE event_type = 'error'
)"""


def query(sql: str | None = None, views: str = ""):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = wraps(f)(lambda spark, d: finished(spark, f.__name__, lambda: f(spark, d)))
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {views} " if views else "") + sql
        return f

    return register


def _article(df: DataFrame) -> DataFrame:
    return df.select("id", "raw_document_id", F.col("metadata.title").alias("title"), F.col("metadata.publication_date").cast("string").alias("published"))


def _document(df: DataFrame) -> DataFrame:
    return df.select("id", "source_id", "original_uri", "mime_type", "content_hash")


def _source(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "type", "status", "priority")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int"))
    return e.withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "org": F.concat(F.lit("org"), (F.col("user_id") % 7).cast("string")),
            "tenant": F.concat(F.lit("tenant"), (F.col("user_id") % 3).cast("string")),
            "k": F.get_json_object("props", "$.k").cast("int"),
            "severity": alarms.severity_of(F.col("value")),
            "level": pick(notifications.LEVELS, 3),
            "delivery": pick(("PENDING", "RETRYING", "FAILED", "DEAD-LETTER", "DELIVERED"), 5),
            "state": pick(("SUCCEEDED", "FAILED", "RUNNING", "QUEUED"), 4),
        }
    )


def _alarms(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter("event_type = 'error'")
    status = F.get(F.array(*[F.lit(v) for v in ("OPEN", "ACKNOWLEDGED", "IN_PROGRESS", "RESOLVED", "CLOSED")]), (F.col("event_id") % 5).cast("int"))
    e = e.withColumns({"alarm_id": F.col("event_id"), "created_at": F.date_trunc("second", "ts"), "status": status})
    return e.withColumns({"closed_at": F.when(F.col("event_id") % 5 == 4, F.col("created_at")), "archived_at": F.when(F.col("event_id") % 50 == 4, F.lit("2025-01-10").cast("timestamp"))})


# --- lookups -------------------------------------------------------------------------------


@query(f"SELECT {DOCUMENT} FROM raw_documents", VIEWS)
def i01_scan(spark, d):
    return _document(finders.all_rows(raw_documents(spark, d)))


@query(f"SELECT {ARTICLE} FROM articles WHERE id = 'art-7'", VIEWS)
def i02_article_by_id(spark, d):
    return _article(finders.by_id(articles(spark, d), "art-7"))


@query(f"SELECT {DOCUMENT} FROM raw_documents WHERE id = 'page-3'", VIEWS)
def i03_document_by_id(spark, d):
    return _document(finders.by_id(raw_documents(spark, d), "page-3"))


@query(f"SELECT {SOURCE} FROM sources WHERE id = 'src4'", VIEWS)
def i04_source_by_id(spark, d):
    return _source(finders.by_id(sources(spark, d), "src4"))


@query(f"SELECT {ARTICLE} FROM articles WHERE raw_document_id = 'doc-11'", VIEWS)
def i05_article_by_raw_document(spark, d):
    return _article(finders.first_where(articles(spark, d), raw_document_id="doc-11"))


@query(f"SELECT {DOCUMENT} FROM raw_documents WHERE source_id = 'src5' AND original_uri = 'doc://src5/5'", VIEWS)
def i06_document_by_uri(spark, d):
    return _document(finders.first_where(raw_documents(spark, d), source_id="src5", original_uri="doc://src5/5"))


@query(f"SELECT {DOCUMENT} FROM raw_documents WHERE source_id = 'src9' AND content_hash = (SELECT content_hash FROM raw_documents WHERE id = 'doc-9') ORDER BY id LIMIT 1", VIEWS)
def i07_document_by_hash(spark, d):
    known = table(spark, d, "documents").filter("doc_id = 9").select(codecs.content_hash(F.col("text")).alias("content_hash"))
    matching = raw_documents(spark, d).filter("source_id = 'src9'").join(known, "content_hash", "left_semi")
    return _document(matching.orderBy("id").limit(1))


@query(f"SELECT {SOURCE} FROM sources WHERE name = 'src3'", VIEWS)
def i08_source_by_name(spark, d):
    return _source(finders.first_where(sources(spark, d), name="src3"))


@query(f"SELECT {ARTICLE} FROM articles WHERE domain = 'fr' {ARTICLE_ORDER} LIMIT 25", VIEWS)
def i09_articles_by_domain(spark, d):
    return _article(finders.articles_by_domain(articles(spark, d), "fr", 25))


@query(f"SELECT {ARTICLE} FROM articles WHERE id IN (SELECT article_id FROM article_events WHERE type = 'ELECTION') {ARTICLE_ORDER} LIMIT 30", VIEWS)
def i10_articles_by_event_type(spark, d):
    return _article(finders.articles_by_event_type(articles(spark, d), "ELECTION", 30))


@query(f"SELECT {ARTICLE} FROM articles WHERE id IN (SELECT article_id FROM entities WHERE normalized_name = 'that') {ARTICLE_ORDER} LIMIT 100", VIEWS)
def i11_articles_by_entity(spark, d):
    return _article(finders.articles_by_entity(articles(spark, d), "that", 0))


@query(f"SELECT {ARTICLE} FROM articles {ARTICLE_ORDER} LIMIT 100", VIEWS)
def i12_recent_articles(spark, d):
    return _article(finders.recent_articles(articles(spark, d), -1))


@query(f"SELECT {DOCUMENT} FROM raw_documents WHERE source_id = 'src2' {DOCUMENT_ORDER} LIMIT 20", VIEWS)
def i13_documents_by_source(spark, d):
    return _document(finders.documents_by_source(raw_documents(spark, d), "src2", 20))


@query(f"SELECT {DOCUMENT} FROM raw_documents {DOCUMENT_ORDER} LIMIT 40", VIEWS)
def i14_recent_documents(spark, d):
    return _document(finders.recent_documents(raw_documents(spark, d), 40))


@query(f"SELECT {SOURCE} FROM sources WHERE status = 'DISABLED' {SOURCE_ORDER} LIMIT 100", VIEWS)
def i15_sources_by_status(spark, d):
    return _source(finders.sources_by_status(sources(spark, d), "DISABLED"))


@query(f"SELECT {SOURCE} FROM sources WHERE type = 'RSS' {SOURCE_ORDER} LIMIT 5", VIEWS)
def i16_sources_by_type(spark, d):
    return _source(finders.sources_by_type(sources(spark, d), "RSS", 5))


@query(f"SELECT {SOURCE} FROM sources WHERE status = 'ENABLED' {SOURCE_ORDER} LIMIT 100", VIEWS)
def i17_enabled_sources(spark, d):
    return _source(finders.enabled_sources(sources(spark, d)))


# --- writes and unique keys ----------------------------------------------------------------


@query("SELECT id, content_hash, mime_type FROM raw_documents WHERE NOT (id LIKE 'doc-%' AND content_hash < 'sha256:8') UNION ALL SELECT id, 'replaced', mime_type FROM raw_documents WHERE id LIKE 'doc-%' AND content_hash < 'sha256:8'", VIEWS)
def i26_upsert(spark, d):
    rows = raw_documents(spark, d).select("id", "content_hash", "mime_type")
    new = rows.filter("id LIKE 'doc-%' AND content_hash < 'sha256:8'").withColumn("content_hash", F.lit("replaced"))
    return collections.upserted(rows, new)


@query("SELECT sha256(source_id || chr(31) || original_uri) AS id, source_id FROM raw_documents", VIEWS)
def i29_generated_ids(spark, d):
    rows = raw_documents(spark, d).withColumn("id", F.lit(None).cast("string"))
    return codecs.with_id(rows, "source_id", "original_uri").select("id", "source_id")


@query("SELECT count(*) AS n, count(acquisition_time) AS with_time FROM raw_documents", VIEWS)
def i30_default_acquisition_time(spark, d):
    rows = raw_documents(spark, d).withColumn("acquisition_time", F.when(F.xxhash64("id") % 2 == 0, F.col("acquisition_time")))
    return codecs.with_document_defaults(rows).agg(F.count("*").alias("n"), F.count("acquisition_time").alias("with_time"))


@query(f"SELECT {SOURCE} FROM sources WHERE id <> 'src1'", VIEWS)
def i31_delete(spark, d):
    return _source(collections.deleted(sources(spark, d), "id", "src1"))


@query("SELECT min(id) AS id, raw_document_id FROM articles GROUP BY raw_document_id", VIEWS)
def i32_unique_raw_document(spark, d):
    kept, _ = collections.unique_first(articles(spark, d).select("id", "raw_document_id"), ["raw_document_id"], ["id"])
    return kept


@query("SELECT id, source_id, original_uri FROM raw_documents QUALIFY row_number() OVER (PARTITION BY source_id, original_uri ORDER BY acquisition_time, id) = 1", VIEWS)
def i33_unique_source_uri(spark, d):
    kept, _ = collections.unique_first(raw_documents(spark, d), ["source_id", "original_uri"], ["acquisition_time", "id"])
    return kept.select("id", "source_id", "original_uri")


@query("SELECT id, source_id, content_hash FROM raw_documents QUALIFY row_number() OVER (PARTITION BY source_id, content_hash ORDER BY acquisition_time, id) > 1", VIEWS)
def i34_rejected_source_hash(spark, d):
    _, rejected = collections.unique_first(raw_documents(spark, d), ["source_id", "content_hash"], ["acquisition_time", "id"])
    return rejected.select("id", "source_id", "content_hash")


@query(f"SELECT {SOURCE} FROM sources QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1", VIEWS)
def i35_unique_source_name(spark, d):
    kept, _ = collections.unique_first(sources(spark, d), ["name"], ["id"])
    return _source(kept)


_TWO_KEYS = """RECURSIVE given AS (
  SELECT event_id, event_type AS scope, user_id % 40 AS one, CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 END AS two,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, lpad(CAST(event_id AS VARCHAR), 9, '0')) AS nth FROM events
), walk AS (
  SELECT DISTINCT scope, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, true AS accepted, CAST(NULL AS VARCHAR) AS reason, CAST([] AS BIGINT[]) AS ones, CAST([] AS INTEGER[]) AS twos FROM given
  UNION ALL
  SELECT g.scope, g.nth, g.event_id, free, CASE WHEN free THEN NULL WHEN list_contains(ones, g.one) THEN 'one' ELSE 'two' END,
         CASE WHEN free THEN list_append(ones, g.one) ELSE ones END, CASE WHEN free AND g.two IS NOT NULL THEN list_append(twos, g.two) ELSE twos END
  FROM (SELECT g.*, w.ones, w.twos, NOT list_contains(ones, g.one) AND (g.two IS NULL OR NOT list_contains(twos, g.two)) AS free FROM walk w JOIN given g ON g.scope = w.scope AND g.nth = w.nth + 1) g
)"""


@query("SELECT event_id, accepted, reason FROM walk WHERE event_id IS NOT NULL", _TWO_KEYS)
def i33_i34_two_unique_keys(spark, d):
    """Events as rows that collide in either key; the SQL takes them one by one."""
    k = F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k").cast("int") % 30)
    rows = table(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"), "event_id", F.col("event_type").alias("scope"), (F.col("user_id") % 40).alias("one"), k.alias("two"), "ts")
    return collections.unique_by_two(rows, "scope", "one", "two", ["ts"]).select("event_id", "accepted", "reason")


# --- stored collections --------------------------------------------------------------------


def _collection(spark, name: str) -> Collection:
    return Collection(spark, new_folder(spark, "collections"), name)


def _filled(df: DataFrame, schema) -> DataFrame:
    """``df`` with every column of a schema, null where it has none."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


@query("""SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'saved' ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d') END AS acquired,
CASE WHEN doc_id % 2 = 0 THEN 'again' WHEN doc_id % 5 = 0 THEN 'later' END AS metadata FROM documents""")
def i27_save_documents(spark, d):
    """All documents, some twice in one save (the later one counts), half of them saved again; without an acquisition time they have that of their save."""
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "doc_id", F.col("source").alias("source_id"), F.concat(F.lit("doc://"), "doc_id").alias("original_uri"), at.alias("content_timestamp"), F.when(F.col("doc_id") % 3 != 0, at).alias("acquisition_time"), F.lit("text/plain").alias("mime_type"))
    twice = docs.filter("doc_id % 5 = 0").withColumn("content_timestamp", F.col("content_timestamp") + F.expr("INTERVAL 1 DAY")).withColumn("metadata", F.lit("later"))
    saved = _collection(spark, "raw_documents")
    clock = lambda: F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    begun = clock()
    saved.save(_filled(docs, saved.schema).unionByName(_filled(twice, saved.schema)), latest=["content_timestamp"])
    saved.save(_filled(docs.filter("doc_id % 2 = 0").withColumn("metadata", F.lit("again")), saved.schema))
    # given times run on with the ids, past today in large tables: only rows without one can have that of a save
    unset = F.substring_index("id", "-", -1).cast("long") % 3 == 0
    now = unset & F.col("acquisition_time").between(begun, clock())
    return saved.read().select("id", F.when(now, "saved").otherwise(F.date_format("acquisition_time", "yyyy-MM-dd")).alias("acquired"), "metadata")


@query("SELECT id, CASE WHEN priority % 2 = 0 THEN 'ENABLED' ELSE status END AS status, CASE WHEN priority = 3 THEN 0 ELSE priority END AS priority, 0 AS n_tags FROM sources", VIEWS)
def i28_save_sources(spark, d):
    given = sources(spark, d).withColumns({"status": F.when(F.col("priority") % 2 != 0, F.col("status")), "priority": F.when(F.col("priority") != 3, F.col("priority")), "tags": F.lit(None).cast("array<string>")})
    saved = _collection(spark, "sources")
    saved.save(_filled(given.drop("authentication"), saved.schema))
    return saved.read().select("id", "status", "priority", F.size("tags").alias("n_tags"))


def _stored_articles(spark, d) -> Collection:
    rows = articles(spark, d).select("id", "raw_document_id", F.struct(*[F.col(f"metadata.{c}") if c in ("title", "publication_date") else F.lit(None).cast(t).alias(c) for c, t in _kinds("metadata")]).alias("metadata"),
        F.struct(*[F.col(f"taxonomy.{c}") if c in ("domain", "sub_domain", "event_type") else F.lit(None).cast(t).alias(c) for c, t in _kinds("taxonomy")]).alias("taxonomy"),
        F.transform("entities", lambda e: F.struct(*[e[c] if c in ("id", "type", "name", "normalized_name", "confidence") else F.lit(None).cast(t).alias(c) for c, t in _kinds("entities")])).alias("entities"),
        F.transform("events", lambda e: F.struct(*[e[c] if c in ("id", "type", "date", "participants", "locations") else F.lit(None).cast(t).alias(c) for c, t in _kinds("events")])).alias("events"))
    saved = _collection(spark, "articles")
    saved.save(_filled(rows, saved.schema))
    return saved


def _kinds(column: str):
    kind = ARTICLE_SCHEMA[column].dataType
    return [(f.name, f.dataType) for f in getattr(kind, "elementType", kind).fields]


@query("SELECT 'domain' AS search, id FROM articles WHERE domain = 'fr' AND sub_domain = 'src5' UNION ALL SELECT 'entity', article_id FROM entities WHERE normalized_name = 'that' UNION ALL SELECT 'event', article_id FROM article_events WHERE type = 'ELECTION' AND date < DATE '2024-03-01'", VIEWS)
def i36_article_layout(spark, d):
    """Lookups on stored articles: a folder of the layout, and the sorted side tables of arrays."""
    saved = _stored_articles(spark, d)
    domain = saved.in_folder("fr").filter("taxonomy.sub_domain = 'src5'").select(F.lit("domain").alias("search"), "id")
    entity = saved.side("entities").filter("normalized_name = 'that'").select(F.lit("entity").alias("search"), F.col("own_id").alias("id"))
    event = saved.side("events").filter("type = 'ELECTION' AND date < DATE '2024-03-01'").select(F.lit("event").alias("search"), F.col("own_id").alias("id"))
    return domain.unionByName(entity).unionByName(event)


@query("SELECT id, strftime(acquisition_time, '%Y-%m-%d %H:%M:%S') AS acquired FROM raw_documents WHERE mime_type = 'text/html' AND acquisition_time >= TIMESTAMP '2024-01-01 02:00:00'", VIEWS)
def i37_document_layout(spark, d):
    saved = _collection(spark, "raw_documents")
    rows = raw_documents(spark, d).withColumns({"raw_content": F.lit(None), "source_id": F.concat_ws("/", "source_id", "id"), "content_hash": F.lit(None)})
    saved.save(_filled(rows, saved.schema))
    return saved.in_folder("text/html").filter(F.col("acquisition_time") >= F.lit("2024-01-01 02:00:00").cast("timestamp")).select("id", _stamp("acquisition_time").alias("acquired"))


@query("SELECT 'status' AS search, id FROM sources WHERE status = 'ENABLED' AND priority <= 1 UNION ALL SELECT 'tag', id FROM sources WHERE list_contains(tags, 'tier1')", VIEWS)
def i38_source_layout(spark, d):
    saved = _collection(spark, "sources")
    saved.save(_filled(sources(spark, d).drop("authentication"), saved.schema))
    status = saved.in_folder("ENABLED").filter("priority <= 1").select(F.lit("status").alias("search"), "id")
    return status.unionByName(saved.side("tags").filter("value = 'tier1'").select(F.lit("tag").alias("search"), F.col("own_id").alias("id")))


# --- codecs --------------------------------------------------------------------------------


@query("SELECT id, polling_minutes * 60 AS seconds, CASE WHEN polling_minutes >= 60 THEN 'PT' || (polling_minutes // 60) || 'H' ELSE 'PT' || polling_minutes || 'M' END AS text FROM sources", VIEWS)
def i45_durations(spark, d):
    rows = sources(spark, d)
    text = codecs.format_duration(F.col("polling_interval"))
    return rows.select("id", codecs.duration_seconds(codecs.parse_duration(text)).cast("int").alias("seconds"), text.alias("text"))


@query("SELECT id, base64(encode(raw_content)) AS body, md5(raw_content) AS back FROM raw_documents", VIEWS)
def i46_base64(spark, d):
    body = F.regexp_replace(codecs.encode_bytes(F.encode("raw_content", "UTF-8")), "[\r\n]", "")
    return raw_documents(spark, d).select("id", body.alias("body"), F.md5(codecs.decode_bytes(body)).alias("back"))


@query("SELECT id, status, CASE WHEN status IN ('ENABLED', 'ERROR') THEN status END AS checked, list_position(['ENABLED', 'DISABLED', 'ERROR'], status) - 1 AS place FROM sources", VIEWS)
def i47_enum_domain(spark, d):
    status = F.when(F.col("status") == "DISABLED", "disabled").otherwise(F.col("status"))
    return sources(spark, d).select("id", "status", codecs.enum_value(status, "SourceStatus").alias("checked"), codecs.enum_ordinal(F.col("status"), "SourceStatus").cast("int").alias("place"))


@query("SELECT user_id, event_type, k FROM ev", EVENTS)
def i43_json_rows(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("props", T.StructType([T.StructField("k", T.IntegerType())]))])
    e = table(spark, d, "events")
    lines = e.select(F.concat(F.lit('{"user_id":'), "user_id", F.lit(',"event_type":"'), "event_type", F.lit('","unknown":[1],"props":'), "props", F.lit("}")).alias("value"))
    return codecs.from_json_lines(lines, schema).select("user_id", "event_type", "props.k")


@query("SELECT event_id, CASE WHEN k IS NULL THEN 'name must not be null' END AS message, s.id FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'src' || (event_id % 40) END AS k FROM events) LEFT JOIN sources s ON s.name = k", VIEWS)
def i39_null_guard(spark, d):
    """Every event asks for a source by name: which it finds, or that it asked for null."""
    asked = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("src"), (F.col("event_id") % 40).cast("string"))).alias("name"))
    return finders.asked_for(asked, sources(spark, d), "name").select("event_id", "message", "id")


@query("SELECT id, id IN ('src1', 'src2', 'src3') AS deleted FROM sources WHERE id NOT IN ('src1', 'src2')", VIEWS)
def i31_stored_delete(spark, d):
    """Deletes of a collection that is saved to between them: of rows there, gone, and there again."""
    saved = _collection(spark, "sources")
    rows = _filled(sources(spark, d).drop("authentication"), saved.schema)
    saved.save(rows)
    for id in ("src1", "src2", "src3", "src1", "none"):
        saved.delete(id)
    saved.save(rows.filter("id = 'src3'").withColumn("description", F.lit("again")))
    return saved.read().select("id", F.coalesce(F.col("description") == "again", F.lit(False)).alias("deleted"))


@query("SELECT 0 AS before, count(*) AS after FROM sources", VIEWS)
def i40_open_collection(spark, d):
    """A collection opened under a new root is empty, and is there for another that opens it later."""
    first = _collection(spark, "sources")
    before = first.read().count()
    first.save(_filled(sources(spark, d).drop("authentication"), first.schema))
    again = Collection(spark, first.folder.rsplit("/", 1)[0], "sources")
    return again.read().agg(F.lit(before).cast("int").alias("before"), F.count("*").alias("after"))


@query("SELECT id, CAST(status AS VARCHAR) AS status, priority, strftime(last_execution, '%Y-%m-%dT%H:%M:%SZ') AS run, tags[1] AS tag FROM sources", VIEWS)
def i42_row_as_document(spark, d):
    """Rows as JSON documents, and back by their fields."""
    rows = sources(spark, d).withColumn("run", codecs.format_instant(F.col("last_execution"))).select("id", "status", "priority", "run", "tags")
    text = lambda path: F.get_json_object("value", f"$.{path}")
    return codecs.to_json_lines(rows).select(text("id").alias("id"), text("status").alias("status"), text("priority").cast("int").alias("priority"), text("run").alias("run"), text("tags[0]").alias("tag"))


@query("SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS instant FROM events")
def i44_instants(spark, d):
    """Instants to text and back; what is no instant is null."""
    text = F.when(F.col("event_id") % 13 != 0, codecs.format_instant(F.col("ts").cast("timestamp"))).otherwise("yesterday")
    return table(spark, d, "events").select("event_id", codecs.format_instant(codecs.parse_instant(text)).alias("instant"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_entities, 0 AS n_topics, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_events FROM documents")
def i49_empty_lists(spark, d):
    """Lists that a document doesn't have, or has as null, are empty, in nested parts too."""
    some = F.when(F.col("doc_id") % 3 == 0, F.lit('"entities":null,')).otherwise('"entities":[{"id":"e"}],"events":[{"id":"v"}],')
    lines = table(spark, d, "documents").select(F.concat(F.lit('{"id":"'), "doc_id", F.lit('",'), some, F.lit('"taxonomy":{"domain":"x"}}')).alias("value"))
    rows = codecs.empty_lists(codecs.from_json_lines(lines, ARTICLE_SCHEMA))
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.size("entities").alias("n_entities"), F.size("taxonomy.topics").alias("n_topics"), F.size("events").alias("n_events"))


@query("SELECT id, CASE WHEN priority = 0 THEN 'ENABLED' ELSE status END AS status FROM sources", VIEWS)
def i50_status_default(spark, d):
    given = sources(spark, d).select("id", F.when(F.col("priority") != 0, F.col("status")).alias("status"), "priority")
    return codecs.with_source_defaults(given).select("id", "status")


@query("SELECT doc_id, 'sha256:' || sha256('{\"url\":\"doc://' || doc_id || '\",\"lang\":\"' || lang || '\"}') AS content_hash, 'application/json' AS mime_type FROM documents")
def i52_fetched_posts(spark, d):
    """What the connector of JSON lines delivers from a folder of posts."""
    folder = new_folder(spark, "posts")
    posts = table(spark, d, "documents").select(F.concat(F.lit('{"url":"doc://'), "doc_id", F.lit('","lang":"'), "lang", F.lit('"}')).alias("value"))
    posts.write.text(folder)
    rows = JsonLinesConnector().fetch(spark, "posts", folder)
    return rows.select(F.substring("original_uri", 7, 20).cast("long").alias("doc_id"), "content_hash", "mime_type")


@query("SELECT 'ONLINE: ' || name || ' ' || 'example.org' || ':' || (8000 + priority) AS probe FROM sources", VIEWS)
def i58_probe_text(spark, d):
    return sources(spark, d).select(codecs.probe_text(F.lit("ONLINE"), F.col("name"), F.lit("example.org"), 8000 + F.col("priority")).alias("probe"))


# --- acquisition, provenance, deduplication ------------------------------------------------

_TRACE = """SELECT a.id, a.title, r.original_uri, r.content_hash, s.name AS source_name, s.type AS source_type, s.priority AS source_priority
FROM articles a LEFT JOIN raw_documents r ON r.id = a.raw_document_id LEFT JOIN sources s ON s.id = r.source_id"""


@query(f"{_TRACE} {ARTICLE_ORDER.replace('id', 'a.id')} LIMIT 100", VIEWS)
def c14_recent_articles_with_provenance(spark, d):
    recent = finders.recent_articles(articles(spark, d))
    found = acquisition.traced(recent, raw_documents(spark, d), sources(spark, d))
    return found.select("id", F.col("metadata.title").alias("title"), "original_uri", "content_hash", "source_name", "source_type", "source_priority")


@query(_TRACE, VIEWS)
def c14_traceability(spark, d):
    found = acquisition.traced(articles(spark, d), raw_documents(spark, d), sources(spark, d))
    return found.select("id", F.col("metadata.title").alias("title"), "original_uri", "content_hash", "source_name", "source_type", "source_priority")


@query("SELECT r.id, r.source_id, s.priority FROM raw_documents r JOIN sources s ON s.id = r.source_id WHERE s.status = 'ENABLED'", VIEWS)
def c01_acquisition(spark, d):
    return acquisition.acquired(sources(spark, d), raw_documents(spark, d)).select("id", "source_id", "priority")


_RUNS = VIEWS + """, posts AS (
  SELECT source_id, content_hash, CAST(replace(id, 'doc-', '') AS BIGINT) % 3 + 1 AS drop_number FROM raw_documents WHERE id LIKE 'doc-%'
), due AS (  -- polling takes 15, 30, 45 or 60 minutes; runs are 40 minutes apart
  SELECT id, unnest(CASE WHEN last_execution + to_minutes(polling_minutes) > TIMESTAMP '2024-02-01' THEN [2, 3] WHEN polling_minutes <= 40 THEN [1, 2, 3] ELSE [1, 3] END) AS run
  FROM sources WHERE status = 'ENABLED'
)"""


@query("SELECT source_id, content_hash, min(run) AS run FROM posts JOIN due ON due.id = source_id AND run >= drop_number GROUP BY source_id, content_hash", _RUNS)
def c01_acquisition_loop(spark, d):
    """Three runs over all sources, 40 minutes apart, a third of the documents delivered before each; run: which one brought a document."""
    root, start = new_folder(spark, "acquired"), dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
    known, saved = Collection(spark, root, "sources"), Collection(spark, root, "raw_documents")
    known.save(_filled(sources(spark, d).drop("authentication").withColumn("endpoint", F.concat(F.lit(f"{root}/posts/source="), "id")), known.schema))
    posts = table(spark, d, "documents").filter("source IS NOT NULL")
    for run in range(3):
        now = start + dt.timedelta(minutes=40 * run)
        fresh = posts.filter(F.col("doc_id") % 3 == run)
        time = F.date_format(F.lit(now - dt.timedelta(minutes=20)) + F.make_dt_interval(secs=(F.col("doc_id") % 1000).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ssXXX")
        fresh.select("source", F.concat(F.lit("doc://"), "doc_id").alias("url"), time.alias("time"), F.coalesce("text", F.lit("")).alias("body")).repartition("source").write.mode("append").partitionBy("source").json(f"{root}/posts")
        acquisition.acquire(known, saved, {kind: PostFetcher() for kind in ENUMS["SourceType"]}, now)
    number = 1 + F.round((F.unix_timestamp("acquisition_time") - int(start.timestamp())) / 2400).cast("int")
    return saved.read().select("source_id", "content_hash", number.alias("run"))


@query("SELECT id, source_id FROM raw_documents QUALIFY row_number() OVER (PARTITION BY source_id, original_uri ORDER BY acquisition_time, id) = 1", VIEWS)
def c02_dedup_by_uri(spark, d):
    return acquisition.first_by(raw_documents(spark, d), "source_id", "original_uri").select("id", "source_id")


@query("SELECT id, source_id FROM raw_documents QUALIFY row_number() OVER (PARTITION BY source_id, content_hash ORDER BY acquisition_time, id) = 1", VIEWS)
def c03_dedup_by_hash(spark, d):
    return acquisition.first_by(raw_documents(spark, d), "source_id", "content_hash").select("id", "source_id")


@query("SELECT id, row_number() OVER (PARTITION BY text_hash ORDER BY id) > 1 AS is_duplicate FROM articles", VIEWS)
def c04_duplicate_flag(spark, d):
    return acquisition.flagged_copies(articles(spark, d), "text_hash").select("id", "is_duplicate")


_CANONICAL = r"""regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^(www|m)\.', '')
|| regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]*(:[0-9]+)', 1)
|| regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/+$', '')
|| coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'),
     lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|msclkid|mc_cid|mc_eid|ref)(=|$)'))), '&'), ''), '')"""


@query(f"SELECT {_CANONICAL} AS canonical, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT 'https://WWW.example.org:8080/a/?b=' || page_id % 7 || '&utm_source=x&a=' || page_id % 3 || '#top' FROM pages) GROUP BY 1")
def c05_canonical_urls(spark, d):
    """Addresses of pages, and made ones with ports, parameters and fragments."""
    pages = table(spark, d, "pages")
    made = F.concat(F.lit("https://WWW.example.org:8080/a/?b="), F.col("page_id") % 7, F.lit("&utm_source=x&a="), F.col("page_id") % 3, F.lit("#top"))
    return pages.select("url").union(pages.select(made)).groupBy(canonical_url(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"))


@query("SELECT content_hash AS key, count(*) AS n, min(id) AS first_id FROM raw_documents GROUP BY 1 HAVING count(*) > 1", VIEWS)
def c06_hash_copies(spark, d):
    return acquisition.hash_copies(raw_documents(spark, d))


@query("""SELECT v.vec_id, coalesce(n_close, 0) AS n_close, best_cosine FROM embeddings v LEFT JOIN (
  SELECT a.vec_id, count(*) AS n_close, max(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)) AS best_cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.5 GROUP BY 1) c ON c.vec_id = v.vec_id""")
def c07_close_vectors(spark, d):
    return retrieval.close_vectors(table(spark, d, "embeddings"), 0.5)


@query(r"SELECT trim(regexp_replace(lower(title), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS key, count(*) AS n, min(id) AS first_id FROM articles GROUP BY 1 HAVING count(*) > 1 AND key <> ''", VIEWS)
def c08_title_copies(spark, d):
    return acquisition.title_copies(articles(spark, d, assessed=False))


@query("""SELECT id AS article_id, coalesce(n_links, 0) AS n_links, best_share FROM articles LEFT JOIN (
  SELECT a, count(*) AS n_links, max(share) AS best_share FROM (
    SELECT x.article_id AS a, y.article_id AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS share
    FROM named x JOIN named y ON x.normalized_name = y.normalized_name AND x.article_id <> y.article_id GROUP BY ALL) WHERE share >= 0.5 GROUP BY 1) ON a = id""",
       VIEWS + ", named AS (SELECT *, count(*) OVER (PARTITION BY article_id) AS n FROM (SELECT DISTINCT article_id, normalized_name FROM entities))")
def c09_entity_overlap(spark, d):
    return graph.shared_entities(articles(spark, d, assessed=False), 0.5)


@query(r"""SELECT a.id AS article_id, c.class_id, coalesce(c.weight - 1 + coalesce(n.links, 0), 0) AS n_links, CASE WHEN c.weight > 1 THEN 0 ELSE n.away END AS nearest
FROM titled a LEFT JOIN classes c ON c.key = a.key LEFT JOIN (
  SELECT a.key, sum(b.weight) AS links, min(levenshtein(a.key, b.key)) AS away FROM classes a JOIN classes b ON a.key <> b.key AND abs(strlen(a.key) - strlen(b.key)) <= 2 AND levenshtein(a.key, b.key) <= 2 GROUP BY 1) n ON n.key = c.key""",
       VIEWS + r""", titled AS (SELECT id, trim(regexp_replace(lower(title), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS key FROM articles
), classes AS (SELECT key, min(id) AS class_id, count(*) AS weight FROM titled WHERE key <> '' GROUP BY key)""")  # fmt: skip
def c08_near_titles(spark, d):
    return acquisition.near_titles(articles(spark, d, assessed=False), 2)


@query("SELECT a.id AS article_id, coalesce(o.n, 0) AS n_overlaps FROM articles a LEFT JOIN (SELECT x.article_id, count(*) AS n FROM article_events x JOIN article_events y ON x.type = y.type AND x.article_id <> y.article_id AND abs(date_diff('day', x.date, y.date)) <= 3 GROUP BY 1) o ON o.article_id = a.id", VIEWS)
def c09_event_overlap(spark, d):
    return graph.event_overlap(articles(spark, d, assessed=False), 3)


@query("SELECT CASE WHEN mime_type IN ('text/html', 'text/plain') THEN 'article' END AS parser, mime_type, count(*) AS n FROM raw_documents GROUP BY ALL", VIEWS)
def c10_parser_routing(spark, d):
    return acquisition.routed(raw_documents(spark, d)).groupBy("parser", "mime_type").agg(F.count("*").alias("n"))


@query("""SELECT s.id, n_documents, strftime(greatest(s.last_execution, last_run), '%Y-%m-%d %H:%M:%S') AS last_execution, strftime(mark, '%Y-%m-%d %H:%M:%S') AS last_content
FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n_documents, max(acquisition_time) AS last_run, max(content_timestamp) AS mark FROM raw_documents GROUP BY 1) r ON r.source_id = s.id""", VIEWS)  # fmt: skip
def c11_source_state(spark, d):
    found = acquisition.source_state(sources(spark, d), raw_documents(spark, d))
    return found.select("id", "n_documents", _stamp("last_execution").alias("last_execution"), _stamp("last_content_timestamp").alias("last_content"))


@query(f"SELECT {SOURCE} FROM sources WHERE status = 'ENABLED' AND last_execution + to_minutes(polling_minutes) <= TIMESTAMP '{NOW}'", VIEWS)
def c12_due_sources(spark, d):
    return _source(acquisition.due_sources(sources(spark, d), F.to_timestamp(F.lit(NOW))))


@query("SELECT r.id, r.source_id FROM raw_documents r LEFT JOIN sources s ON s.id = r.source_id WHERE s.id IS NULL OR r.content_timestamp > s.last_execution", VIEWS)
def c13_since_high_water_mark(spark, d):
    marks = sources(spark, d).select(F.col("id").alias("source_id"), F.col("last_execution").alias("mark"))
    return acquisition.since(raw_documents(spark, d), marks).select("id", "source_id")


@query("""SELECT c.article_id, c.id AS claim_id, c.type AS claim_type, c.confidence AS claim_confidence, c.source_entity_id, v.id AS evidence_id, v.type AS evidence_type, round(v.confidence, 4) AS evidence_confidence
FROM claims c LEFT JOIN evidence v ON v.claim_id = c.id""", VIEWS)  # fmt: skip
def c15_flat_claims(spark, d):
    return acquisition.flat_claims(articles(spark, d)).withColumn("evidence_confidence", F.round("evidence_confidence", 4))


_ENRICHED = r"""base AS (
  SELECT doc_id, text, lang, source, string_split(text, chr(10)) AS lines, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')) AS long_words,
         list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS names, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS words FROM documents
), keyed AS (
  SELECT *, list_transform(list_sort(list_transform(long_words, lambda w: {'n': -length(w), 'w': w}))[1:5], lambda x: x.w) AS keywords FROM base
), counted AS (
  SELECT *, len(list_filter(lines, lambda x: regexp_matches(x, '["“«]') OR regexp_matches(x, '[0-9] ?%'))) AS n_claims, len(list_filter(lines, lambda x: regexp_matches(x, '["“«]'))) AS n_quotes,
         list_filter(list_transform(lines, lambda x: regexp_extract(x, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1)), lambda y: y <> '') AS years FROM keyed
)"""


@query("""SELECT doc_id, lang AS domain, array_to_string(keywords, ',') AS keywords, len(names) AS n_entities, CASE WHEN n_claims > 0 THEN lower(names[1]) END AS claimed_by, n_claims, n_quotes, array_to_string(years, ',') AS years,
round(least(1.0, (n_claims + len(years)) / 5), 4) AS relevance, round(list_sum(list_transform(names, lambda x: CASE WHEN list_contains(keywords, lower(x)) THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END)) / len(names), 4) AS confidence,
doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS duplicate, round(len(list_filter(words, lambda w: length(w) % 8 = 3)) / greatest(len(words), 1), 6) AS share_of_threes, 'rules-2' AS parser_version, '2024-01-01 01:30:00' AS extracted FROM counted""", _ENRICHED)  # fmt: skip
def c16_enrichment(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    out = enrichment.enriched(docs, F.to_timestamp(F.lit(NOW)))
    quotes = F.size(F.filter("claims", lambda c: c["type"] == "QUOTE"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("taxonomy.domain").alias("domain"), F.array_join("taxonomy.keywords", ",").alias("keywords"), F.size("entities").cast("long").alias("n_entities"),
        F.get("claims", F.lit(0))["source_entity"].alias("claimed_by"), F.size("claims").cast("long").alias("n_claims"), quotes.cast("long").alias("n_quotes"), F.array_join(F.transform("events", lambda e: e["year"]), ",").alias("years"),
        "assessment.relevance", F.when(F.size("entities") > 0, F.col("assessment.confidence")).alias("confidence"), "assessment.duplicate", F.col("embedding.vector")[3].alias("share_of_threes"), "provenance.parser_version", _stamp("provenance.extraction_time").alias("extracted"),
    )


@query("""SELECT normalized_name, type, count(*) AS n_mentions, count(DISTINCT article_id) AS n_articles, round(max(confidence), 4) AS confidence, max(name) AS name FROM entities GROUP BY 1, 2""", VIEWS)
def c17_vertices(spark, d):
    return graph.vertices(articles(spark, d, assessed=False)).withColumn("confidence", F.round("confidence", 4))


@query("""SELECT key, min(other) AS entity FROM walk GROUP BY key""", "RECURSIVE " + VIEWS + """, given AS (
  SELECT DISTINCT 'name:' || type || ':' || normalized_name AS named, CASE WHEN normalized_name < 'n' THEN 'id:Q' || substr(normalized_name, 1, 5) END AS outside FROM entities
), links AS (
  SELECT named AS a, outside AS b FROM given WHERE outside IS NOT NULL UNION SELECT outside, named FROM given WHERE outside IS NOT NULL
), walk AS (
  SELECT named AS key, named AS other FROM given UNION SELECT outside, outside FROM given WHERE outside IS NOT NULL UNION SELECT w.key, l.b FROM walk w JOIN links l ON l.a = w.other
)""")
def c17_entity_identity(spark, d):
    """Names of an entity across types, by an outside identifier; a third of the articles at a time, merged into what is known."""
    found = graph.mentions(articles(spark, d, assessed=False)).withColumn("outside", F.when(F.col("normalized_name") < "n", F.concat(F.lit("Q"), F.substring("normalized_name", 1, 5))))
    rows = found.select(F.substring("article_id", 5, 20).cast("long").alias("n"), identity.identity_keys(F.col("normalized_name"), F.col("type"), F.col("outside")).alias("keys"))
    return identity.entities([rows.filter(F.col("n") % 3 == k) for k in range(3)])


@query("""SELECT a.normalized_name AS source, b.normalized_name AS target, predicate, count(*) AS n, max(r.confidence) AS confidence
FROM relationships r JOIN entities a ON a.article_id = r.article_id AND a.id = r.source JOIN entities b ON b.article_id = r.article_id AND b.id = r.target GROUP BY 1, 2, 3""", VIEWS)  # fmt: skip
def c18_edges(spark, d):
    return graph.edges(articles(spark, d, assessed=False))


@query("""SELECT article_id, c.id AS claim_id, c.type, c.confidence, source_entity_id AS attributed_to, 'CLAIM' AS status, CAST(1 + (n + k) % 2 AS INTEGER) AS n_evidence, 'rules-1' AS parser_version FROM claims c""", VIEWS)
def c19_assertions(spark, d):
    return graph.assertions(articles(spark, d, assessed=False))


@query("""SELECT v.article_id, a.raw_document_id, claim_id, v.id AS evidence_id, v.type, round(v.confidence, 4) AS confidence, strftime(extraction_time, '%Y-%m-%d %H:%M:%S') AS extracted
FROM evidence v JOIN articles a ON a.id = v.article_id""", VIEWS)  # fmt: skip
def c20_evidence_with_provenance(spark, d):
    return graph.evidence_with_provenance(articles(spark, d, assessed=False)).withColumn("extracted", _stamp("extraction_time")).drop("extraction_time")


@query("""SELECT e.article_id, e.id AS event_id, e.type AS event_type, CASE WHEN x.place < k + 2 THEN 'participant' ELSE 'location' END AS role, x.normalized_name AS entity
FROM article_events e JOIN entities x ON x.article_id = e.article_id AND x.place >= k AND x.place <= k + 2""", VIEWS)  # fmt: skip
def c21_event_links(spark, d):
    return graph.event_links(articles(spark, d, assessed=False))


@query("SELECT id, len(vector) AS dimensions, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm FROM articles WHERE vector IS NOT NULL", VIEWS)
def c22_vector_entries(spark, d):
    v = F.col("embedding.vector")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return articles(spark, d).filter(v.isNotNull()).select("id", F.size(v).cast("long").alias("dimensions"), F.round(square, 4).alias("norm"))


@query("SELECT id, 'API_KEY' AS type, id AS username, NULL AS password, '***' AS api_key FROM sources", VIEWS)
def c23_masked_secrets(spark, d):
    return acquisition.masked(sources(spark, d)).select("id", "authentication.type", "authentication.username", "authentication.password", "authentication.api_key")


@query(f"SELECT {SOURCE} FROM sources WHERE list_contains(tags, 'tier1')", VIEWS)
def c24_sources_by_tag(spark, d):
    return _source(finders.sources_by_tag(sources(spark, d), "tier1"))


@query("SELECT domain, sub_domain, event_type, count(*) AS n FROM articles GROUP BY ROLLUP (domain, sub_domain, event_type)", VIEWS)
def c25_taxonomy_rollup(spark, d):
    return acquisition.taxonomy_rollup(articles(spark, d))


@query("SELECT mime_type, count(*) AS n, strftime(min(acquisition_time), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(acquisition_time), '%Y-%m-%d %H:%M:%S') AS last, CAST(sum(length(raw_content)) AS BIGINT) AS size FROM raw_documents GROUP BY 1", VIEWS)
def c26_mime_summary(spark, d):
    return acquisition.mime_summary(raw_documents(spark, d)).withColumns({"first": _stamp("first"), "last": _stamp("last")})


@query("SELECT id, source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY content_timestamp DESC, acquisition_time DESC, id) AS INTEGER) AS rank FROM raw_documents QUALIFY rank <= 3", VIEWS)
def c26_latest_per_source(spark, d):
    return acquisition.latest_per_source(raw_documents(spark, d), 3).select("id", "source_id", "rank")


# --- rules ---------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'True' ELSE 'False' END AS relation FROM events")
def d01_event_type_filter(spark, d):
    return rules.event_type_filter(table(spark, d, "events"), ["error", "signup"]).select("event_id", "relation")


@query("""SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'Failure' WHEN event_id % 23 = 0 THEN 'False' WHEN k >= 20 AND k < 80 AND k <> 50 AND CAST(k AS VARCHAR) LIKE '%3%' THEN 'True' ELSE 'False' END AS relation FROM ev""", EVENTS)
def d02_field_filter(spark, d):
    """Payloads cut short, with a word for the number, and without the field, among the others."""
    conditions = [{"path": "$.k", "op": "exists"}, {"path": "$.k", "op": "gte", "value": 20}, {"path": "$.k", "op": "lt", "value": 80}, {"path": "$.k", "op": "ne", "value": 50}, {"path": "$.k", "op": "contains", "value": "3"}]
    n = F.col("event_id")
    props = F.when(n % 17 == 0, F.lit('{"k": 3')).when(n % 19 == 0, F.lit('{"k": "many"}')).when(n % 23 == 0, F.lit('{"j": 33}')).otherwise(F.col("props"))
    return rules.field_filter(table(spark, d, "events").withColumn("props", props), conditions).select("event_id", "relation")


@query("SELECT event_id, user_id, org, tenant FROM ev", EVENTS)
def d03_enrich_scope(spark, d):
    users = _events(spark, d).select("user_id", "org", "tenant").distinct()
    return rules.with_scope(table(spark, d, "events"), users).select("event_id", "user_id", "org", "tenant")


_FLOWS = [("w1", "tenant0", None, "error", "ACTIVE", 2, 10), ("w2", "tenant0", "org1", "error", "ACTIVE", 1, 20), ("w3", "tenant1", None, "click", "ACTIVE", 1, 5), ("w4", "tenant1", None, "click", "DRAFT", 0, 7), ("w5", "tenant0", "org2", "error", "ACTIVE", 2, 30)]


@query("""SELECT event_id, uuid, CAST(row_number() OVER (PARTITION BY event_id ORDER BY priority, updated_at DESC, uuid) AS INTEGER) AS nth FROM ev JOIN flows USING (tenant)
WHERE flows.status = 'ACTIVE' AND (owner IS NULL OR owner = ev.org) AND on_type = ev.event_type""",
       EVENTS + ", flows(uuid, tenant, owner, on_type, status, priority, updated_at) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in _FLOWS) + ")")
def d04_workflow_resolution(spark, d):
    flows = spark.createDataFrame(_FLOWS, "uuid string, tenant string, org string, event_type string, status string, priority int, updated_at int")
    return rules.resolved_workflows(_events(spark, d), flows).select("event_id", "uuid", "nth")


@query("SELECT event_id, 'error' || ':' || user_id || ':' || severity AS alarm_key FROM al", EVENTS)
def d05_alarm_keys(spark, d):
    return _alarms(spark, d).select("event_id", alarms.alarm_key("event_type", "user_id", "severity").alias("alarm_key"))


@query("""SELECT DISTINCT a.user_id % 20 AS root, (a.user_id * 3 + 1) % 20 AS node, 1 AS depth, a.user_id % 20 = (a.user_id * 3 + 1) % 20 AS cyclic FROM events a""")
def d06_direct_calls(spark, d):
    return _chains(spark, d).filter("depth = 1")


def _chains(spark, d):
    calls = table(spark, d, "events").select((F.col("user_id") % 20).alias("caller"), ((F.col("user_id") * 3 + 1) % 20).alias("callee")).distinct()
    return rules.call_chains(spark, calls)


@query("""SELECT root, node, CAST(depth AS INTEGER) AS depth, cyclic FROM walk""",
       """RECURSIVE calls AS (SELECT DISTINCT user_id % 20 AS caller, (user_id * 3 + 1) % 20 AS callee FROM events),
walk AS (SELECT caller AS root, callee AS node, [caller, callee] AS path, 1 AS depth, caller = callee AS cyclic FROM calls
UNION ALL SELECT root, callee, list_append(path, callee), depth + 1, list_contains(path, callee) FROM walk JOIN calls ON caller = node WHERE NOT cyclic AND depth < 5)""")  # fmt: skip
def d06_call_chains(spark, d):
    return _chains(spark, d)


_GRAPHS = """RECURSIVE calls AS (
  SELECT DISTINCT 'g' || (user_id % 5) AS graph, user_id % 29 AS source, CASE WHEN user_id % 5 < 3 THEN (user_id * 7) % 31 ELSE user_id % 29 + 1 END AS target FROM events
), walk AS (
  SELECT graph, source AS start, target AS node FROM calls UNION SELECT w.graph, start, target FROM walk w JOIN calls c ON c.graph = w.graph AND c.source = w.node
)"""


@query("""SELECT DISTINCT graph, 'edge to no node' AS fault, 'n' || node AS at FROM (SELECT graph, source AS node FROM calls UNION SELECT graph, target FROM calls) WHERE node >= 25
UNION ALL SELECT 'g0', 'root missing', 'n99' UNION ALL SELECT DISTINCT graph, 'cycle', 'n' || start FROM walk WHERE start = node""", _GRAPHS)  # fmt: skip
def d07_graph_faults(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    graph_name = F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string"))
    node = lambda x: F.concat(F.lit("n"), x.cast("string"))
    nodes = users.select(graph_name.alias("graph")).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("graph", node(F.col("n")).alias("node"))
    target = F.when(F.col("user_id") % 5 < 3, (F.col("user_id") * 7) % 31).otherwise(F.col("user_id") % 29 + 1)
    edges = users.select(graph_name.alias("graph"), node(F.col("user_id") % 29).alias("source"), node(target).alias("target"))
    roots = spark.createDataFrame([("g0", "n99"), ("g1", "n1")], "graph string, node string")
    return rules.graph_faults(nodes, edges, roots)


@query("""SELECT event_type AS workflow, count(*) FILTER (state = 'QUEUED') AS queued, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'SUCCEEDED') AS succeeded, count(*) FILTER (state = 'FAILED') AS failed,
round(avg(k) FILTER (state IN ('SUCCEEDED', 'FAILED')), 4) AS avg_duration FROM ev GROUP BY 1""", EVENTS)  # fmt: skip
def d08_execution_counters(spark, d):
    return rules.execution_counters(_events(spark, d).withColumn("workflow", F.col("event_type")).withColumn("duration", F.col("k")))


@query("SELECT event_id, 'severe' AS node, CASE WHEN k > 90 THEN 'True' ELSE 'False' END AS relation FROM ev", EVENTS)
def d42_trace_rows(spark, d):
    return rules.traces(rules.field_filter(table(spark, d, "events"), [{"path": "$.k", "op": "gt", "value": 90}]), "severe")


# --- alarms --------------------------------------------------------------------------------


#: Errors open alarms of their user, signups close them.
_HISTORY = EVENTS + """, turns AS (
  SELECT *, CAST(user_id AS VARCHAR) AS alarm_key, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS closings FROM ev WHERE event_type IN ('error', 'signup')
), history AS (
  SELECT alarm_key, closings, arg_min(event_id, {'t': ts, 'i': event_id}) AS alarm_id, arg_min(severity, {'t': ts, 'i': event_id}) AS severity, count(*) AS occurrence_count, min(ts) AS first_at, max(ts) AS last_at
  FROM turns WHERE event_type = 'error' GROUP BY 1, 2
), alarms AS (
  SELECT h.*, lag(alarm_id) OVER (PARTITION BY h.alarm_key ORDER BY h.closings) AS previous_alarm_id, c.closed_at, CASE WHEN closed_at IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status
  FROM history h LEFT JOIN (SELECT alarm_key, closings - 1 AS closings, ts AS closed_at FROM turns WHERE event_type = 'signup') c USING (alarm_key, closings))"""


def _turns(spark, d):
    rows = _events(spark, d).filter(F.col("event_type").isin("error", "signup"))
    return rows.select(alarms.alarm_key("user_id").alias("alarm_key"), "event_id", "ts", "severity", (F.col("event_type") == "signup").alias("closes"))


@query("SELECT alarm_key, alarm_id, severity, occurrence_count, occurrence_count - 1 AS n_ignored, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM alarms WHERE status = 'OPEN'", _HISTORY)
def d09_alarm_dedup(spark, d):
    found = alarms.deduplicated(_turns(spark, d))
    return found.select("alarm_key", "alarm_id", "severity", "occurrence_count", "n_ignored", _stamp("first_at").alias("first_at"), _stamp("last_at").alias("last_at"))


@query("SELECT alarm_key, alarm_id, previous_alarm_id, occurrence_count, status, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed FROM alarms WHERE previous_alarm_id IS NOT NULL", _HISTORY)
def d10_alarm_after_close(spark, d):
    return alarms.reopened(_turns(spark, d)).select("alarm_key", "alarm_id", "previous_alarm_id", "occurrence_count", "status", _stamp("closed_at").alias("closed"))


@query("""SELECT alarm_key, episode, occurrence_count, alarm_id, lag(alarm_id) OVER (PARTITION BY alarm_key ORDER BY episode) AS previous_alarm_id FROM (
  SELECT alarm_key, episode, count(*) AS occurrence_count, arg_min(event_id, ts) AS alarm_id FROM (
    SELECT *, CAST(sum(fresh) OVER (PARTITION BY alarm_key ORDER BY ts, event_id) AS BIGINT) AS episode FROM (
      SELECT event_id, ts, CAST(user_id AS VARCHAR) AS alarm_key, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 48 HOURS, true) THEN 1 ELSE 0 END AS fresh FROM al)) GROUP BY 1, 2)""", EVENTS)  # fmt: skip
def d10_alarm_episodes(spark, d):
    return alarms.episodes(_alarms(spark, d).withColumn("alarm_key", alarms.alarm_key("user_id")), "48 HOURS")


@query("""SELECT alarm_id, nth, before, status FROM (SELECT user_id AS alarm_id, event_id AS nth, status, ['ADMINISTRATOR', 'TENANT', 'USER'][1 + k % 3] AS profile, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM al)
WHERE before IS NOT NULL AND NOT (before || '>' || status IN ('OPEN>ACKNOWLEDGED', 'OPEN>IN_PROGRESS', 'OPEN>RESOLVED', 'ACKNOWLEDGED>IN_PROGRESS', 'ACKNOWLEDGED>RESOLVED', 'IN_PROGRESS>RESOLVED', 'RESOLVED>IN_PROGRESS')
  OR (before = 'RESOLVED' AND status = 'CLOSED' AND profile <> 'USER') OR (before = 'CLOSED' AND status = 'OPEN' AND profile = 'ADMINISTRATOR'))""", EVENTS)  # fmt: skip
def d11_illegal_transitions(spark, d):
    profile = F.get(F.array(*[F.lit(x) for x in ("ADMINISTRATOR", "TENANT", "USER")]), F.col("k") % 3)
    history = _alarms(spark, d).select(F.col("user_id").alias("alarm_id"), F.col("event_id").alias("nth"), "status", profile.alias("profile"))
    return alarms.illegal_transitions(history).select("alarm_id", "nth", "before", "status")


_DUE = """due AS (
  SELECT *, CASE WHEN severity = 'CRITICAL' THEN created_at + INTERVAL 1 HOUR ELSE
    CAST(CAST(created_at AS DATE) - CAST(isodow(created_at) - 1 AS INTEGER) + CAST((total - 1) // 480 // 5 * 7 + (total - 1) // 480 % 5 AS INTEGER) AS TIMESTAMP) + to_minutes((total - 1) % 480 + 1 + 480) END AS due_at
  FROM (SELECT *, CAST(least(isodow(created_at) - 1, 5) * 480
      + CASE WHEN isodow(created_at) >= 6 THEN 0 ELSE least(greatest(hour(created_at) * 60 + minute(created_at) - 480, 0), 480) END
      + CASE severity WHEN 'HIGH' THEN 480 WHEN 'MEDIUM' THEN 960 WHEN 'LOW' THEN 2400 WHEN 'CRITICAL' THEN 60 END AS BIGINT) AS total FROM al))"""


def _due(spark, d):
    return _alarms(spark, d).withColumn("due_at", alarms.sla_due(F.col("created_at"), F.col("severity")))


@query("SELECT alarm_id, severity, strftime(due_at, '%Y-%m-%d %H:%M:%S') AS due FROM due", EVENTS + ", " + _DUE)
def d12_sla_due(spark, d):
    return _due(spark, d).select("alarm_id", "severity", _stamp("due_at").alias("due"))


_CALENDAR = """, calendar AS (
  SELECT 'org' || o AS org, o, CAST(DATE '2023-12-25' + CAST(k AS INTEGER) AS DATE) AS day, CASE WHEN o = 3 THEN 540 ELSE 480 END AS opens, k
  FROM range(7) t(o), range(120) u(k)
), days AS (
  SELECT org, day, opens, CASE WHEN (isodow(day) >= 6 AND NOT (o = 5 AND isodow(day) = 6)) OR (k + o) % 9 = 0 THEN 0 WHEN o = 3 THEN 600 ELSE 480 END AS minutes FROM calendar
), summed AS (
  SELECT *, CAST(sum(minutes) OVER (PARTITION BY org ORDER BY day) AS BIGINT) - minutes AS before FROM days
), needs AS (
  SELECT alarm_id, al.org, severity, created_at, before + least(greatest(hour(created_at) * 60 + minute(created_at) - opens, 0), minutes) + CASE severity WHEN 'HIGH' THEN 480 WHEN 'MEDIUM' THEN 960 WHEN 'LOW' THEN 2400 END AS until
  FROM al JOIN summed s ON s.org = al.org AND s.day = CAST(created_at AS DATE)
)"""


@query("""SELECT alarm_id, severity, strftime(CASE WHEN severity = 'CRITICAL' THEN created_at + INTERVAL 1 HOUR ELSE s.day + to_minutes(CAST(opens + until - before AS INTEGER)) END, '%Y-%m-%d %H:%M:%S') AS due
FROM needs n ASOF LEFT JOIN (SELECT * FROM summed WHERE minutes > 0) s ON s.org = n.org AND n.until > s.before""", EVENTS + _CALENDAR)
def d12_calendar_due(spark, d):
    """Due times by a calendar for each organization: its hours, its sixth day, its holidays."""
    days = spark.range(7 * 120).select((F.col("id") % 7).alias("o"), F.floor(F.col("id") / 7).alias("k"))
    day = F.date_add(F.lit("2023-12-25").cast("date"), F.col("k").cast("int"))
    closed = ((F.weekday(day) >= 5) & ~((F.col("o") == 5) & (F.weekday(day) == 5))) | ((F.col("k") + F.col("o")) % 9 == 0)
    opens = F.when(F.col("o") == 3, 540).otherwise(480)
    calendar = days.select(F.concat(F.lit("org"), F.col("o").cast("string")).alias("org"), day.alias("day"), opens.alias("opens"), F.when(closed, opens).when(F.col("o") == 3, 1140).otherwise(960).alias("closes"))
    return alarms.with_calendar_due(_alarms(spark, d), calendar).select("alarm_id", "severity", _stamp("due_at").alias("due"))


@query("SELECT alarm_id, status IN ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS') AND due_at < TIMESTAMP '2024-01-15' AS overdue, CAST(CASE WHEN status IN ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS') AND due_at < TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS INTEGER) AS level FROM due", EVENTS + ", " + _DUE)
def d13_escalation(spark, d):
    return alarms.with_escalation(_due(spark, d).withColumn("level", F.lit(0)), F.lit("2024-01-15").cast("timestamp")).select("alarm_id", "overdue", "level")


@query("SELECT alarm_id, CASE WHEN alarm_id % 3 = 0 THEN 'CRITICAL' ELSE severity END AS severity, strftime(CASE WHEN alarm_id % 3 = 0 AND status NOT IN ('RESOLVED', 'CLOSED') THEN created_at + INTERVAL 1 HOUR ELSE due_at END, '%Y-%m-%d %H:%M:%S') AS due FROM due", EVENTS + ", " + _DUE)
def d14_severity_change(spark, d):
    changes = _alarms(spark, d).filter("alarm_id % 3 = 0").select("alarm_id", F.lit("CRITICAL").alias("new_severity"))
    return alarms.with_new_severity(_due(spark, d), changes).select("alarm_id", "severity", _stamp("due_at").alias("due"))


_FILTERED = {
    "status": "status IN ('OPEN', 'RESOLVED')", "severity": "severity = 'HIGH'", "recipient_type": "k % 2 = 0", "organization": "org = 'org3'", "recipient_user": "user_id = 8", "responsible_user": "alarm_id % 200 IN (3, 8)",
    "source_type": "event_id % 3 = 0", "overdue": "due_at < TIMESTAMP '2024-01-15' AND status IN ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS')", "created": "created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS filter, alarm_id FROM due WHERE {sql}" for name, sql in _FILTERED.items()) + f" UNION ALL SELECT 'several', alarm_id FROM due WHERE {_FILTERED['status']} AND {_FILTERED['created']} AND {_FILTERED['source_type']} AND {_FILTERED['recipient_type']}", EVENTS + ", " + _DUE)
def d15_alarm_filters(spark, d):
    """Each filter on its own, and several together."""
    t = lambda s: F.lit(s).cast("timestamp")
    rows = alarms.with_escalation(_due(spark, d).withColumn("level", F.lit(0)), t("2024-01-15")).withColumns({
        "recipient_type": F.when(F.col("k") % 2 == 0, "USER").otherwise("ORGANIZATION"), "organization": F.col("org"), "recipient_user": F.col("user_id"),
        "responsible_user": F.col("alarm_id") % 200, "source_type": F.when(F.col("event_id") % 3 == 0, "WORKFLOW").otherwise("MANUAL"),
    })
    given = {
        "status": {"status": ["OPEN", "RESOLVED"]}, "severity": {"severity": "HIGH"}, "recipient_type": {"recipient_type": "USER"}, "organization": {"organization": "org3"}, "recipient_user": {"recipient_user": 8},
        "responsible_user": {"responsible_user": [3, 8]}, "source_type": {"source_type": "WORKFLOW"}, "overdue": {"overdue": True}, "created": {"created_from": t("2024-01-05"), "created_to": t("2024-01-20")},
    }
    given["several"] = given["status"] | given["created"] | given["source_type"] | given["recipient_type"]
    found = [alarms.filtered(rows, **x).select(F.lit(name).alias("filter"), "alarm_id") for name, x in given.items()]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT alarm_id, 'ORGANIZATION' AS profile FROM al WHERE org = 'org3' UNION ALL SELECT alarm_id, 'USER' FROM al WHERE user_id = 8", EVENTS)
def d16_visibility(spark, d):
    rows = _alarms(spark, d)
    seen = lambda profile, **scope: alarms.visible(rows, profile, **scope).select("alarm_id", F.lit(profile).alias("profile"))
    return seen("ORGANIZATION", org="org3").union(seen("USER", user_id=8))


@query("SELECT event_id AS nth, status FROM al WHERE user_id = 8", EVENTS)
def d17_timeline(spark, d):
    history = _alarms(spark, d).select(F.col("user_id").alias("alarm_id"), F.col("event_id").alias("nth"), "status")
    return alarms.timeline(history, 8).select("nth", "status")


@query(f"""SELECT count(*) AS total, count(*) FILTER (status IN ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS')) AS active, count(*) FILTER (severity = 'CRITICAL') AS critical,
count(*) FILTER (status IN ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS') AND due_at < TIMESTAMP '{LATER}') AS overdue, count(archived_at) AS archived,
count(*) FILTER (status = 'CLOSED' AND closed_at < TIMESTAMP '{LATER}' - INTERVAL 365 DAYS AND archived_at IS NULL) AS retention_candidates FROM due""", EVENTS + ", " + _DUE)  # fmt: skip
def d18_summary(spark, d):
    now = F.lit(LATER).cast("timestamp")
    return alarms.summary(alarms.with_escalation(_due(spark, d).withColumn("level", F.lit(0)), now), now)


@query(f"SELECT alarm_id, strftime(coalesce(archived_at, CASE WHEN status = 'CLOSED' AND closed_at < TIMESTAMP '{LATER}' - INTERVAL 365 DAYS THEN TIMESTAMP '{LATER}' END), '%Y-%m-%d %H:%M:%S') AS archived FROM al", EVENTS)
def d19_retention(spark, d):
    return alarms.archived(_alarms(spark, d), F.lit(LATER).cast("timestamp")).select("alarm_id", _stamp("archived_at").alias("archived"))


@query("SELECT alarm_id FROM due WHERE status IN ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS') AND due_at > TIMESTAMP '2024-01-10' AND due_at <= TIMESTAMP '2024-01-11'", EVENTS + ", " + _DUE)
def d44_reminders(spark, d):
    return alarms.reminders(_due(spark, d), F.lit("2024-01-10").cast("timestamp"), 24 * 60).select("alarm_id")


@query("SELECT alarm_id, status, status IN ('RESOLVED', 'CLOSED') AS sla_stopped, status = 'CLOSED' AS escalation_stopped FROM al", EVENTS)
def d45_stop_states(spark, d):
    return _alarms(spark, d).select("alarm_id", "status", F.col("status").isin("RESOLVED", "CLOSED").alias("sla_stopped"), (F.col("status") == "CLOSED").alias("escalation_stopped"))


@query("SELECT event_id, CASE WHEN level = 'CRITICAL' OR (level = 'WARNING' AND event_type = 'error') THEN true ELSE false END AS allowed FROM ev", EVENTS)
def d46_permissions(spark, d):
    kinds = ("view", "signup", "click", "error", "purchase")
    permissions = spark.createDataFrame([("CRITICAL", k) for k in kinds] + [("WARNING", "error")], "profile string, action string")
    requests = _events(spark, d).select("event_id", F.col("level").alias("profile"), F.col("event_type").alias("action"))
    return alarms.allowed_actions(requests, permissions).select("event_id", "allowed")


@query("SELECT alarm_id, CASE WHEN u.org IS NULL THEN 'no such user' ELSE 'other organization' END AS fault FROM al LEFT JOIN (SELECT DISTINCT user_id, org FROM ev) u ON u.user_id = alarm_id % 200 WHERE u.org IS NULL OR u.org <> al.org", EVENTS)
def d47_scope_faults(spark, d):
    users = _events(spark, d).select("user_id", "org").distinct()
    return alarms.scope_faults(_alarms(spark, d).withColumn("responsible", F.col("alarm_id") % 200), users)


# --- notifications -------------------------------------------------------------------------


@query("SELECT event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type, user_id, state ORDER BY ts, event_id) = 1", EVENTS)
def d20_notification_dedup(spark, d):
    return notifications.once(_events(spark, d), "event_type", "user_id", "state").select("event_id")


@query("SELECT event_id, level FROM ev WHERE event_type NOT IN ('error', 'click') OR (event_type = 'error' AND level <> 'INFO') OR (event_type = 'click' AND level = 'CRITICAL')", EVENTS)
def d21_minimum_level(spark, d):
    minimums = spark.createDataFrame([("error", "WARNING"), ("click", "CRITICAL")], "category string, minimum string")
    return notifications.at_least(_events(spark, d).withColumn("category", F.col("event_type")), minimums).select("event_id", "level")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END AS locale FROM documents")
def d22_locale(spark, d):
    return table(spark, d, "documents").select("doc_id", notifications.locale_of(F.col("lang")).alias("locale"))


@query("SELECT event_type AS category, level, state AS status, count(*) AS n FROM ev GROUP BY ALL", EVENTS)
def d23_volume_report(spark, d):
    return notifications.volume_report(_events(spark, d).select(F.col("event_type").alias("category"), "level", F.col("state").alias("status")))


@query("""SELECT category, CAST(day AS VARCHAR) AS day, n, round((n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0), 4) AS z FROM (SELECT event_type AS category, CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY 1, 2)
WINDOW w AS (PARTITION BY category) QUALIFY abs(z) >= 1.5""", EVENTS)  # fmt: skip
def d23_unusual_days(spark, d):
    return notifications.unusual_days(_events(spark, d).withColumn("category", F.col("event_type")), 1.5).withColumn("day", F.col("day").cast("string"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def d24_repeated_failures(spark, d):
    return notifications.repeated_failures(_events(spark, d), "1 day", 2).withColumn("start", _stamp("start"))


@query("SELECT event_id, user_id FROM ev WHERE org = 'org2' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20", EVENTS)
def d25_audit_page(spark, d):
    members = _events(spark, d).filter("org = 'org2'").select("user_id").distinct()
    return notifications.audit_page(_events(spark, d), members, 20, 50).select("event_id", "user_id")


@query("""SELECT event_id, owner, CASE WHEN k > 50 THEN 'lead' ELSE owner END AS recipient FROM ev JOIN (VALUES ('error', 'CRITICAL', 'team-a', 1), ('error', 'WARNING', 'team-b', 2), ('click', 'INFO', 'team-c', 1)) r(category, rule_level, owner, p)
ON category = event_type AND list_position(['INFO', 'WARNING', 'CRITICAL'], level) >= list_position(['INFO', 'WARNING', 'CRITICAL'], rule_level) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p) = 1""", EVENTS)  # fmt: skip
def d48_routing(spark, d):
    table_of_rules = [("error", "CRITICAL", "team-a", 1, 1), ("error", "WARNING", "team-b", 2, 2), ("click", "INFO", "team-c", 1, 3)]
    schema = "category string, rule_level string, owner string, rule_priority int, rule_id int"
    found = spark.createDataFrame(table_of_rules, schema).withColumns({"escalate_after": F.lit(50), "escalate_to": F.lit("lead")})
    return notifications.routed(_events(spark, d).withColumns({"category": F.col("event_type"), "unread_minutes": F.col("k")}), found).select("event_id", "owner", "recipient")


@query("SELECT event_id, 'Event ' || event_type || ' has k=' || k || '.' AS body FROM ev", EVENTS)
def d49_templates(spark, d):
    return table(spark, d, "events").select("event_id", notifications.filled("Event {event_type} has k={metadata.k}.").alias("body"))


@query("""SELECT event_type AS category, count(*) FILTER (delivery = 'PENDING') AS pending, count(*) FILTER (delivery = 'RETRYING') AS retrying, count(*) FILTER (delivery = 'FAILED') AS failed, count(*) FILTER (delivery = 'DEAD-LETTER') AS dead_letter,
round(count(*) FILTER (delivery IN ('FAILED', 'DEAD-LETTER')) / count(*), 6) AS error_rate FROM ev GROUP BY 1""", EVENTS)  # fmt: skip
def d50_delivery_states(spark, d):
    return notifications.delivery_report(_events(spark, d).withColumn("category", F.col("event_type")))


@query("SELECT event_id, state IN ('FAILED', 'SUCCEEDED') OR level <> 'INFO' AS eligible FROM ev", EVENTS)
def d51_eligibility(spark, d):
    return _events(spark, d).select("event_id", notifications.eligible(F.col("state"), F.col("level")).alias("eligible"))


@query("SELECT event_id, CAST(k AS VARCHAR) AS k, 1 AS n_keys FROM ev", EVENTS)
def d56_audit_metadata(spark, d):
    meta = notifications.audit_metadata(F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("Token"), F.col("props")))
    return _events(spark, d).select("event_id", meta["k"].alias("k"), F.size(meta).alias("n_keys"))


# --- preparation ---------------------------------------------------------------------------


@query("SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(k * 700 AS INTEGER) AS start, md5(substr(text, CAST(k * 700 + 1 AS BIGINT), 800)) AS body FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 100) / 700) AS BIGINT), 1))) AS k FROM documents WHERE length(text) > 0)")
def d27_chunks(spark, d):
    return preparation.chunks(table(spark, d, "documents"), "doc_id", "text").withColumn("body", F.md5("body"))


@query("SELECT id, source_id, CASE WHEN source_id = 'src6' THEN 'new' ELSE 'old' END AS run FROM raw_documents WHERE source_id <> 'src6' OR id LIKE '%6'", VIEWS)
def d28_replace_by_parent(spark, d):
    rows = raw_documents(spark, d).select("id", "source_id")
    new = rows.filter("source_id = 'src6' AND id LIKE '%6'").withColumn("run", F.lit("new"))
    return collections.replaced_by_parent(rows.withColumn("run", F.lit("old")), new, "source_id")


@query("SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 'label-' || quality ELSE 'fresh-' || lang END AS ref FROM documents d LEFT JOIN labels USING (doc_id)")
def d29_reuse(spark, d):
    existing = table(spark, d, "labels").select("doc_id", F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("ref"))
    return preparation.reused(table(spark, d, "documents"), existing, "doc_id", "ref", F.concat(F.lit("fresh-"), "lang")).select("doc_id", "ref")


@query("SELECT lang, count(*) AS n, 'AVAILABLE' AS status, array_to_string(list_sort(list(DISTINCT lang || '/' || source)), ',') AS kinds FROM documents GROUP BY 1")
def d30_by_domain(spark, d):
    return preparation.by_domain(table(spark, d, "documents"), "lang", ["lang", "source"]).withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT source AS source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def d31_repeated_plans(spark, d):
    return preparation.one_plan_each(table(spark, d, "documents"), "source", strict=False)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d33_not_yet_prepared(spark, d):
    return preparation.not_yet(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT conv_id, turn, role, count(*) OVER w AS n_before, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS chars_before, last(role) OVER w AS last_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def d38_conversation_context(spark, d):
    return preparation.conversation_context(table(spark, d, "conversations"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context FROM conversations GROUP BY 1")
def d38_serialized_conversations(spark, d):
    return preparation.serialized(table(spark, d, "conversations")).withColumn("context", F.md5("context"))


@query("SELECT id, array_to_string(tags || CASE WHEN list_contains(tags, 'tier1') THEN [] ELSE ['tier1'] END, ',') AS runs FROM sources", VIEWS)
def d52_run_ids(spark, d):
    return sources(spark, d).select("id", F.array_join(preparation.with_run_id(F.col("tags"), "tier1"), ",").alias("runs"))


@query("SELECT lang AS branch, count(*) AS n FROM documents WHERE lang IN ('de', 'es') GROUP BY 1")
def d53_branches(spark, d):
    parts = preparation.branches(table(spark, d, "documents"), "lang", ["de", "es", "zz"], needed="de")
    return preparation.appended(*[x.groupBy(F.lit(name).alias("branch")).agg(F.count("*").alias("n")) for name, x in parts.items()])


@query("SELECT event_id, 'negative' AS fault FROM events WHERE value < 0 UNION ALL SELECT event_id, 'too large' FROM events WHERE value > 100")
def d55_rejects(spark, d):
    fault = F.when(F.col("value") < 0, "negative").when(F.col("value") > 100, "too large")
    return preparation.split_failures(table(spark, d, "events"), fault)[1].select("event_id", "fault")


_PREPARED = r"""lines AS (
  SELECT doc_id, text, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM documents
), prepared AS (
  SELECT doc_id AS id, CASE WHEN length(body) = 0 THEN 'EMPTY' WHEN length(body) < 300 THEN 'NOTE' WHEN len(string_split(body, chr(10))) > 10 THEN 'REPORT' ELSE 'ARTICLE' END AS type, md5(split_part(body, chr(10), 1)) AS title,
         len(regexp_extract_all(body, '[0-9]+')) AS n_numbers, CASE WHEN length(body) > 0 THEN CAST(greatest(ceil((length(body) - 100) / 700), 1) AS BIGINT) ELSE 0 END AS n_chunks,
         CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'FAILED' ELSE 'INDEXED' END AS status FROM lines
)"""


def _request(spark, name: str) -> str:
    """The id of a request whose folder is removed when the query is finished."""
    return new_folder(spark, f"requests/{name}").rsplit("/", 1)[1]


def _prepare(spark, d, request: str, upto: str | None = None):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return preparation.run_stages(spark, request, docs, preparation.STAGES, upto)


@query("SELECT id, type, title, n_numbers, n_chunks, status FROM prepared", _PREPARED)
def d26_document_pipeline(spark, d):
    rows, _ = _prepare(spark, d, _request(spark, "d26"))
    return rows.select("id", "type", F.md5("title").alias("title"), F.col("n_numbers").cast("long").alias("n_numbers"), "n_chunks", "status")


@query("SELECT id, CASE WHEN id % 5 <> 0 THEN n_chunks ELSE 0 END AS n_points FROM prepared", _PREPARED)
def d26_upserted_chunks(spark, d):
    """Documents prepared and put into a vector index, twice; in the second run every fifth has lost its text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index = VectorIndex(spark, new_folder(spark, "index"))
    stages = [*preparation.STAGES[:-1], preparation.upserting(index, "documents"), preparation.STAGES[-1]]
    for run in range(2):
        text = F.when(F.col("id") % 5 != 0, F.col("text")) if run else F.col("text")
        preparation.run_stages(spark, _request(spark, "d26"), docs.withColumn("text", text), stages)
    points = index.points.read().groupBy(F.col("parent").cast("long").alias("id")).agg(F.count("*").alias("n"))
    return docs.select("id").join(points, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_points"))


@query("SELECT * FROM (VALUES (1, 'parse', true), (2, 'normalize', true), (3, 'classify', true), (4, 'extract', false), (5, 'chunk', false), (6, 'embed', false), (7, 'commit', false)) v(nth, stage, was_there), (SELECT count(*) AS n_indexed FROM prepared WHERE status = 'INDEXED')", _PREPARED)
def d39_resume(spark, d):
    """A run that ends after the third stage, and a second one with the same request id."""
    request = _request(spark, "d39")
    _prepare(spark, d, request, upto="classify")
    rows, log = _prepare(spark, d, request)
    n = rows.filter("status = 'INDEXED'").count()
    return spark.createDataFrame([(k + 1, name, there, n) for k, (name, there) in enumerate(log)], "nth int, stage string, was_there boolean, n_indexed bigint")


# --- retrieval -----------------------------------------------------------------------------


@query("""SELECT q.vec_id AS query_id, 'kb' || q.label AS kb, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score,
CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS INTEGER) AS rank
FROM embeddings q JOIN embeddings v ON v.label = q.label WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""")  # fmt: skip
def d34_retrieval(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("kb"), F.col("label").cast("string")).alias("kb"), F.col("embedding").alias("vector"))
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "kb", F.col("vector").alias("query_vector"))
    return retrieval.nearest(e, queries, 5)


@query("""WITH points AS (SELECT *, vec_id // 4 AS parent FROM embeddings WHERE NOT (vec_id // 4 % 5 = 0 AND vec_id % 4 = 3)), found AS (
  SELECT q.vec_id AS query_id, 'kb' || q.label AS kb, v.parent, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) DESC, CAST(v.vec_id AS VARCHAR)) AS rank
  FROM embeddings q JOIN points v ON v.label = q.label WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5
), sources AS (SELECT query_id, kb, parent, max(score) AS score, count(*) AS n FROM found GROUP BY ALL)
SELECT query_id, string_agg(parent || 'x' || n, ',' ORDER BY score DESC, kb, CAST(parent AS VARCHAR)) AS sources, max(score) AS best FROM sources GROUP BY query_id""")
def d34_index_retrieval(spark, d):
    """From a stored index, after documents have been replaced: the sources of each query's best points."""
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("parent"), F.concat(F.lit("kb"), F.col("label").cast("string")).alias("kb"), F.col("embedding").alias("vector"))
    index = VectorIndex(spark, new_folder(spark, "index"))
    replaced = F.col("parent") % 5 == 0
    index.upsert(e.withColumn("id", F.col("vec_id")).withColumn("vector", F.when(replaced, F.reverse("vector")).otherwise(F.col("vector"))))
    index.upsert(e.filter(replaced & (F.col("vec_id") % 4 != 3)).withColumn("id", F.col("vec_id")))
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "kb", F.col("vector").alias("query_vector"))
    rows = retrieval.with_sources(index.search(asked, 5))
    text = F.array_join(F.transform("sources", lambda s: F.concat(s["parent"], F.lit("x"), s["n"].cast("string"))), ",")
    return rows.select("query_id", text.alias("sources"), F.array_max(F.transform("sources", lambda s: s["score"])).alias("best"))


@query("SELECT kb FROM (SELECT DISTINCT 'kb' || lpad(CAST(label AS VARCHAR), 2, '0') AS kb, label FROM embeddings) WHERE label % 4 <> 3 AND (label % 2 = 0 OR label = 5) ORDER BY kb LIMIT 5")
def d35_candidate_bases(spark, d):
    labels = table(spark, d, "embeddings").select("label").distinct()
    bases = labels.select(F.concat(F.lit("kb"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("kb"), F.when(F.col("label") % 4 == 3, "ARCHIVED").otherwise("ACTIVE").alias("status"), F.when(F.col("label") % 2 != 0, F.col("label")).alias("owner"))
    return retrieval.candidate_bases(bases, 5).select("kb")


@query("SELECT id, CASE WHEN priority = 0 THEN 'tier1' WHEN priority = 1 THEN name ELSE array_to_string(tags, ',') END AS chosen FROM sources", VIEWS)
def d36_d37_selection(spark, d):
    listed = F.when(F.col("priority") == 0, F.array(F.lit("tier1"), F.lit("tier1"))).otherwise(F.array().cast("array<string>"))
    single = F.when(F.col("priority") == 1, F.col("name"))
    return sources(spark, d).select("id", F.array_join(retrieval.selected_bases(listed, single, F.col("tags")), ",").alias("chosen"))


# --- streams -------------------------------------------------------------------------------


def _stream(spark, d):
    return streams.read(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, max(value) AS worst FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def s01_tumbling_alarm_counts(spark, d):
    return streams.finished(streams.alarm_counts(_stream(spark, d)), ["start", "user_id"]).withColumn("start", _stamp("start"))


@query("""SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS start FROM events) GROUP BY 1, 2""")
def s02_sliding_counts(spark, d):
    return streams.finished(streams.sliding_counts(_stream(spark, d)), ["start", "event_type"]).withColumn("start", _stamp("start"))


_EPISODES = """episodes AS (SELECT min(ts) AS start, max(ts) AS last, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode FROM (
SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOURS, true) THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, episode)"""


def _by_day(spark, d, days: int) -> list[DataFrame]:
    """Events in batches of so many days."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    return [rows.filter((day >= k) & (day < k + days)) for k in range(0, 31, days)]


@query("SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, user_id, n FROM episodes WHERE last + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 2 DAYS FROM events)", _EPISODES)
def s03_sessions(spark, d):
    """As a stream of several batches: sessions that the watermark has closed, each once."""
    found = streams.sessions(streams.delivered(spark, _by_day(spark, d, 8)))
    return streams.finished(found).withColumn("start", _stamp("start"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, max(value) AS worst FROM events, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAYS AS mark FROM events WHERE event_type = 'error' AND event_id % 3 <> 0 AND ts >= TIMESTAMP '2024-01-11')
WHERE event_type = 'error' AND (event_id % 3 <> 0 AND ts >= TIMESTAMP '2024-01-11' OR (event_id % 3 = 0 OR ts < TIMESTAMP '2024-01-11') AND date_trunc('day', ts) + INTERVAL 1 DAY > mark) GROUP BY 1, 2""")
def s06_late_rows(spark, d):
    """Rows that come late: those whose day the watermark has closed are dropped.

    A batch is held to the watermark that the batch before it began with, so an empty one comes between.
    """
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    early = (F.col("event_id") % 3 != 0) & (F.col("ts") >= F.lit("2024-01-11").cast("timestamp"))
    found = streams.alarm_counts(streams.delivered(spark, [rows.filter(early), rows.limit(0), rows.filter(~early)]))
    return streams.finished(found, ["start", "user_id"]).withColumn("start", _stamp("start"))


@query("SELECT event_type, user_id FROM events GROUP BY ALL")
def s04_first_notifications(spark, d):
    found = streams.first_notifications(_stream(spark, d), ["event_type", "user_id"], "60 days")
    return streams.finished(found).select("event_type", "user_id")


@query("""SELECT user_id, max(episode) AS episode, count(*) FILTER (episode = top) AS occurrences FROM (SELECT *, max(episode) OVER (PARTITION BY user_id) AS top FROM (
SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS episode FROM (
SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 48 HOURS, true) THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type = 'error'))) GROUP BY 1""")
def s05_open_alarms(spark, d):
    """As a stream of several batches, with the state carried between them."""
    found = streams.open_alarms(streams.delivered(spark, _by_day(spark, d, 8)), 48 * 3600, watermark="60 days")
    return streams.finished(found, ["user_id"]).drop("last_seconds")


_CHANGES = """, changed AS (
  SELECT alarm_id, created_at, due_at AS due1, CASE WHEN alarm_id % 3 = 0 THEN created_at + INTERVAL 30 MINUTES END AS raised_at, created_at + INTERVAL 1 HOUR AS due2,
         CASE WHEN status IN ('RESOLVED', 'CLOSED') THEN created_at + to_hours(alarm_id % 96) END AS stopped_at FROM due
), spans AS (
  SELECT alarm_id, due1 AS due, created_at AS start, least(coalesce(raised_at, stopped_at), coalesce(stopped_at, raised_at)) AS stop FROM changed
  UNION ALL SELECT alarm_id, due2, raised_at, stopped_at FROM changed WHERE raised_at IS NOT NULL AND coalesce(stopped_at > raised_at, true)
)"""


@query("""SELECT DISTINCT alarm_id, kind, strftime(fires, '%Y-%m-%d %H:%M:%S') AS fires, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM (
SELECT alarm_id, 'reminded' AS kind, due - INTERVAL 24 HOURS AS fires, due, stop FROM spans UNION ALL SELECT alarm_id, 'escalated', due, due, stop FROM spans) WHERE coalesce(fires <= stop, true)""", EVENTS + ", " + _DUE + _CHANGES)
def s07_service_timers(spark, d):
    """Reminders and escalations as timers of a stream, in slices of time; some alarms become CRITICAL after half an hour, some are resolved or closed after hours."""
    a = _due(spark, d).select("alarm_id", "status", "created_at", "due_at")
    hours = lambda n, minutes=0: F.make_dt_interval(F.lit(0), n, F.lit(minutes))
    change = lambda ts, seq, status, due: F.struct(ts.alias("ts"), F.lit(seq).alias("seq"), status.cast("string").alias("status"), due.cast("timestamp").alias("due_at"))
    made = change(F.col("created_at"), 1, F.lit("OPEN"), F.col("due_at"))
    raised = F.when(F.col("alarm_id") % 3 == 0, change(F.col("created_at") + hours(F.lit(0), 30), 2, F.lit(None), F.col("created_at") + hours(F.lit(1))))
    ended = F.when(F.col("status") != "OPEN", change(F.col("created_at") + hours((F.col("alarm_id") % 96).cast("int")), 3, F.col("status"), F.lit(None)))
    changes = a.select("alarm_id", F.explode(F.array(made, raised, ended)).alias("c")).filter("c IS NOT NULL").select("alarm_id", "c.*")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    slices = [changes.filter((day >= k) & (day < k + 20)) for k in (0, 20)]
    tick = spark.createDataFrame([(-1, "2030-01-01 00:00:00", 1, "CLOSED", None)], "alarm_id long, ts string, seq int, status string, due_at timestamp").withColumn("ts", F.col("ts").cast("timestamp"))
    with timers.timer_state(spark):
        found = streams.finished(timers.service_timers(streams.delivered(spark, [*slices, tick]), 24 * 60))
    return found.select("alarm_id", "kind", _stamp("at").alias("fires"), _stamp("due_at").alias("due"))
