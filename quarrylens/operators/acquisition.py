"""From sources to documents and articles: scheduling, deduplication, routing, provenance."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import content_hash
from ..functions.text import canonical_url, normal_title
from ..schemas import RAW_DOCUMENT
from ..sources import feed
from ..sources.feed import Fetcher
from ..sources.store import Collection
from .similar import near_texts
from .steps import delete_folder, shared_folder, step

SECRETS = ("password", "api_key", "bearer_token")


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled sources whose polling interval has passed, by priority."""
    due = F.col("last_execution").isNull() | (F.col("last_execution") + F.col("polling_interval") <= now)
    return sources.filter((F.col("status") == "ENABLED") & due)


def since(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents newer than their source's high-water mark (source_id, mark); all if it has none."""
    return documents.join(marks, "source_id", "left").filter(F.col("mark").isNull() | (F.col("content_timestamp") > F.col("mark"))).drop("mark")


def acquired(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched rows of enabled sources, with the source's priority; sources are a small table."""
    enabled = sources.filter(F.col("status") == "ENABLED").select(F.col("id").alias("source_id"), "priority")
    return fetched.join(enabled, "source_id")


def fetched(spark: SparkSession, due: DataFrame, fetchers: dict[str, Fetcher], now: Column) -> DataFrame:
    """What the sources ``due`` (id, type, endpoint, mark) bring: raw documents with ``error``, written.

    Every source is a partition of its own, fetched on the executors (see ``sources.feed``).
    """
    path = f"{shared_folder(spark)}/due-{uuid.uuid4().hex}"
    due.coalesce(1).write.parquet(path)  # a row for each source
    rows = spark.read.format(feed.register(spark, fetchers)).option("due", path).load()
    rows = rows.withColumn("content_hash", content_hash(F.col("raw_content"))).withColumn("acquisition_time", now)
    rows = rows.withColumn("id", F.sha2(F.concat_ws("\x1f", "source_id", "original_uri", "content_hash"), 256)).withColumn("metadata", F.lit(None).cast("string"))
    out = step(rows.select(*RAW_DOCUMENT.names, "error"), "fetched")
    delete_folder(spark, path)
    return out


def fresh(documents: Collection, rows: DataFrame) -> DataFrame:
    """Rows whose address and content are new to the collection and to the rows before them."""
    rows = first_by(first_by(rows.dropDuplicates(["id"]), "source_id", "original_uri"), "source_id", "content_hash")
    return documents.not_held(rows)


def acquire(sources: Collection, documents: Collection, fetchers: dict[str, Fetcher], now: dt.datetime, limit: int | None = None) -> DataFrame:
    """One run: the due sources are fetched, new documents saved, and the sources' state updated.

    Due are enabled sources whose polling interval has passed and whose type has a fetcher; with a
    ``limit`` the first by priority, and the others in the runs after, as these are due later again.
    A source is asked for what is newer than its last content timestamp.  If a run dies before the
    state is saved, the next one fetches the same again and saves what is missing.  A source
    that fails keeps its mark, and is due again after its polling interval.

    Returns source_id, fetched, saved and error for every source of the run.
    """
    spark = sources.spark
    at = F.lit(now)
    seen = sources.manifest()
    due = due_sources(sources.read(seen["version"]), at).filter(F.col("type").isin(*fetchers))
    if limit is not None:
        due = due.orderBy(F.col("priority").asc_nulls_first(), F.col("name").asc_nulls_first(), "id").limit(limit)
    due = step(due, "due")
    rows = fetched(spark, due.select("id", "type", "endpoint", F.col("last_content_timestamp").alias("mark")), fetchers, at)
    saved = documents.save(fresh(documents, rows.filter("error IS NULL").drop("error")))
    found = rows.groupBy("source_id").agg(F.count_if(F.col("error").isNull()).alias("fetched"), F.max("content_timestamp").alias("__newest"), F.max("error").alias("error"))
    report = step(due.select(F.col("id").alias("source_id")).join(found, "source_id", "left").join(saved.groupBy("source_id").agg(F.count("*").alias("saved")), "source_id", "left"), "report")
    good = F.col("error").isNull()
    state = due.join(report.withColumnRenamed("source_id", "id"), "id").withColumns({
        "last_execution": at,
        "last_successful_run": F.when(good, at).otherwise(F.col("last_successful_run")),
        "last_content_timestamp": F.when(good, F.greatest("last_content_timestamp", "__newest")).otherwise(F.col("last_content_timestamp")),
    })
    sources.save(state, seen=seen)
    return report.select("source_id", F.coalesce("fetched", F.lit(0)).alias("fetched"), F.coalesce("saved", F.lit(0)).alias("saved"), "error")


def acquire_stream(sources: Collection, documents: Collection, fetchers: dict[str, Fetcher], checkpoint: str, name: str = "acquisition") -> int:
    """Reads the enabled sources as a stream up to what is there now and saves what is new.

    The stream's offsets are the sources' high-water marks, kept in ``checkpoint``.  Every batch is saved
    under its number, so that one that is run again changes nothing.  Returns the documents saved.
    """
    spark = sources.spark
    path = f"{shared_folder(spark)}/due-{uuid.uuid4().hex}"
    enabled = sources.read().filter((F.col("status") == "ENABLED") & F.col("type").isin(*fetchers))
    enabled.select("id", "type", "endpoint", F.lit(None).cast("timestamp").alias("mark")).coalesce(1).write.parquet(path)
    counts = []

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.filter("error IS NULL").withColumn("content_hash", content_hash(F.col("raw_content"))).withColumn("acquisition_time", F.current_timestamp())
        rows = rows.withColumn("id", F.sha2(F.concat_ws("\x1f", "source_id", "original_uri", "content_hash"), 256)).withColumn("metadata", F.lit(None).cast("string"))
        rows = step(rows.select(*RAW_DOCUMENT.names), "fetched")
        counts.append(documents.save(fresh(documents, rows), batch=(name, number)).count())

    stream = spark.readStream.format(feed.register(spark, fetchers)).option("due", path).load()
    run = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(save).start()
    run.awaitTermination()
    delete_folder(spark, path)
    return sum(counts)


def first_by(documents: DataFrame, *keys: str) -> DataFrame:
    """The earliest acquired document of each key, ids settle ties; whole rows, pre-aggregated."""
    rows = documents.groupBy(*keys).agg(F.min(F.struct("acquisition_time", "id")).alias("__first"))
    return documents.join(rows.select("__first.id"), "id", "left_semi")


def flagged_copies(articles: DataFrame, key: str) -> DataFrame:
    """``articles`` with ``is_duplicate``: the same key stands in an article with a smaller id."""
    first = articles.groupBy(key).agg(F.min("id").alias("__first"))
    return articles.join(first, key).withColumn("is_duplicate", F.col("id") != F.col("__first")).drop("__first")


def copies_by(df: DataFrame, key: Column) -> DataFrame:
    """key, n and first_id of every key that more than one row has."""
    return df.filter(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def url_copies(documents: DataFrame) -> DataFrame:
    return copies_by(documents, canonical_url(F.col("original_uri")))


def hash_copies(documents: DataFrame) -> DataFrame:
    return copies_by(documents, F.col("content_hash"))


def title_copies(articles: DataFrame) -> DataFrame:
    return copies_by(articles.filter(normal_title(F.col("metadata.title")) != ""), normal_title(F.col("metadata.title")))


def near_titles(articles: DataFrame, distance: int = 2) -> DataFrame:
    """article_id, class_id, n_links and nearest by normalized titles within an edit distance, in bytes."""
    title = F.decode(F.encode(normal_title(F.col("metadata.title")), "UTF-8"), "ISO-8859-1")  # a character for each byte
    return near_texts(articles.select("id", title.alias("text")), distance).withColumnRenamed("id", "article_id")


def routed(documents: DataFrame) -> DataFrame:
    """``documents`` with the parser of their MIME type; null if none takes it."""
    mime = F.lower(F.substring_index("mime_type", ";", 1))
    return documents.withColumn("parser", F.when(mime.isin("text/html", "text/plain"), "article").when(mime == "application/pdf", "document").when(mime == "application/json", "post"))


def source_state(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """``sources`` with last execution and last content from their documents."""
    state = documents.groupBy("source_id").agg(F.max("acquisition_time").alias("last_run"), F.max("content_timestamp").alias("last_content_timestamp"), F.count("*").alias("n_documents"))
    return sources.join(state.withColumnRenamed("source_id", "id"), "id", "left").withColumn("last_execution", F.greatest("last_execution", "last_run"))


def traced(articles: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with their raw document and source; articles without one stay, with nulls."""
    docs = documents.select(F.col("id").alias("raw_document_id"), "source_id", "original_uri", "content_hash", "acquisition_time")
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"), F.col("priority").alias("source_priority"))
    return articles.join(docs, "raw_document_id", "left").join(names, "source_id", "left")


def flat_claims(articles: DataFrame) -> DataFrame:
    """One row for each evidence of each claim; claims without evidence have nulls."""
    claims = articles.select(F.col("id").alias("article_id"), F.explode("claims").alias("claim"))
    rows = claims.select("article_id", "claim", F.explode_outer("claim.evidence").alias("evidence"))
    return rows.select(
        "article_id", F.col("claim.id").alias("claim_id"), F.col("claim.type").alias("claim_type"), F.col("claim.confidence").alias("claim_confidence"),
        F.col("claim.source_entity_id").alias("source_entity_id"), F.col("evidence.id").alias("evidence_id"), F.col("evidence.type").alias("evidence_type"), F.col("evidence.confidence").alias("evidence_confidence"),
    )


def masked(sources: DataFrame) -> DataFrame:
    """``sources`` with credentials replaced, for display."""
    hide = lambda name: F.when(F.col(f"authentication.{name}").isNotNull(), "***").alias(name)
    fields = [hide(f.name) if f.name in SECRETS else F.col(f"authentication.{f.name}").alias(f.name) for f in sources.schema["authentication"].dataType.fields]
    return sources.withColumn("authentication", F.struct(*fields))


def taxonomy_rollup(articles: DataFrame) -> DataFrame:
    """Counts by domain, sub_domain and event_type, with subtotals."""
    return articles.select("taxonomy.domain", "taxonomy.sub_domain", "taxonomy.event_type").rollup("domain", "sub_domain", "event_type").agg(F.count("*").alias("n"))


def mime_summary(documents: DataFrame) -> DataFrame:
    return documents.groupBy("mime_type").agg(F.count("*").alias("n"), F.min("acquisition_time").alias("first"), F.max("acquisition_time").alias("last"), F.sum(F.length("raw_content")).alias("size"))


def latest_per_source(documents: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` documents of every source."""
    order = Window.partitionBy("source_id").orderBy(F.desc("content_timestamp"), F.desc("acquisition_time"), "id")
    return documents.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
