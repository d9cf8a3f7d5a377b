"""Incremental forms of alarm, notification and acquisition operators.

Each takes a streaming DataFrame and returns one; ``finished`` runs a stream over what is there
now and returns what it wrote.  State is bounded by watermarks.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.steps import blocks_for, exists, new_folder

FILE_ROWS = 1_000_000  # of a batch that one task writes
USER_BUCKETS = 1024  # of open alarms; fixed for the life of a stream


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder or file of Parquet as a stream, with the schema it has now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # streams read folders
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def delivered(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    """A stream that brings ``batches`` one after the other, each a micro-batch of its own.

    A batch is written by as many tasks as FILE_ROWS asks for, the largest decides; every batch
    is filled up to that number of files with empty ones, so that a trigger takes just one batch.
    """
    folder = new_folder(spark, "arriving")
    files = max([blocks_for(batch.count(), FILE_ROWS) for batch in batches], default=1)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    written = lambda: sum(s.getPath().getName().startswith("part-") for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    for number, batch in enumerate(batches):
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(folder)
        for _ in range(files * (number + 1) - written()):
            spark.createDataFrame([], batch.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)  # files are taken in order of their times
    return read(spark, folder, files_per_batch=files)


def finished(stream: DataFrame, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs ``stream`` over all that is there and returns its rows.

    With ``keys``, the stream updates: the last row of each key counts.  Given a checkpoint of
    an earlier run, only what is new is read.
    """
    spark = stream.sparkSession
    out = new_folder(spark, "stream")
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    writer = stream.writeStream.outputMode("update" if keys else "append").trigger(availableNow=True)
    run = writer.option("checkpointLocation", checkpoint or f"{out}/checkpoint").foreachBatch(keep).start()
    run.awaitTermination()
    if not exists(spark, f"{out}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch")
    if keys:
        last = Window.partitionBy(*keys).orderBy(F.desc("__batch"))
        rows = rows.withColumn("__nth", F.row_number().over(last)).filter("__nth = 1")
    return rows.select(*schema.names)


def alarm_counts(events: DataFrame, window: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """Occurrences of each user's alarm in tumbling windows."""
    errors = events.filter("event_type = 'error'").withWatermark("ts", watermark)
    return errors.groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("worst")).select(F.col("window.start").alias("start"), "user_id", "n", "worst")


def sliding_counts(events: DataFrame, window: str = "1 day", slide: str = "12 hours", watermark: str = "2 days") -> DataFrame:
    late = events.withWatermark("ts", watermark)
    return late.groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", watermark: str = "2 days") -> DataFrame:
    """Episodes of activity of each user, closed by a quiet gap."""
    late = events.withWatermark("ts", watermark)
    return late.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), "user_id", "n")


def first_notifications(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    """One notification for each key while the watermark holds it."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def new_documents(documents: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Documents whose (source_id, content_hash) wasn't seen within the watermark."""
    return documents.withWatermark("content_timestamp", watermark).dropDuplicatesWithinWatermark(["source_id", "content_hash"])


def open_alarms(events: DataFrame, gap_seconds: int, watermark: str = "2 days") -> DataFrame:
    """Stateful alarm deduplication: user_id, episode, occurrences and last time so far.

    An event after a quiet gap opens the next episode.  Events of a micro-batch are taken in order
    of time; one that comes later than the watermark allows is dropped, and one that comes in a
    later batch than its successors joins the episode that is open, as its alarm isn't closed.  The
    state is five numbers for a user, and goes when the watermark has passed the last event by
    the gap (the next event begins with episode 1 again).  Users are dealt to USER_BUCKETS by
    hash and a bucket's are worked on together: a call and a stored row for each user cost
    far more than its events.
    """

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("user", "episode", "count", "last", "until")
        known = pd.DataFrame({c: np.frombuffer(x, "float64" if c == "last" else "int64") for c, x in zip(names, state.get)}) if state.exists else pd.DataFrame({c: np.array([], "float64" if c == "last" else "int64") for c in names})
        mark, out = state.getCurrentWatermarkMs(), None
        if not state.hasTimedOut:
            rows = pd.concat(list(parts), ignore_index=True).sort_values(["user_id", "seconds"], kind="stable")
            of, seconds = rows["user_id"].to_numpy("int64"), rows["seconds"].to_numpy("float64")
            user, first, size = np.unique(of, return_index=True, return_counts=True)
            own = known.set_index("user").reindex(user)
            last = own["last"].fillna(float("-inf")).to_numpy()
            before = np.r_[float("-inf"), seconds[:-1]]
            before[first] = last
            fresh = seconds - np.maximum(before, np.repeat(last, size)) > gap_seconds
            newest = np.maximum.reduceat(np.where(fresh, np.arange(len(of)), -1), first)
            count = np.where(newest >= 0, first + size - newest, own["count"].fillna(0).to_numpy("int64") + size)
            episode = own["episode"].fillna(0).to_numpy("int64") + np.add.reduceat(fresh.astype("int64"), first)
            last = np.maximum(last, seconds[first + size - 1])
            until = np.maximum(((last + gap_seconds) * 1000).astype("int64"), mark + 1)
            now = pd.DataFrame({"user": user, "episode": episode, "count": count, "last": last, "until": until})
            known = pd.concat([known[~known["user"].isin(user)], now], ignore_index=True) if len(known) else now
            out = pd.DataFrame({"user_id": pd.array([None] * len(user), "Int64") if key[0] < 0 else user, "episode": episode, "occurrences": count, "last_seconds": last})
        known = known[known["until"] >= mark]
        if len(known):
            state.update(tuple(known[c].to_numpy().tobytes() for c in names))
            state.setTimeoutTimestamp(max(int(known["until"].min()), mark + 1))
        else:
            state.remove()
        if out is not None:
            yield out

    rows = events.filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS))).cast("int")
    rows = rows.select(bucket.alias("bucket"), F.coalesce("user_id", F.lit(0)).alias("user_id"), "ts", (F.unix_micros("ts").cast("double") / 1e6).alias("seconds"))
    kept = "user binary, episode binary, count binary, last binary, until binary"  # an array each, a number for each user
    return rows.groupBy("bucket").applyInPandasWithState(follow, "user_id bigint, episode bigint, occurrences bigint, last_seconds double", kept, "update", GroupStateTimeout.EventTimeTimeout)
