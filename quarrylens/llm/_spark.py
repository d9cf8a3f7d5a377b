"""Helpers that several operators share: written tables and their removal, running totals, components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BUCKET_BYTES = 64 << 20  # of text in a bucket of a bucketed table, about
MAX_BUCKETS = 100_000  # Spark's own limit
_made: ContextVar[list[tuple[str, str]] | None] = ContextVar("_made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_written"
    return folder.rstrip("/")


def _note(kind: str, name: str) -> str:
    made = _made.get()
    if made is not None:
        made.append((kind, name))
    return name


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what ``written`` and ``bucketed`` make inside, at the end."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for kind, name in made:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finished(spark: SparkSession, name: str, work: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``work()``, written, with every intermediate table of it removed."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        out = work()
        out.write.parquet(path)
    _note("folder", path)
    return spark.read.schema(out.schema).parquet(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the other intermediate tables."""
    return _note("folder", f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts lineage: what reads it later doesn't depend on any executor's local files.
    """
    return written_to(df, fresh_folder(df.sparkSession, name), codec)


def written_to(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to ``path`` and read back."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str, n_bytes: int) -> DataFrame:
    """``df``, of about ``n_bytes``, written as a table bucketed by ``column`` and read back.

    Later joins and groups on that column leave its rows where they are.  Rows are brought to
    their bucket first, so a bucket is one file; buckets hold BUCKET_BYTES at any size of table.
    """
    spark = df.sparkSession
    table = _note("table", f"{name}_{uuid.uuid4().hex}")
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (BUCKET_BYTES // 8)))
    buckets = max(8, few, min(MAX_BUCKETS, -(-n_bytes // BUCKET_BYTES)))
    df.repartition(buckets, column).write.option("compression", "zstd").bucketBy(buckets, column).saveAsTable(table)
    return spark.table(table)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def text_column(docs: DataFrame, name: str = "text") -> Column:
    """The text of a row as a string that is never null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def level_size(rows: int) -> int:
    """Buckets for two-level totals: about as many as a bucket has rows."""
    return max(16, math.isqrt(max(rows, 1)))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are in order of (bucket, order).  Buckets are summed first, so neither level ever has
    more rows in one task than a bucket or than there are buckets.  ``group`` and ``bucket``
    must not be null.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy(bucket) if group else Window.orderBy(bucket)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, [*group, bucket])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_base")
    )


HOT = 512  # a node with more than this part of all edge ends is joined by broadcast


def _star_forest(edges: DataFrame) -> tuple[bool, int]:
    """Whether every edge runs from a root to a node of no other edge; and the number of edges."""
    ends = edges.select(F.col("a").alias("x"), F.lit(0).alias("n")).union(edges.select(F.col("b").alias("x"), F.lit(1).alias("n")))
    nodes = ends.groupBy("x").agg(F.count("*").alias("all"), F.sum("n").alias("low"))
    loose, n = nodes.agg(F.count_if((F.col("low") > 0) & (F.col("all") > 1)), F.sum("low")).first()
    return loose == 0, n or 0


def _attached(rows: DataFrame, low: DataFrame, least: int) -> DataFrame:
    """``rows`` with ``m`` of their node ``a``.  Nodes of ``least`` rows or more, of which there
    are few, are broadcast, so that no task gets all rows of one node."""
    hot = F.broadcast(low.filter(F.col("n") >= least).select("a", "m"))
    usual = rows.join(hot.select("a"), "a", "left_anti").join(low.filter(F.col("n") < least).select("a", "m"), "a")
    return rows.join(hot, "a").unionByName(usual)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (id, component).

    The component is its smallest id; ids without an edge aren't in the result.  Alternates
    large-star and small-star steps, each a grouped minimum and a join, until the edges are
    stars around the smallest ids; every round's edges are written to the shared folder.  A node
    with very many neighbours is pre-aggregated in the minimum and broadcast in the join: at
    most 2 * HOT nodes have so many.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    for _ in range(max_rounds):
        settled, n = _star_forest(now)
        if settled:
            break
        least = max(1024, n // HOT)
        # large star: every larger neighbour of a node goes to the smallest of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _attached(both.filter("b > a"), low, least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, name)
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _attached(large, low, least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("x"), "m")
        own = low.select(F.col("a").alias("x"), "m")
        now = written(small.union(own).select(F.col("m").alias("a"), F.col("x").alias("b")).filter("a < b").distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("component"))
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)
