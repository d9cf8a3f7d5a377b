"""What operators of several steps share: written tables, running sums that split hot keys."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_written").rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, removed when the work it is made in is ``finished``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def finished(spark: SparkSession, name: str, work: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``work()``.  If it makes folders, they are written, and the folders removed."""
    token = _made.set([])
    try:
        out = work()
        if _made.get():
            path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
    finally:
        made = _made.get()
        _made.reset(token)
        for folder in made:
            delete_folder(spark, folder)
    return out


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later steps don't repeat it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys before this one.

    Rows are in order of (bucket, order), and buckets are summed first, so that one task has a
    key's bucket, or its buckets' sums, but not all rows of a key.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, [*keys, bucket]).withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__base")


def blocks_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))
