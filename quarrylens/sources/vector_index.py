"""A stored index of vectors: cells around centroids, searched exactly by bounds on angles.

Points (id, kb, parent, vector) are kept as a collection, in a folder for each cell of each knowledge base.
A document's points are replaced as a whole (delete-then-insert by ``parent``), so indexing it again
leaves no old chunk behind.  Centroids are fitted once, on at most SAMPLE points chosen by hash;
every point is indexed, whenever it comes.

A point x in the cell around c has an angle to it; for a query q, the angle between q and x is at
least |angle(q, c) - angle(x, c)|.  With the least and greatest angle of a cell, that bounds what any
point in it can score.  A search visits the cells with the best bounds until they hold ``k`` points;
then all others whose bound isn't below the k-th best score so far.  So nothing is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieval import nearest, usable
from ..operators.steps import exists, step
from .store import FOLDERS, SORTED_BY, Collection

SAMPLE = 16_384
MOST_CELLS = 256
ROUNDS = 10
SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kb", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("place", T.StringType()),
    T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType())),
])
FOLDERS["points"] = ("by_place", "place")
SORTED_BY["points"] = ("angle",)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of unit rows; the first centroids are rows far from one another."""
    centers = [x[0]]
    close = x @ x[0]
    for _ in range(cells - 1):
        centers.append(x[int(close.argmin())])
        close = np.maximum(close, x @ centers[-1])
    c = np.array(centers)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        c = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-12)[:, None], c)
    return c


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, **more):
        self.spark, self.root = spark, root.rstrip("/")
        self.points = Collection(spark, self.root, "points", SCHEMA, unique=[], **more)

    def fit(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Centroids for vectors like those of ``vectors`` (id, vector), of their commonest length; once, before
        the first points."""

        def fitted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [p for p in parts if len(p)]
            if rows:
                vectors = pd.concat(rows).sort_values("id")["vector"]
                lengths = vectors.map(len)
                x = _unit(vectors[lengths == lengths.mode().min()])
                c = _centroids(x, min(len(x), cells or max(1, min(MOST_CELLS, math.isqrt(len(x))))))
                yield pd.DataFrame({"cell": range(len(c)), "center": c.tolist()})

        good = vectors.filter(usable(F.col("vector"))).select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        some = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).repartition(1)
        some.mapInPandas(fitted, "cell int, center array<double>").coalesce(1).write.parquet(f"{self.root}/centroids")

    def _centers(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.root}/centroids").collect())  # MOST_CELLS at most
        return np.array([r["center"] for r in rows], np.float64)

    def upsert(self, points: DataFrame) -> int:
        """Replaces all points of the parents of ``points`` (id, kb, parent, vector).

        Vectors without a direction, or of another length than the centroids, aren't indexed.
        Returns how many points were.
        """
        if not exists(self.spark, f"{self.root}/centroids"):
            self.fit(points)
        centers = self._centers()

        def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    products = _unit(part["vector"]) @ centers.T
                    cell = products.argmax(1)
                    yield part.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(products[np.arange(len(part)), cell], -1, 1)))

        rows = points.select(F.col("id").cast("string").alias("id"), "kb", F.col("parent").cast("string").alias("parent"), F.col("vector").cast("array<double>").alias("vector"))
        good = usable(F.col("vector")) & (F.size("vector") == (centers.shape[1] if len(centers) else -1))
        kept = rows.filter(good).mapInPandas(placed, "id string, kb string, parent string, vector array<double>, cell int, angle double")
        kept = kept.withColumn("place", F.concat_ws("/", "kb", F.col("cell").cast("string")))
        return self.points.replace_children(kept.select(*SCHEMA.names), "parent", rows.select("parent")).count()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, kb, id, parent, score and rank: the ``k`` best points of each query's knowledge base.

        queries: query_id, kb, query_vector.  Exact; equal scores (to 9 digits) by id.
        """
        centers = self._centers()
        length = centers.shape[1] if len(centers) else -1
        asked = queries.filter(usable(F.col("query_vector")) & (F.size("query_vector") == length)).select("query_id", "kb", F.col("query_vector").cast("array<double>").alias("query_vector"))
        kind = asked.schema["query_id"].dataType.simpleString()

        def angles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    found = np.arccos(np.clip(_unit(part["query_vector"]) @ centers.T, -1, 1))
                    yield part[["query_id", "kb"]].assign(angles=found.tolist())

        rows = self.points.read()
        cells = step(rows.groupBy("kb", "cell", "place").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")), "index-cells")
        seen = asked.mapInPandas(angles, f"query_id {kind}, kb string, angles array<double>").join(cells, "kb")
        apart = F.get("angles", "cell")
        seen = seen.withColumn("bound", F.cos(F.greatest(apart - F.col("high"), F.col("low") - apart, F.lit(0.0))))
        order = Window.partitionBy("query_id", "kb").orderBy(F.desc("bound"), "cell")
        before = F.sum("n").over(order) - F.col("n")
        seen = step(seen.select("query_id", "kb", "place", "n", "bound", (before < k).alias("first")), "index-bounds")

        def visit(pairs: DataFrame) -> DataFrame:
            meant = pairs.join(asked, ["query_id", "kb"]).select("query_id", F.col("place").alias("kb"), "query_vector")
            return step(nearest(rows.select(F.col("place").alias("kb"), F.col("id").alias("vec_id"), "vector"), meant, k).select("query_id", F.col("kb").alias("place"), F.col("vec_id").alias("id"), "score"), "index-found")

        found = visit(seen.filter("first"))
        base = lambda df: df.withColumn("kb", F.regexp_replace("place", "/[0-9]+$", ""))
        nth = F.row_number().over(Window.partitionBy("query_id", "kb").orderBy(F.desc("score"), "id"))
        least = base(found).withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", "kb", F.col("score").alias("least"))
        rest = seen.filter("NOT first").join(least, ["query_id", "kb"], "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8))
        rest = step(rest, "index-rest")
        #: of the last search: what the bounds let in, of all pairs of a query and a point of its base
        self.last_read = (seen.filter("first").select("n").unionByName(rest.select("n")).agg(F.sum("n")).first()[0] or 0) / max(1, seen.agg(F.sum("n")).first()[0] or 0)
        best = base(found.unionByName(visit(rest))).withColumn("rank", nth).filter(F.col("rank") <= k)
        return best.join(rows.select("id", "parent"), "id").select("query_id", "kb", "id", "parent", "score", "rank")
