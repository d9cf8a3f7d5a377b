"""Retrieval over article vectors: knowledge bases, nearest vectors, close vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import blocks_for, step

MAX_BASES = 5
BLOCK_ROWS, SLICE = 4096, 256  # rows of a block, and of it multiplied at a time


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def candidate_bases(bases: DataFrame, user, cap: int = MAX_BASES) -> DataFrame:
    """Active knowledge bases, global or the user's own, at most ``cap``."""
    return bases.filter((F.col("status") == "ACTIVE") & (F.col("owner").isNull() | (F.col("owner") == F.lit(user)))).orderBy("kb").limit(cap)


def selected_bases(listed: Column, single: Column, accessible: Column) -> Column:
    """The list if one is given, else the single one, else all accessible; repeats dropped in order."""
    some = F.when(F.size(listed) > 0, listed)
    return F.array_distinct(F.coalesce(some, F.when(single.isNotNull(), F.array(single)), accessible))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, empty or zero, no null or non-finite component."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors of each query in each knowledge base, exact; ties by id.

    A stated set of queries (query_id, kb, query_vector) meets the vectors of its knowledge base
    in blocks of BLOCK_ROWS of either side, however large the base is; a block returns its best
    ``k`` for each query, and these are ranked.
    """
    rows = vectors.filter(usable(F.col("vector"))).select("kb", "vec_id", F.col("vector").cast("array<double>").alias("v"))
    asked = queries.filter(usable(F.col("query_vector"))).select("kb", F.col("query_id").alias("id"), F.col("query_vector").cast("array<double>").alias("v"))
    parts = lambda df, name: df.groupBy("kb").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias(name))
    both = parts(rows, "n").join(parts(asked, "m"), "kb")  # one row for each base
    deal = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = rows.schema["vec_id"].dataType.simpleString()
    q_kind = asked.schema["id"].dataType.simpleString()
    left = rows.join(both, "kb").select("kb", F.size("v").alias("length"), deal("vec_id", "n").alias("i"), every("m").alias("j"), "vec_id", F.lit(None).cast(q_kind).alias("id"), "v")
    right = asked.join(both, "kb").select("kb", F.size("v").alias("length"), every("n").alias("i"), deal("id", "m").alias("j"), F.lit(None).cast(kind).alias("vec_id"), "id", "v")

    def best(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["id"].isna()], part[part["vec_id"].isna()]
        out = [pd.DataFrame([], columns=["kb", "query_id", "vec_id", "score"])]
        if len(a) and len(b):
            y, ids = _matrix(a["v"]), a["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")  # columns by id, for ties
            y, ids, few = y[order], ids[order], min(k, len(a))
            for n in range(0, len(b), SLICE):
                some = b.iloc[n : n + SLICE]
                scores = np.round(_matrix(some["v"]) @ y.T, 9)
                least = -np.partition(-scores, few - 1, axis=1)[:, few - 1]
                query, at = np.nonzero(scores >= least[:, None])  # ``few`` of each query, and ties of the last
                score = scores[query, at]
                by = np.lexsort((at, -score, query))
                query, at, score = query[by], at[by], score[by]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                top = rank < few
                out.append(pd.DataFrame({"kb": part["kb"].iloc[0], "query_id": some["id"].to_numpy()[query[top]], "vec_id": ids[at[top]], "score": score[top]}))
        return pd.concat(out[1:] or out)

    found = left.unionByName(right).groupBy("kb", "length", "i", "j").applyInPandas(best, f"kb string, query_id {q_kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id", "kb").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "kb", "vec_id", "score", "rank")


def with_sources(found: DataFrame) -> DataFrame:
    """query_id and sources: the documents (kb, parent, score, n) that a query's points are from, over all of
    its knowledge bases, each once, with its best score and its number of points, best first."""
    each = found.groupBy("query_id", "kb", "parent").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    rows = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "kb", "parent", "score", "n"))).alias("sources"))
    return rows.select("query_id", F.transform("sources", lambda x: F.struct(x["kb"].alias("kb"), x["parent"].alias("parent"), x["score"].alias("score"), x["n"].alias("n"))).alias("sources"))


def close_vectors(vectors: DataFrame, least: float) -> DataFrame:
    """vec_id, n_close and best_cosine: other rows with a cosine of ``least`` or more, exact.

    Rows are dealt to blocks by hash and every two blocks are multiplied, so a task holds two
    blocks at most and returns a count and a maximum for each row, never pairs.  At so low a
    cosine no cells or buckets rule out anything, so the work grows with the square of the rows.
    Null, zero and non-finite vectors have none, nor have different lengths.
    """
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", F.monotonically_increasing_id().alias("row"), F.col("embedding").cast("array<double>").alias("v"))
    rows = step(rows, "vectors-usable")
    blocks = blocks_for(rows.count(), BLOCK_ROWS)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("other", every)
    dealt = dealt.select(F.size("v").alias("n"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "v")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        a, b = part[part["own"] == i], part[part["own"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"row": np.array([], "int64"), "n_close": np.array([], "int64"), "best": np.array([])})
        x = _matrix(a["v"])
        y = x if i == j else _matrix(b["v"])
        near, best = (np.zeros(len(a), "int64"), np.zeros(len(b), "int64")), (np.full(len(a), -2.0), np.full(len(b), -2.0))
        for k in range(0, len(a), SLICE):
            products = x[k : k + SLICE] @ y.T
            if i == j:
                at = np.arange(len(products))
                products[at, k + at] = -2  # itself
            # rounding is monotone: only what could be rounded up to the bound needs it
            close = products >= least - 1e-6
            r, c = np.nonzero(close & (products < least + 1e-6))
            close[r, c] = np.round(products[r, c], 6) >= least
            near[0][k : k + SLICE] = close.sum(1)
            best[0][k : k + SLICE] = products.max(1)
            if i != j:  # the same products serve the rows of the other block
                near[1][:] += close.sum(0)
                np.maximum(best[1], products.max(0), out=best[1])
        out = []
        for ids, n, top in [(a, near[0], best[0]), (b, near[1], best[1])][: 1 if i == j else 2]:
            out.append(pd.DataFrame({"row": ids["row"].to_numpy()[n > 0], "n_close": n[n > 0], "best": np.round(top[n > 0], 6)}))
        return pd.concat(out).astype({"row": "int64", "n_close": "int64", "best": "float64"})

    pairs = blocks * (blocks + 1) // 2
    found = dealt.repartition(min(pairs, 10_000), "n", "i", "j").groupBy("n", "i", "j").applyInPandas(compare, "row bigint, n_close bigint, best double")
    found = rows.select("row", "vec_id").join(found.groupBy("row").agg(F.sum("n_close").alias("n_close"), F.max("best").alias("best_cosine")), "row")
    none = vectors.filter(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_close"), F.lit(None).cast("double").alias("best_cosine"))
    alone = rows.join(found.select("row"), "row", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_close"), F.lit(None).cast("double").alias("best_cosine"))
    return found.select("vec_id", "n_close", "best_cosine").unionByName(alone).unionByName(none)
