"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

1.  Equal vectors form a class; one row with a count stands for them.
2.  Spherical k-means is fitted by a task on a bounded sample (``sample`` classes, chosen by
    hash); the number of cells is bounded by the root of the table and by ``max_cells``, so the centroids
    that every task gets are bounded too.  Centroids within the link angle are merged, so that a
    hot group isn't cut into cells that all visit each other.
3.  Every class has its home in the nearest cell and visits every cell where a vector linked
    with it can have its home: for a row x, its home's centroid h and another c, none can if
    x * (h - c) > sin(link angle) * |h - c|.  So no link is lost, whatever the centroids are.
4.  The rows at home in a cell are compared with everything there, in blocks of rows; a crowded
    cell becomes many tasks.  A task returns sums and spanning links, never pairs.  Both sides
    of a link meet in both homes, and each side counts it in its own.
5.  Components of the links give the groups; the smallest id of each is kept.

Vectors spread over many dimensions leave little that the cells can rule out.  The number of
cells is therefore chosen by the copies and comparisons they would cost, estimated on the
sample; where nothing can be ruled out, that is one cell with all pairs of its blocks.

Defined results
    null, zero, null or non-finite components   n_links 0, a component of its own, kept
    different lengths                           linked with nothing of another length
    repeated rows                               linked with each other
    ties                                        a cosine of just the threshold links; the least id of a group is kept
    very long vectors                           one row each, held whole
    repeated vec_id                             one node, with the links of all its rows; counts by row
    null vec_id                                 counted by others, component_id null, kept
    empty table                                 no rows
    other columns                               ignored.  vec_id is a whole number
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, written

COSINE = 0.9
SAMPLE = 16384
MAX_CELLS = 4096
ROUNDS = 12
HOME_BLOCK, VISIT_BLOCK = 8192, 16384
SLICE = 256  # rows of a block multiplied at a time
MAX_TASKS = 20_000
COPY = 500  # a moved row costs about as much as so many comparisons


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, key (null if the vector can't link) and the vector as doubles in bytes."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = [], []
            for x in batch.column(1).to_pylist():
                key = body = None
                if x is not None and len(x) and None not in x:
                    v = np.array(x, np.float64) + 0.0  # no negative zeros
                    with np.errstate(over="ignore"):
                        if np.isfinite(v).all() and v.any():
                            scale = np.abs(v).max()
                            body = v.tobytes() if 1e-100 < scale < 1e100 else (v / scale).tobytes()
                            key = hashlib.blake2b(body, digest_size=16).hexdigest()
                keys.append(key)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(bodies, pa.binary())], ["vec_id", "key", "body"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(check, f"vec_id {kind}, key string, body binary")


def spherical_k_means(x: np.ndarray, cells: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows ``x``; empty cells restart at the worst-placed rows."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own, best = np.empty(len(x), np.int64), np.empty(len(x))
        for k in range(0, len(x), SLICE):  # so that products stay small
            products = x[k : k + SLICE] @ centers.T
            own[k : k + SLICE], best[k : k + SLICE] = products.argmax(1), products.max(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norms < 1e-9)
        if len(empty):
            sums[empty] = x[np.argsort(best)[: len(empty)]]
            norms = np.linalg.norm(sums, axis=1)
        centers = sums / np.maximum(norms, 1e-12)[:, None]
    return centers


def _matrix(bodies: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), np.float64).reshape(len(bodies), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _packed(body: bytes) -> bytes:
    """Half the bytes, if single precision holds the same vector."""
    x = np.frombuffer(body, np.float64)
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if np.array_equal(short, x) else body


def _unpacked(bodies: pd.Series, length: int) -> np.ndarray:
    whole = [x if len(x) == length else np.frombuffer(x, np.float32).astype(np.float64).tobytes() for x in bodies]
    return np.frombuffer(b"".join(whole), np.float64).reshape(len(bodies), -1)


def _merged(centers: np.ndarray, cosine: float) -> np.ndarray:
    """Centroids none of which is within the link angle of an earlier one."""
    kept = []
    for k in range(len(centers)):
        if not kept or (centers[kept] @ centers[k]).max() < cosine:
            kept.append(k)
    return centers[kept]


def reached(x: np.ndarray, centers: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each unit row, and which cells can be the home of a vector linked with it."""
    products = x @ centers.T
    home = products.argmax(1)
    if cosine <= 0:
        return home, np.ones(products.shape, bool)
    between = np.sqrt(np.maximum(((centers**2).sum(1)[home][:, None] + (centers**2).sum(1)[None, :]) - 2 * (centers[home] @ centers.T), 0))
    reach = math.sqrt(max(0.0, 1 - min(cosine, 1.0) ** 2))
    cells = products.max(1)[:, None] - products <= reach * between + 1e-7
    cells[np.arange(len(x)), home] = True
    return home, cells


def _cost(x: np.ndarray, centers: np.ndarray, n: int, cosine: float) -> float:
    """What ``n`` rows like the sample ``x`` cost with these cells, in comparisons."""
    own, every = np.zeros(len(centers)), np.zeros(len(centers))
    for k in range(0, len(x), SLICE):
        home, cells = reached(x[k : k + SLICE], centers, cosine)
        own += np.bincount(home, minlength=len(centers))
        every += cells.sum(0)
    own, every = own * (n / len(x)), every * (n / len(x))
    copies = (every * np.ceil(own / HOME_BLOCK) + own * np.ceil(every / VISIT_BLOCK)).sum()
    return float(COPY * copies + (own * every).sum())


def _fitted(classes: DataFrame, cosine: float, sample: int, max_cells: int) -> dict[int, np.ndarray]:
    """Centroids for each vector length (a length is its number of bytes), fitted by one task
    for each length, on at most ``sample`` rows."""
    out = {}
    for length, n in classes.groupBy(F.length("body").alias("length")).agg(F.count("*").alias("n")).collect():

        def fit(parts: Iterator[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(parts)).sort_values("key")
            x = _unit(_matrix(rows["body"]))
            most = max(1, min(math.isqrt(n), max_cells, len(x) // 4))
            tried = [_merged(spherical_k_means(x, k, ROUNDS), cosine) for k in sorted({max(1, most >> d) for d in (0, 3, 6, 12)})]
            best = min(tried, key=lambda c: _cost(x, c, n, cosine))
            yield pd.DataFrame({"cells": [len(best)], "centers": [best.tobytes()]})

        rows = classes.filter(F.length("body") == length).select("key", "body").orderBy("key").limit(sample)
        found = rows.repartition(1).mapInPandas(fit, "cells int, centers binary").first()
        out[length] = np.frombuffer(bytes(found["centers"]), np.float64).reshape(found["cells"], -1)
    return out


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, max_cells: int = MAX_CELLS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    rows = written(usable(vectors), "vectors-rows")
    good = rows.filter("key IS NOT NULL")
    classes = good.groupBy("key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight"), F.first("body").alias("body"))
    classes = written(classes, "vectors-classes")
    centers = _fitted(classes, cosine, sample, max_cells)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for length, same in part.groupby(part["body"].map(len)):
                for k in range(0, len(same), SLICE):
                    some = same.iloc[k : k + SLICE]
                    home, cells = reached(_unit(_matrix(some["body"])), centers[length], cosine)
                    yield some.assign(body=some["body"].map(_packed), length=length, home=home.astype(np.int32), visits=[np.flatnonzero(c).astype(np.int32) for c in cells])

    kind = classes.schema["class_id"].dataType.simpleString()
    placed = classes.mapInPandas(place, f"key string, class_id {kind}, weight bigint, body binary, length int, home int, visits array<int>")
    placed = written(placed, "vectors-placed")
    visits = placed.withColumn("cell", F.explode("visits")).drop("visits")
    count = visits.groupBy("length", "cell").agg(F.count("*").alias("all"), F.count_if(F.col("cell") == F.col("home")).alias("own"))
    count = count.filter("own > 0").select(
        "length", "cell", F.ceil(F.col("own") / F.lit(HOME_BLOCK)).cast("int").alias("own_blocks"), F.ceil(F.col("all") / F.lit(VISIT_BLOCK)).cast("int").alias("all_blocks")
    )
    # a row at home is compared as one side in its own block, and everything there as the other
    at = visits.join(count, ["length", "cell"])
    n = lambda blocks: F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    keep = ["key", "class_id", "weight", "body"]
    one = at.filter("cell = home").select("length", "cell", n("own_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(True).alias("is_row"), *keep)
    two = at.select("length", "cell", every("own_blocks").alias("i"), n("all_blocks").alias("j"), F.lit(False).alias("is_row"), *keep)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        length = part["length"].iloc[0]
        a, b = part[part["is_row"]], part[~part["is_row"]]
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["key", "links", "a", "b"])
        x, y = _unpacked(a["body"], length), _unpacked(b["body"], length)
        norms_a, norms_b, weights = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), b["weight"].to_numpy()
        place_b = {key: c for c, key in enumerate(b["key"])}
        own = [place_b.get(key, -1) for key in a["key"]]
        linked, links = np.zeros((len(a), len(b)), bool), np.zeros(len(a), np.int64)
        for k in range(0, len(a), SLICE):
            some = slice(k, k + SLICE)
            linked[some] = (x[some] @ y.T) / (norms_a[some, None] * norms_b[None, :]) >= cosine
            for r, c in enumerate(own[some], k):
                if c >= 0:
                    linked[r, c] = False
            links[some] = [weights[row].sum() for row in linked[some]]
        counts = pd.DataFrame({"key": a["key"], "links": links}).query("links > 0")
        ids_a, ids_b = a["class_id"].to_numpy(), b["class_id"].to_numpy()
        ties, open_a, seen_b = [], links > 0, np.zeros(len(b), bool)
        for start in np.flatnonzero(open_a):  # spanning links of the two sides
            if not open_a[start]:
                continue
            open_a[start], reach = False, [start]
            while reach:
                r = reach.pop()
                for c in np.flatnonzero(linked[r] & ~seen_b):
                    seen_b[c] = True
                    ties.append((ids_a[r], ids_b[c]))
                    for q in np.flatnonzero(linked[:, c] & open_a):
                        open_a[q] = False
                        ties.append((ids_a[q], ids_b[c]))
                        reach.append(int(q))
        ties = pd.DataFrame(ties, columns=["a", "b"]).dropna()
        return pd.concat([counts, ties]).astype({"links": "Int64", "a": "Int64", "b": "Int64"})

    units = count.agg(F.sum(F.col("own_blocks").cast("long") * F.col("all_blocks"))).first()[0] or 1
    dealt = one.union(two).repartition(min(units, MAX_TASKS), "length", "cell", "i", "j")  # work is in products, not in bytes
    found = dealt.groupBy("length", "cell", "i", "j").applyInPandas(compare, "key string, links bigint, a bigint, b bigint")
    found = written(found, "vectors-links")
    same = good.join(classes.select("key", "class_id"), "key").filter("vec_id > class_id").select(F.col("class_id").alias("a"), F.col("vec_id").alias("b"))
    groups = components(found.filter("a IS NOT NULL").select("a", "b").union(same), "vectors-groups")
    links = found.filter("key IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"))
    own = classes.select("key", "weight").join(links, "key", "left")
    out = rows.drop("body").join(own, "key", "left").join(groups.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component.isNull() | (component == F.col("vec_id"))).alias("kept"),
    )
