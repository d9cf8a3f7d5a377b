"""Hard negatives by a vector-approximation file.

A positive of an anchor is one of its best rows of the same label; a hard negative is a row of
another label whose score lies in a window below the positive's.  Scores are inner products of
vectors of whole numbers.

1.  Vectors are dealt by hash into blocks.  In a block every dimension is quantised into at most
    CELLS cells of about as many rows; a cell's limits are the least and greatest value in it.  A
    block is one row: codes of one byte a component, tables of limits, and the exact vectors.
2.  A task takes a block and a pack of anchors.  Looking up the limits of every row's cells gives a
    centre and a reach, and so a lower and an upper bound of every score.  A row is scored
    exactly only if its bounds let it in: for positives, if its upper bound isn't below the
    ``positives``-th lower bound; for negatives, if the bounds touch the window and the upper
    bound isn't below the lower bounds of enough rows that are in the window for certain.
3.  Blocks' best rows are merged for a pack of anchors, FAN blocks at a time.

No bound rules out a row that counts, so results are exact.  Work is queries times rows, both of
which grow with the table; neither a task nor a block grows.

Defined results
    null label, vector or component, or one that isn't finite   takes no part
    components so large that a score might not fit a long       take no part (for 64 dimensions: beyond 92,000)
    different lengths      rows of other lengths are no candidates
    empty vectors          compared with one another, with score 0
    repeated rows, repeated vec_id   each row is an anchor and a candidate of its own
    ties                   by the smaller vec_id, null last; rows with equal vec_id and score are interchangeable
    null vec_id            no anchor; a candidate whose id is null
    very long vectors      fewer rows in a block
    one label only, empty table   no rows
    other columns          ignored.  vec_id and label are whole numbers
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

SCALE = 256
CELLS = 64
BLOCK_ROWS, BLOCK_VALUES = 8192, 1 << 22
PACK = 512  # anchors of a pack
SLICE = 64  # anchors bounded at a time
FAN = 32
NO_ID = np.int64(2**63 - 1)  # stands for a null vec_id
NO_SCORE = np.int64(-(2**63))  # stands for no row
SLACK = 1e-9  # covers what rounding does to bounds


def _limit(length: int) -> int:
    """The greatest component for which a hundred scores still fit a long."""
    return math.isqrt((1 << 55) // max(length, 1))


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, length and body (whole numbers of 32 bits) of the rows that take part."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.Table.from_batches([batch]).combine_chunks()
            lists = batch.column("embedding").combine_chunks()
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls are NaN
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(SCALE * values)
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            kept, lengths, bodies = [], [], []
            for row, (end, size) in enumerate(zip(ends, sizes)):
                some = whole[int(end - size) : int(end)]
                if np.isfinite(values[int(end - size) : int(end)]).all() and (np.abs(some) <= _limit(len(some))).all():
                    kept.append(row)
                    lengths.append(len(some))
                    bodies.append(some.astype(np.int32).tobytes())
            part = batch.select(["vec_id", "label"]).take(pa.array(kept, pa.int64()))
            part = part.append_column("length", pa.array(lengths, pa.int32())).append_column("body", pa.array(bodies, pa.binary()))
            yield from part.to_batches()

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(scaled, "vec_id bigint, label bigint, length int, body binary")


def quantised(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x dimensions) and the limits of the cells (dimensions x cells), all of values met."""
    codes = np.zeros(x.shape, np.uint8)
    low, high = np.zeros((x.shape[1], cells)), np.zeros((x.shape[1], cells))
    for d in range(x.shape[1]):
        v = np.sort(x[:, d])
        borders = np.unique(v[(np.arange(1, cells) * len(v)) // cells])
        codes[:, d] = np.searchsorted(borders, x[:, d], "right")
        starts = np.r_[0, np.searchsorted(v, borders, "left")]
        ends = np.r_[starts[1:], len(v)] - 1
        low[d, : len(starts)], high[d, : len(starts)] = v[np.minimum(starts, len(v) - 1)], v[np.maximum(ends, starts.clip(max=len(v) - 1))]
    return codes, low, high


def _block(part: pd.DataFrame) -> pd.DataFrame:
    length = int(part["length"].iloc[0])
    x = np.frombuffer(b"".join(part["body"]), np.int32).reshape(len(part), length)
    codes, low, high = quantised(x)
    return pd.DataFrame([{
        "length": length, "block": part["block"].iloc[0], "n": len(part), "rows": part["row"].to_numpy(np.int64).tobytes(), "ids": part["vec_id"].to_numpy(np.int64).tobytes(),
        "labels": part["label"].to_numpy(np.int64).tobytes(), "codes": codes.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "exact": x.tobytes(),
    }])


BLOCK = "length int, block int, n int, rows binary, ids binary, labels binary, codes binary, low binary, high binary, exact binary"


def approximation_file(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The blocks of ``rows`` (length, row, vec_id, label, body), one row each."""
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    return rows.join(counts.select("length", "blocks"), "length").withColumn("block", block).groupBy("length", "block").applyInPandas(_block, BLOCK)


def _int64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``most`` of the last axis: highest score first, then smallest id."""
    order = np.lexsort((ids, -np.maximum(scores, NO_SCORE + 1), scores == NO_SCORE), axis=-1)[..., :most]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _at_least(bounds: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; minus infinity where there are fewer."""
    if bounds.shape[1] < k:
        return np.full(len(bounds), -np.inf)
    return -np.partition(-bounds, k - 1, axis=1)[:, k - 1]


class _View:
    """A block beside a pack of anchors: bounds of a slice of anchors, exact scores on demand."""

    def __init__(self, block: pd.Series, pack: pd.Series) -> None:
        length = int(block["length"])
        self.rows, self.ids, self.labels = _int64(block["rows"]), _int64(block["ids"]), _int64(block["labels"])
        self.x = np.frombuffer(block["exact"], np.int32).reshape(len(self.rows), length)
        codes = np.frombuffer(block["codes"], np.uint8).reshape(self.x.shape)
        low, high = (np.frombuffer(block[c], np.float64).reshape(length, CELLS) for c in ("low", "high"))
        every = np.arange(length)
        low, high = low[every, codes], high[every, codes]  # the lookup
        self.centre, self.reach = (low + high) / 2, (high - low) / 2
        self.anchor_rows, self.anchor_labels = _int64(pack["rows"]), _int64(pack["labels"])
        self.anchors = np.frombuffer(pack["exact"], np.int32).reshape(len(self.anchor_rows), length)
        greatest = max(int(np.abs(a).max(initial=0)) for a in (self.x, self.anchors))
        self.doubles = length * greatest * greatest < 1 << 52

    def bounds(self, some: slice) -> tuple[np.ndarray, np.ndarray]:
        q = self.anchors[some].astype(np.float64)
        middle, reach = q @ self.centre.T, np.abs(q) @ self.reach.T
        reach += SLACK * (np.abs(middle) + reach)
        return middle - reach, middle + reach

    def scores(self, anchor: int, places: np.ndarray) -> np.ndarray:
        if self.doubles:  # exact below 2^53
            return (self.x[places].astype(np.float64) @ self.anchors[anchor].astype(np.float64)).astype(np.int64)
        return self.x[places].astype(np.int64) @ self.anchors[anchor].astype(np.int64)


def _positives(view: _View, most: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.full((len(view.anchors), most), NO_SCORE), np.full((len(view.anchors), most), NO_ID)
    for k in range(0, len(view.anchors), SLICE):
        some = slice(k, k + SLICE)
        lower, upper = view.bounds(some)
        same = (view.anchor_labels[some, None] == view.labels[None, :]) & (view.anchor_rows[some, None] != view.rows[None, :])
        least = _at_least(np.where(same, lower, -np.inf), most)
        wanted = same & (upper >= least[:, None])
        for a in range(len(lower)):
            places = np.flatnonzero(wanted[a])
            best, own = _best(view.scores(k + a, places), view.ids[places], most)
            scores[k + a, : len(best)], ids[k + a, : len(own)] = best, own
    return scores, ids


def _negatives(view: _View, positive: np.ndarray, most: int, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Best negatives for the scores ``positive`` (anchors x positives)."""
    shape = (*positive.shape, most)
    scores, ids = np.full(shape, NO_SCORE), np.full(shape, NO_ID)
    for k in range(0, len(view.anchors), SLICE):
        lower, upper = view.bounds(slice(k, k + SLICE))
        for a in range(len(lower)):
            other = np.flatnonzero(view.labels != view.anchor_labels[k + a])
            low, up = lower[a, other], upper[a, other]
            for p in np.unique(positive[k + a]):
                least, greatest = -(-window[0] * int(p) // 100), window[1] * int(p) // 100
                if p == NO_SCORE or least > greatest:
                    continue
                may = (up >= least) & (low <= greatest)
                sure = low[(low >= least) & (up <= greatest)]
                if len(sure) >= most:
                    may &= up >= np.partition(sure, len(sure) - most)[len(sure) - most]
                places = other[may]
                exact = view.scores(k + a, places)
                inside = (exact >= least) & (exact <= greatest)
                best, own = _best(exact[inside], view.ids[places[inside]], most)
                for j in np.flatnonzero(positive[k + a] == p):
                    scores[k + a, j, : len(best)], ids[k + a, j, : len(own)] = best, own
    return scores, ids


FOUND = "length int, pack int, part int, scores binary, ids binary"


def _found(keys: tuple, part: int, scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([{"length": keys[0], "pack": keys[1], "part": part, "scores": scores.tobytes(), "ids": ids.tobytes()}])


def _searched(blocks: DataFrame, packs: DataFrame, counts: DataFrame, search: Callable[[_View, pd.Series], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """What ``search`` finds for every pack in every block of its length."""
    of = counts.select("length", "blocks", "packs").filter("packs > 0")
    sides = [c for c in packs.columns if c not in ("length", "pack")]
    null = lambda c: F.lit(None).cast("binary").alias(c)
    mine = [c for c in blocks.columns if c not in ("length", "block", "n")]
    left = blocks.join(of, "length").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
    left = left.select("length", "pack", "block", F.lit(True).alias("is_block"), *mine, *[null(c) for c in sides if c not in mine])
    right = packs.join(of, "length").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("length", "pack", "block", F.lit(False).alias("is_block"), *sides, *[null(c) for c in mine if c not in sides])

    def meet(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block, pack = part[part["is_block"]], part[~part["is_block"]]
        if not len(block) or not len(pack):  # a hash leaves some blocks without rows
            return pd.DataFrame(columns=["length", "pack", "part", "scores", "ids"])
        return _found(keys, keys[2], *search(_View(block.iloc[0], pack.iloc[0]), pack.iloc[0]))

    return left.unionByName(right).groupBy("length", "pack", "block").applyInPandas(meet, FOUND)


def _merged(found: DataFrame, blocks: int, most: int, name: str) -> DataFrame:
    """One row for each pack, with the best of all blocks."""

    def merge(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        scores, ids = (np.concatenate([_int64(x).reshape(-1, most) for x in part[c]], 1) for c in ("scores", "ids"))
        return _found(keys, keys[2], *_best(scores, ids, most))

    found = written(found, name)
    while blocks > 1:
        blocks = -(-blocks // FAN)
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("length", "pack", "part").applyInPandas(merge, FOUND)
        found = written(found, name)
    return found


def hard_negatives(
    vectors: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)
) -> DataFrame:
    """Negatives for the rows of ``vectors`` (vec_id, embedding, label) where ``anchors`` holds.

    label: what to use as the label; window: per cent of the positive's score.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = usable(vectors, label).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("is_anchor", F.coalesce(anchors, F.lit(False))).withColumn("vec_id", F.coalesce("vec_id", F.lit(int(NO_ID))))
    rows = written(rows, "negatives-rows")
    in_block = F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.col("length"), F.lit(1)))))
    counts = rows.groupBy("length").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("asked"))
    counts = counts.select("length", F.ceil(F.col("n") / in_block).cast("int").alias("blocks"), F.ceil(F.col("asked") / PACK).cast("int").alias("packs"))
    counts = written(counts, "negatives-counts")
    most_blocks = counts.agg(F.max("blocks")).first()[0] or 0
    blocks = written(approximation_file(rows.drop("is_anchor"), counts), "negatives-blocks")

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        whole = {c: part[c].to_numpy(np.int64).tobytes() for c in ("row", "vec_id", "label")}
        return pd.DataFrame([{"length": part["length"].iloc[0], "pack": part["pack"].iloc[0], "rows": whole["row"], "ids": whole["vec_id"], "labels": whole["label"], "exact": b"".join(part["body"])}])

    asked = rows.filter("is_anchor").join(counts.select("length", "packs"), "length").withColumn("pack", F.pmod(F.xxhash64("row"), F.col("packs")).cast("int"))
    packs = written(asked.groupBy("length", "pack").applyInPandas(packed, "length int, pack int, rows binary, ids binary, labels binary, exact binary"), "negatives-packs")

    best = _merged(_searched(blocks, packs, counts, lambda view, _: _positives(view, positives)), most_blocks, positives, "negatives-positives")
    packs = packs.join(best.select("length", "pack", F.col("scores").alias("positive"), F.col("ids").alias("positive_ids")), ["length", "pack"])
    packs = written(packs, "negatives-asked")
    found = _searched(blocks, packs, counts, lambda view, pack: _negatives(view, _int64(pack["positive"]).reshape(-1, positives), negatives, window))
    found = _merged(found, most_blocks, negatives, "negatives-found")

    def unpacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                scores, ids = (_int64(x).reshape(-1, positives, negatives) for x in (row.scores, row.ids))
                p_scores, p_ids, own = _int64(row.positive).reshape(-1, positives), _int64(row.positive_ids).reshape(-1, positives), _int64(row.anchor_ids)
                a, p, n = np.nonzero(scores != NO_SCORE)
                yield pd.DataFrame({"anchor_id": own[a], "positive_id": p_ids[a, p], "rank": (n + 1).astype(np.int32), "negative_id": ids[a, p, n], "positive_score": p_scores[a, p], "negative_score": scores[a, p, n]})

    out = found.select("length", "pack", "scores", "ids").join(packs.select("length", "pack", F.col("ids").alias("anchor_ids"), "positive", "positive_ids"), ["length", "pack"])
    out = out.mapInPandas(unpacked, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    no_null = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return out.select(no_null("anchor_id"), no_null("positive_id"), "rank", no_null("negative_id"), "positive_score", "negative_score")
