"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1.  Every document becomes a set of word shingles (64-bit hashes).  Documents with equal sets
    form a class; its smallest doc_id stands for it from here on.
2.  Min-max hashing: each of ``permutations`` hash evaluations over a set keeps both its minimum
    and its maximum, two signature values for one pass.  The values are dealt to bands of
    ``rows`` values; documents that agree in a band share a bucket.  With 128 permutations,
    32 bands of 8 values, a pair at similarity 0.85 shares no bucket with probability 4e-5.
3.  Stars: every member of a bucket is compared, on full sets, with the smallest id there.  A
    group of copies of any size is linked by this already, in one comparison for each member.
4.  What is left to compare are pairs in buckets whose members are in different components so
    far.  Such buckets join to families; a large family is taken bucket by bucket instead where
    that is less work (chains of buckets).  Either way a pair counts if it shares a bucket, so
    links don't depend on how large the family around them is.  Members of the largest component
    there aren't compared with each other; the others are dealt to blocks, and each pair of
    blocks is one task's work, which intersects the sets by shared shingles and returns only the
    links that join different components, never all pairs.
5.  Components of all links, and the members of each class, give the result.

Defined results
    null or empty text, no words   n_shingles 0, linked with nothing, kept
    fewer words than a shingle     the whole sequence is the one shingle
    very long text                 its set is one row (8 bytes a shingle), sent once for each star
                                   and block that it is compared in
    null doc_id                    linked with nothing, component_id null, kept
    repeated doc_id                rows with one id are one node: its links are those of all its rows
    ties                           none: similarity is exact, components have their smallest id
    empty table                    no rows
    other columns                  ignored.  doc_id is a whole number
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import components, text_column, written
from ._words import hashed_texts, mix, window_hashes

PERMUTATIONS = 128
MISS = 5e-5
BLOCK = 256
FAMILY = 4 * BLOCK  # members; larger families are taken bucket by bucket
COLUMNS = 4096  # shingles that a block compares at once
SALT = 0x51ED2701
BITS, MOST_BITS = 64, 1 << 26  # of the bitmap of ids whose sets are compared: for each, and in all
PIECE = 8 * 4096  # bits that Spark's bitmaps have


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def banding(percent: int, permutations: int, miss: float) -> tuple[int, int]:
    """Bands and values in each, for a similarity of ``percent`` hundredths."""
    values = 2 * permutations
    for rows in range(min(16, values), 1, -1):
        if (1 - (percent / 100) ** rows) ** (values // rows) <= miss:
            return values // rows, rows
    return values, 1


def shingle_sets(words: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    shingles = window_hashes(words, size, SALT)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(SALT + int(b - a))
            for word in words[a:b]:
                whole = mix(np.array([whole ^ word], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Both extremes of every permutation for each (non-empty) set: a row of 2 * permutations."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((2 * permutations, len(sets)), np.uint64)
    for k, a in enumerate(_multipliers(permutations)):
        value = flat * a
        out[2 * k] = np.minimum.reduceat(value, starts)
        out[2 * k + 1] = np.maximum.reduceat(value, starts)
    return out.T


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band; a band takes values of different permutations."""
    n = signature.shape[1]
    order = np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2)])[: bands * rows]
    out = np.empty((len(signature), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(signature), band + 1, np.uint64)
        for column in order[band * rows : (band + 1) * rows]:
            value = mix(value ^ signature[:, column])
        out[:, band] = value
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signatures(docs: DataFrame, shingle: int, permutations: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the set's bands (null if empty)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, offsets in hashed_texts(batch.column(1), lower=True):
                sets = shingle_sets(words, offsets, shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                lists: list = [None] * len(sets)
                if full:
                    got = _signed(band_hashes(min_max([sets[k] for k in full], permutations), bands, rows))
                    for k, values in zip(full, got):
                        lists[k] = values
                one = np.array([int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets], np.uint64)
                two = np.array([int(np.add.reduce(mix(s ^ np.uint64(SALT)))) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(one)), pa.array(_signed(two)), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    schema = f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"
    return docs.select("doc_id", text_column(docs).alias("text")).mapInArrow(sign, schema)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """One bit for each place that an id of ``ids`` (class_id) falls on, by hash; of BITS places for each
    id, but MOST_BITS at most.  What is put on the driver and broadcast is bounded by that."""
    size = min(MOST_BITS, max(PIECE, 1 << (BITS * ids.count()).bit_length()))
    placed = ids.select(_place("class_id", size).alias("at"))
    pieces = placed.groupBy(F.floor(F.col("at") / PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for piece, bits in pieces.collect():
        out[piece * (PIECE // 8) : (piece + 1) * (PIECE // 8)] = np.frombuffer(bits, np.uint8)
    return out


def _place(column: str, size: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(size))


def full_sets(docs: DataFrame, shingle: int, ids: DataFrame) -> DataFrame:
    """class_id and shingles, the sorted shingle hashes of the text as bytes, for the rows of ``docs`` (doc_id,
    text) that have words and whose doc_id is in ``ids`` (class_id), and for a few more: ids are
    looked up in a bitmap, by hash.  Texts are not shuffled."""
    bitmap = _bitmap(ids)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            for row, words, offsets in hashed_texts(batch.column(1), lower=True):
                sets = shingle_sets(words, offsets, shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                kept = batch.column(0).slice(row, len(sets)).take(pa.array(full, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept, pa.array([sets[k].tobytes() for k in full], pa.binary())], ["class_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", text_column(docs).alias("text"), _place("doc_id", 8 * len(bitmap)).alias("at"))
    return rows.mapInArrow(make, f"class_id {kind}, shingles binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exact."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    borders = np.searchsorted(column, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
        if a == b:
            continue
        m = np.zeros((n, min(COLUMNS, int(column[b - 1]) - k * COLUMNS + 1)), np.float32)
        m[owner[a:b], column[a:b] - k * COLUMNS] = 1
        out += m @ m.T
    return out


def spanning_links(ids: np.ndarray, groups: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], buckets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links enough to connect what is linked: pairs in one bucket with 100 * |a & b| >= percent * |a | b|.

    Rows of one group are connected already.  If there are two sides, pairs on one side are
    another task's.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= both > 0
    linked &= intersections(buckets) > 0
    if (sides != sides[0]).any():
        linked &= sides[:, None] != sides[None, :]
    same = groups[:, None] == groups[None, :]
    linked &= ~same
    seen, out = np.zeros(len(ids), bool), []
    for root in range(len(ids)):
        if seen[root]:
            continue
        seen[root], reach = True, [root]
        while reach:
            x = reach.pop()
            for y in np.flatnonzero((linked[x] | same[x]) & ~seen):
                seen[y] = True
                if linked[x, y]:
                    out.append((int(ids[x]), int(ids[y])))
                reach.append(int(y))
    return out


def _stars(ties: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) among ``ties`` (leader, class_id), confirmed on full sets; a crowded star is
    dealt to blocks, each with the leader's set."""
    size = ties.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    leaders = size.select("leader", every.alias("block"), F.col("leader").alias("class_id"))
    members = ties.join(size, "leader").select("leader", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("block"), "class_id")
    rows = leaders.unionByName(members).join(sets, "class_id")

    def confirm(part: pd.DataFrame) -> pd.DataFrame:
        leader, ids = int(part["leader"].iloc[0]), part["class_id"].to_numpy()
        arrays = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        linked = []
        for own in (s for i, s in zip(ids, arrays) if i == leader):  # one, unless rows share the id
            for i, s in zip(ids, arrays):
                if i != leader:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(s) - both):
                        linked.append(i)
        return pd.DataFrame({"a": [leader] * len(linked), "b": linked}, dtype="int64")

    return rows.groupBy("leader", "block").applyInPandas(confirm, "a bigint, b bigint")


def _open_buckets(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, class_id, grp of the buckets whose members are in different components."""
    marked = entries.join(groups.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("bucket", "class_id", F.coalesce("component", "class_id").alias("grp"))
    mixed = marked.groupBy("bucket").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.min("class_id").alias("leader")).filter("low < high")
    return marked.join(mixed.select("bucket", "leader"), "bucket")


def _units(open_ones: DataFrame, family: int) -> DataFrame:
    """kind, unit, class_id, grp, buckets: what has to be compared.  A unit is a family of buckets (kind 0),
    or, in large families where that is less work, each of its buckets (kind 1)."""
    ties = open_ones.filter("class_id > leader").select(F.col("leader").alias("a"), F.col("class_id").alias("b"))
    families = components(ties, "minhash-families").select(F.col("id").alias("class_id"), F.col("component").alias("family"))
    of_family = open_ones.join(families, "class_id")
    work = of_family.groupBy("family", "bucket").agg(F.count("*").alias("n")).groupBy("family").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("by_bucket"))
    size = families.groupBy("family").agg(F.count("*").alias("size"))
    apart = work.join(size, "family").filter((F.col("size") > family) & (2 * F.col("by_bucket") < F.col("size").cast("double") * F.col("size"))).select("family")
    whole = of_family.join(apart, "family", "left_anti").select(F.lit(0).alias("kind"), F.col("family").alias("unit"), "class_id", "grp", "bucket")
    whole = whole.groupBy("kind", "unit", "class_id", "grp").agg(F.collect_set("bucket").alias("buckets"))  # at most one a band
    chained = of_family.join(apart, "family", "left_semi").select(F.lit(1).alias("kind"), F.col("bucket").alias("unit"), "class_id", "grp", F.array("bucket").alias("buckets"))
    return whole.unionByName(chained)


def _remaining(open_ones: DataFrame, sets: DataFrame, percent: int, block: int, family: int) -> DataFrame:
    """Links (a, b) between members of open buckets that are in different components.

    The members of a unit's largest component are not compared with each other: the others are
    dealt to blocks, and each of these meets the blocks of others and those of the largest.
    """
    units = written(_units(open_ones, family), "minhash-units")
    by_group = units.groupBy("kind", "unit", "grp").agg(F.count("*").alias("n"))
    count = by_group.groupBy("kind", "unit").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    in_blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    count = count.select("kind", "unit", "main", in_blocks(F.col("all") - F.col("most")).alias("others"), in_blocks(F.col("most")).alias("mains"))
    rows = units.join(count, ["kind", "unit"]).withColumn("is_main", F.col("grp") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class_id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    place = lambda lo, hi, across: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(across).alias("across"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_main = F.transform(every("others"), lambda k: place(k, F.col("block"), True))
    of_other = F.concat(F.transform(every("others"), lambda k: place(F.least("block", k), F.greatest("block", k), False)), F.transform(every("mains"), lambda k: place(F.col("block"), k, True)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)))
    rows = rows.select("kind", "unit", "at.*", "is_main", "block", "class_id", "grp", "buckets").join(sets, "class_id")

    def confirm(part: pd.DataFrame) -> pd.DataFrame:
        sides = part["is_main" if part["across"].iloc[0] else "block"].to_numpy()
        found = []
        if (sides != sides[0]).any() or not part["across"].iloc[0] and part["lo"].iloc[0] == part["hi"].iloc[0]:
            found = spanning_links(part["class_id"].to_numpy(), part["grp"].to_numpy(), sides, [np.frombuffer(x, np.uint64) for x in part["shingles"]], list(part["buckets"]), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("kind", "unit", "lo", "hi", "across").applyInPandas(confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, miss: float = MISS, block: int = BLOCK, family: int = FAMILY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    bands, rows = banding(percent, permutations, miss)
    signed = written(signatures(docs, shingle, permutations, bands, rows), "minhash-signatures")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"))
    classes = written(classes, "minhash-classes")
    entries = classes.select("class_id", F.explode("bands").alias("bucket"))
    leaders = entries.groupBy("bucket").agg(F.min("class_id").alias("leader"), F.max("class_id").alias("last")).filter("leader < last").drop("last")
    entries = written(entries.join(leaders, "bucket"), "minhash-buckets")

    # full sets of the classes that share a bucket (of all rows, if several have the id)
    sets = written(full_sets(docs, shingle, entries.select("class_id").distinct()), "minhash-sets", "uncompressed")
    ties = entries.filter("class_id > leader").select("leader", "class_id").distinct()
    groups = written(components(written(_stars(ties, sets, percent, block), "minhash-stars"), "minhash-groups"), "minhash-grouped")
    rest = _remaining(written(_open_buckets(entries.select("bucket", "class_id"), groups), "minhash-open"), sets, percent, block, family)
    # rows of one document id are one node even if their texts differ
    same = full.join(classes.drop("bands"), ["n_shingles", "set_a", "set_b"]).filter("doc_id > class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    found = components(groups.select(F.col("component").alias("a"), F.col("id").alias("b")).union(rest).union(same), "minhash-links")
    out = signed.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that near-duplicate detection keeps, all columns unchanged.

    Of rows that share their doc_id (or have none) and their text, one stays; rows of a kept
    doc_id with different texts all stay.  Columns __gone, __again and __nth are reserved.
    """
    found = written(near_duplicates(docs, **parameters), "minhash-found")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    again = found.filter("kept").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__again")
    if again.isEmpty():
        return left
    meets = left["doc_id"].eqNullSafe(again["__again"])
    order = Window.partitionBy("doc_id", F.xxhash64(text_column(docs)), F.md5(text_column(docs))).orderBy(F.xxhash64(*docs.columns))
    once = left.join(again, meets, "left_semi").withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return left.join(again, meets, "left_anti").unionByName(once)
