"""Sharding by size: sampled splitters, ranges of the key, overfull ranges subdivided.

The key of a row is the MD5 of its text and then a hash of doc_id and a row number, so rows of
equal texts stand together.  Shards get nearly the same number of bytes.

1.  Rows are drawn by their size (a row of twice the bytes is twice as likely to be drawn) and the
    quantiles of the drawn keys split the key into ranges of about as many bytes.  The draw is by a
    hash, so reruns agree.  Ranges that turn out overfull are drawn again, more densely, and
    subdivided.  Ranges only deal out work; the shards don't depend on the draw.
2.  A group of equal texts is one unit, unless it has more than a quarter of a shard; then each of
    its rows is a unit.  Units of more than a GRAIN-th of a shard can't be evened out by moving a
    border; there are fewer than ``shards`` * GRAIN of them, and they are dealt one by one, the
    largest first, to the emptiest shard.
3.  All other units fill the shards up to one level, in order of the key: the range in which a
    border falls is summed up row by row, and the unit on the border goes to the side where its
    middle lies.
So shards differ by less than a GRAIN-th of their size, however long documents or large groups are,
unless one document alone is larger than a shard.

Defined results
    null text              no bytes, size 1; one group with empty texts
    null doc_id            a value like any other
    repeated rows          each has a slot of its own
    ties                   cannot occur: the key ends with a row number
    very long texts        hashed by the JVM; dealt one by one
    fewer units than shards   some shards are empty
    empty table            no rows
    other columns          ignored by the plan, kept in the files.  Names that begin with two underscores are reserved
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import text_column, written

GRAIN = 256  # a unit of more than this part of a shard is dealt by itself
DRAWN = 16  # rows drawn for each range
MOST_RANGES = 4096
RANGE_ROWS = 50_000
GROUP = 32  # characters of the key that equal texts share
AFTER = "~"  # greater than any digit of a key


def row_size(docs: DataFrame) -> Column:
    """UTF-8 bytes of the text plus 1."""
    return (F.octet_length(text_column(docs)) + 1).cast("long")


def row_key(docs: DataFrame) -> Column:
    """64 hexadecimal digits: text, doc_id, row number.  To be written before it is used twice."""
    of_id = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 16)
    return F.concat(F.md5(text_column(docs)), of_id, F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0"))


def _range_of(splitters: list[str]):
    """The range of a key: the number of splitters up to it."""
    borders = np.array(sorted(splitters), "S64")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, keys.to_numpy().astype("S64"), "right").astype(np.int32))

    return place


def drawn(rows: DataFrame, step: float) -> list[tuple[str, float]]:
    """(key, bytes it stands for) of rows drawn by size, one for every ``step`` bytes, in order."""
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("draw|"), "__key")), 1, 8), 16, 10).cast("double") / 2**32
    found = rows.filter(chance * step < F.col("__size")).select("__key", "__size").collect()
    return sorted((r["__key"], max(float(r["__size"]), step)) for r in found)


def quantiles(sample: list[tuple[str, float]], step: float) -> list[str]:
    """Keys of the sample that cut it into ranges of about ``step`` bytes."""
    out, filled = [], 0.0
    for key, weight in sample:
        if filled >= step:
            out.append(key)
            filled = 0.0
        filled += weight
    return out


def split(rows: DataFrame, total: int, ranges: int, per_range: int = DRAWN, rounds: int = 6) -> tuple[list[str], dict[int, int]]:
    """Splitters for about ``ranges`` ranges, and the bytes of each range that isn't empty."""
    step = total / ranges
    splitters = quantiles(drawn(rows, step / per_range), step)
    for _ in range(rounds):
        at = _range_of(splitters)
        sums = {r["__range"]: r["bytes"] for r in rows.groupBy(at("__key").alias("__range")).agg(F.sum("__size").alias("bytes")).collect()}
        overfull = [k for k, n in sums.items() if n > 2 * step]
        per_range *= 4
        more: set[str] = set()
        if overfull:
            sample = drawn(rows.filter(at("__key").isin(overfull)), step / per_range)
            by_range: dict[int, list[tuple[str, float]]] = {}
            for key, weight in sample:
                by_range.setdefault(bisect_right(splitters, key), []).append((key, weight))
            more = {key for some in by_range.values() for key in quantiles(some, step)} - set(splitters)
        if not more:
            break
        splitters = sorted({*splitters, *more})
    return splitters, sums


def dealt(units: list[tuple[str, int]], shards: int) -> tuple[dict[str, int], list[int]]:
    """The shard of each unit (key, bytes), largest first to the emptiest, and the bytes of each shard."""
    loads, place = [0] * shards, {}
    for key, n in sorted(units, key=lambda u: (-u[1], u[0])):
        shard = loads.index(min(loads))
        loads[shard] += n
        place[key] = shard
    return place, loads


def room(loads: list[int], rest: int) -> list[int]:
    """How many of ``rest`` bytes each shard takes so that all that take any reach one level."""
    level, held = 0, 0
    for k, load in enumerate(sorted(loads), 1):
        held += load
        if (rest + held) // k >= load:
            level = (rest + held) // k
    return [max(0, level - load) for load in loads]


def _fill_cuts(fill: DataFrame, at, sums: dict[int, int], borders: list[int], overfull: list[str]) -> list[str]:
    """For each border (bytes before it) the key from which units are on its far side."""
    starts, before = [], 0
    for k in sorted(sums):
        starts.append((before, k))
        before += sums[k]
    inside = {b: starts[bisect_right(starts, (b, 1 << 40)) - 1] for b in borders if b < before}
    if not inside:
        return [AFTER] * len(borders)
    base = F.element_at(F.create_map(*[x for start, k in set(inside.values()) for x in (F.lit(k), F.lit(start).cast("long"))]), F.col("__range"))
    some = fill.withColumn("__range", at("__key")).filter(F.col("__range").isin([k for _, k in inside.values()]))
    ahead = base + F.coalesce(F.sum("__size").over(Window.partitionBy("__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = [(F.col("__ahead") <= b) & (F.col("__ahead") + F.col("__size") > b) for b in inside]
    met = some.withColumn("__ahead", ahead).filter(F.array_contains(F.array(*hit), True)).select("__key", "__size", "__ahead").collect()
    groups = {r["__key"][:GROUP] for r in met} - set(overfull)
    group, key = F.substring("__key", 1, GROUP), {g: min(r["__key"] for r in met if r["__key"][:GROUP] == g) for g in groups}
    whole = {}
    if groups:
        first = F.element_at(F.create_map(*[F.lit(x) for pair in key.items() for x in pair]), F.col("__group"))
        parts = fill.withColumn("__group", group).filter(F.col("__group").isin(sorted(groups)))
        parts = parts.groupBy("__group").agg(F.sum("__size").alias("bytes"), F.sum(F.when(F.col("__key") < first, F.col("__size")).otherwise(0)).alias("before"))
        whole = {r["__group"]: (r["bytes"], r["before"]) for r in parts.collect()}
    out = []
    for b in borders:
        row = next((r for r in met if r["__ahead"] <= b < r["__ahead"] + r["__size"]), None)
        if row is None:
            out.append(AFTER)
            continue
        unit, n, start = row["__key"], row["__size"], row["__ahead"]
        if unit[:GROUP] in whole:
            first_row = next(r for r in met if r["__key"] == key[unit[:GROUP]])
            unit, (n, before_first) = unit[:GROUP], whole[unit[:GROUP]]
            start = first_row["__ahead"] - before_first
        out.append(unit if 2 * start + n >= 2 * b else unit + AFTER)
    return out


def assigned(rows: DataFrame, shards: int, grain: int = GRAIN, ranges: int | None = None, per_range: int = DRAWN) -> DataFrame:
    """``rows`` (written; with __key and __size) with __shard, __range and __slot, the place in the shard."""
    n, total = rows.agg(F.count("*"), F.sum("__size")).first()
    if not n:
        return rows.withColumn("__shard", F.lit(None).cast("int")).withColumn("__range", F.lit(None).cast("int")).withColumn("__slot", F.lit(None).cast("long"))
    large = lambda column: F.col(column) * (shards * grain) > total
    rows = rows.withColumn("__group", F.substring("__key", 1, GROUP))
    groups = {r["__group"]: r["bytes"] for r in rows.groupBy("__group").agg(F.sum("__size").alias("bytes")).filter(large("bytes")).collect()}
    overfull = sorted(g for g, size in groups.items() if size * 4 * shards > total)
    units = [(g, size) for g, size in groups.items() if g not in overfull]
    if overfull:
        units += [tuple(r) for r in rows.filter(F.col("__group").isin(overfull) & large("__size")).select("__key", "__size").collect()]
    place, loads = dealt(units, shards)
    unit = F.when(F.col("__group").isin(overfull), F.col("__key")).otherwise(F.col("__group"))
    own = rows.sparkSession.createDataFrame([*place.items()], "__unit string, __own int")  # fewer than shards * grain rows
    rows = rows.withColumn("__unit", unit).join(F.broadcast(own), "__unit", "left").drop("__unit", "__group")

    splitters, _ = split(rows, total, ranges or max(64, min(MOST_RANGES, n // RANGE_ROWS)), per_range)
    at = _range_of(splitters)
    fill = rows.filter("__own IS NULL")
    sums = {r["__range"]: r["bytes"] for r in fill.groupBy(at("__key").alias("__range")).agg(F.sum("__size").alias("bytes")).collect()}
    borders = np.cumsum(room(loads, sum(sums.values())))[:-1].tolist()
    cuts = _fill_cuts(fill, at, sums, borders, overfull)
    side = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("__key"))) if cuts else F.lit(0)
    placed = rows.withColumn("__shard", F.coalesce("__own", side).cast("int")).withColumn("__range", at("__key")).drop("__own")

    counts = placed.groupBy("__shard", "__range").agg(F.count("*").alias("__n"))
    counts = counts.select("__shard", "__range", (F.sum("__n").over(Window.partitionBy("__shard").orderBy("__range")) - F.col("__n")).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("__shard", "__range").orderBy("__key"))
    return placed.withColumn("__nth", nth).join(counts, ["__shard", "__range"]).withColumn("__slot", F.col("__base") + F.col("__nth") - 1).drop("__nth", "__base")


def shard_plan(docs: DataFrame, shards: int = 8, grain: int = GRAIN, ranges: int | None = None, per_range: int = DRAWN) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", row_key(docs).alias("__key"), row_size(docs).alias("__size"), F.crc32(text_column(docs).cast("binary")).alias("text_crc32"))
    placed = assigned(written(rows, "shards-rows"), shards, grain, ranges, per_range)
    return placed.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = 8, grain: int = GRAIN) -> None:
    """Writes the rows of ``docs`` as Parquet to ``folder``/shard=K, a file for each range of the key,
    with the column slot beside their own."""
    rows = written(docs.withColumn("__key", row_key(docs)).withColumn("__size", row_size(docs)), "shards-rows")
    placed = assigned(rows, shards, grain)
    out = placed.withColumn("shard", F.col("__shard")).withColumn("slot", F.col("__slot")).repartition("__shard", "__range").sortWithinPartitions("__shard", "__slot")
    out.select(*[c for c in docs.columns if c not in ("shard", "slot")], "slot", "shard").write.partitionBy("shard").parquet(folder)
