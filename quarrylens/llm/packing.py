"""Bulk-synchronous best-fit packing of tokenized documents into sequences.

Every document becomes its token ids and an end id.  Only documents over the capacity are cut,
into pieces of exactly the capacity; what is left over is the first piece.  Pieces are packed in
supersteps, longer ones (over a quarter of the capacity) before the others:

1.  Range-sort: pieces are ranked within their length, once; open sequences within their gap, in
    every superstep.  (Length, rank) and (gap, rank) are the two sorted orders.
2.  Successor sweep: from the longest pieces down, each takes the smallest gap that holds it and
    that no longer piece has taken.  A sweep only needs how many there are of each size, at most
    ``capacity`` numbers of either kind, which meet in one task; its result is ranges of ranks,
    and is broadcast.
3.  Conflicts are resolved by rank: the k-th piece of a range gets the k-th sequence (or as many
    of them as fit take the same one), so that no two claim the same room.
4.  Gaps are updated, sequences that are too full for every piece leave, and the next superstep
    begins.  Pieces longer than every gap open new sequences, as few as hold their tokens.

All rows stay on the executors: sequences are ranked, matched and updated there, and pieces join
the sequences they were matched with by (superstep, gap, rank).  The driver gets one row a
superstep: pieces left, sequences to open.  Sequences and plans of all supersteps are the
partitions of one folder each, so that the last query has one scan of either, however many
supersteps there were.

Defined results
    null or empty text     one piece that holds the end id only
    very long text         tokenized whole by one task
    repeated rows          each is packed
    ties                   pieces of one length are in order of a hash of (doc_id, piece, content),
                           sequences with one gap in order of their number, at any count of either
    null doc_id            kept, like any other value
    empty table            no rows
    other columns          ignored.  Names that begin with an underscore are the operator's own
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ._spark import fresh_folder, level_size, running_total, text_column, written, written_to

CAPACITY = 1024
END_ID = 2
FEW = 1 << 20  # sequences whose ranks need no second level (they are the same with one)
# Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def encoder(vocabulary: str):
    """Text to a uint32 array of ids, the same ids as the tokenizers library gives for the file.

    The vocabulary is run by tiktoken, which is several times faster; should it give up on a
    text, tokenizers encodes that one.
    """
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        back = _byte_of_character()
        ranks = {bytes(back[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("corpus", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)

        @functools.cache
        def slow():
            import tokenizers

            return tokenizers.Tokenizer.from_file(vocabulary)

        def encode(text: str) -> np.ndarray:
            try:
                return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
            except (ValueError, RuntimeError):  # its pattern engine gives up
                return np.asarray(slow().encode(text, add_special_tokens=False).ids, dtype="<u4")

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


def cut_points(total: int, capacity: int) -> list[int]:
    """Piece borders: the first piece takes what is left over, the others are full."""
    first = total % capacity or min(total, capacity)
    return [0, *range(first, total + 1, capacity)]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece."""
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select("doc_id", text_column(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                all_ids = np.concatenate([encode(text), end])
                at = cut_points(len(all_ids), capacity)
                for n, (a, b) in enumerate(zip(at, at[1:])):
                    row.append(k)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(all_ids[a:b].tobytes()))
                    if with_ids:
                        ids.append(all_ids[a:b].astype(np.int64))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut, schema)


def swept(lengths: list[tuple[int, int, int]], gaps: dict[int, int], least: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """One successor sweep of the pieces of ``least`` tokens or more.

    ``lengths``: (length, pieces left, pieces placed before); ``gaps``: sequences of each gap.
    Returns ranges (length, first rank, pieces, gap, first rank of its sequences), where a
    sequence takes as many of the pieces as its gap holds, and what is left of ``lengths``.
    """
    by_gap = sorted(gaps, reverse=True)
    stack: list[list[int]] = []  # gaps that hold the piece: gap, first rank, sequences; the smallest on top
    plan, rest, at = [], [], 0
    for length, left, done in sorted(lengths, reverse=True):
        while at < len(by_gap) and by_gap[at] >= length:
            stack.append([by_gap[at], 0, gaps[by_gap[at]]])
            at += 1
        while left and length >= least and stack:
            gap, first, count = stack[-1]
            each = gap // length
            take = min(count, -(-left // each))
            many = min(left, take * each)
            plan.append((length, done, many, gap, first))
            left, done = left - many, done + many
            stack[-1][1:] = first + take, count - take
            if take == count:
                stack.pop()
        rest.append((length, left, done))
    return plan, rest


def to_open(lengths: list[tuple[int, int, int]], widest: int, capacity: int) -> int:
    """Sequences that the pieces need which are longer than every gap."""
    big = [(length, left) for length, left, _ in lengths if length > widest]
    return max(-(-sum(length * left for length, left in big) // capacity), sum(left for length, left in big if 2 * length > capacity))


_PLAN = "kind int, length bigint, first_rank bigint, many bigint, gap bigint, first_gap bigint"
_GAPS = "sequence_id bigint, gap bigint, gap_rank bigint"


def _taking(gaps: DataFrame, ranges: DataFrame, how: str, by_step: bool = False) -> DataFrame:
    """``gaps`` with ``taken``: the tokens that a sequence takes by the ranges of its superstep."""
    place, each = F.col("gap_rank") - F.col("first_gap"), F.floor(F.col("gap") / F.col("length"))
    meets = (F.col("gap") == F.col("_gap")) & (place >= 0) & (place * each < F.col("many"))
    if by_step:
        meets &= F.col("step") == F.col("_step")
    taken = F.coalesce(F.least(each, F.col("many") - place * each) * F.col("length"), F.lit(0)).cast("long")
    return gaps.join(F.broadcast(ranges), meets, how).select(*gaps.columns, taken.alias("taken"))


def _ranges(plan: DataFrame, *more: str) -> DataFrame:
    return plan.filter("kind = 0").select("length", "first_rank", "many", F.col("gap").alias("_gap"), "first_gap", *[F.col(c).alias(f"_{c}") for c in more])


def _superstep(counts: DataFrame, capacity: int) -> DataFrame:
    """The plan of a superstep, from the numbers of pieces (kind 1: length, left, done) and of
    sequences (kind 2: gap, number): its ranges (kind 0), the pieces left (kind 1), and one row
    of totals (kind 3: pieces left, sequences to open, the shortest piece left)."""

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        pieces, gaps = rows[rows["kind"] == 1], rows[rows["kind"] == 2]
        lengths = list(zip(pieces["length"], pieces["first_rank"], pieces["many"]))
        open_gaps = dict(zip(gaps["length"], gaps["first_rank"]))
        least = capacity // 4 if any(4 * length >= capacity and left for length, left, _ in lengths) else 1
        ranges, rest = swept(lengths, open_gaps, least)
        # gaps after it
        now = dict(open_gaps)
        for length, _, many, gap, _ in ranges:
            each = gap // length
            full, part = divmod(many, each)
            now[gap] -= full + (part > 0)
            for size, n in ((gap - each * length, full), (gap - part * length, part > 0)):
                now[size] = now.get(size, 0) + n
        rest = [r for r in rest if r[1]]
        turn = [r for r in rest if 4 * r[0] >= capacity] or rest  # the pieces of the next superstep
        more = to_open(turn, max((g for g, n in now.items() if n), default=0), capacity)
        out = [(0, *r) for r in ranges] + [(1, *r, 0, 0) for r in rest]
        out.append((3, sum(left for _, left, _ in rest), more, min((r[0] for r in rest), default=capacity + 1), 0, 0))
        yield pd.DataFrame(out, columns=["kind", "length", "first_rank", "many", "gap", "first_gap"])

    return counts.repartition(1).mapInPandas(plan, _PLAN)  # at most 2 * capacity rows


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: the columns of ``pieces``, sequence_id and offset."""
    spark = docs.sparkSession
    seen = Observation()
    cut = pieces(docs, vocabulary, capacity, end_id, with_ids).observe(seen, F.count("*").alias("n"), F.sum("length").alias("tokens"), F.count_if(F.col("length") * 2 > capacity).alias("alone"))
    cut = written(cut, "pack-pieces")
    total, buckets = seen.get["n"], level_size(seen.get["n"])
    ranked = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(ranked, ["length"], "_bucket", ["doc_id", "piece", "ids_crc32"], "_one", "_rank")

    left, more, opened, step = total, max(-(-(seen.get["tokens"] or 0) // capacity), seen.get["alone"]), 0, 0
    none = spark.range(0).select(F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("gap"))
    todo = cut.groupBy("length").agg(F.count("*").alias("first_rank"), F.lit(0).cast("long").alias("many")).select(F.lit(1).alias("kind"), "length", "first_rank", "many")
    open_ones, gap_folder, plan_folder = none, fresh_folder(spark, "pack-gaps"), fresh_folder(spark, "pack-plans")
    while left:
        fresh = spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
        sorted_gaps = open_ones.union(fresh)
        # ranked by sequence_id within each gap, in one level or in two: a bucket is a range of ids
        if opened + more <= FEW:
            sorted_gaps = sorted_gaps.withColumn("gap_rank", F.row_number().over(Window.partitionBy("gap").orderBy("sequence_id")).cast("long") - 1)
        else:
            width = -(-(opened + more) // level_size(opened + more))
            sorted_gaps = sorted_gaps.withColumn("_bucket", F.floor(F.col("sequence_id") / F.lit(width))).withColumn("_one", F.lit(1).cast("long"))
            sorted_gaps = running_total(sorted_gaps, ["gap"], "_bucket", ["sequence_id"], "_one", "gap_rank")
        sorted_gaps = written_to(sorted_gaps.select("sequence_id", "gap", "gap_rank"), f"{gap_folder}/step={step}")
        opened += more
        counts = todo.unionByName(sorted_gaps.groupBy(F.col("gap").alias("length")).agg(F.count("*").alias("first_rank")).withColumns({"kind": F.lit(2), "many": F.lit(0).cast("long")}))
        plan = written_to(_superstep(counts, capacity), f"{plan_folder}/step={step}")
        totals = plan.filter("kind = 3").first()
        left, more, shortest = totals["length"], totals["first_rank"], totals["many"]
        both = _taking(sorted_gaps, _ranges(plan), "left")
        open_ones = both.select("sequence_id", (F.col("gap") - F.col("taken")).alias("gap")).filter(F.col("gap") >= shortest)
        todo = plan.filter("kind = 1").select("kind", "length", "first_rank", "many")
        step += 1
    if not step:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # every piece to its range, and so to its sequence
    ranges = _ranges(spark.read.schema(f"{_PLAN}, step int").parquet(plan_folder), "step")  # at most 2 * capacity rows a superstep
    matched = _taking(spark.read.schema(f"{_GAPS}, step int").parquet(gap_folder), ranges, "inner", by_step=True)
    nth, each = F.col("_rank") - F.col("first_rank"), F.floor(F.col("_gap") / F.col("_length"))
    meets = (ranked["length"] == F.col("_length")) & (nth >= 0) & (nth < F.col("many"))
    placed = ranked.join(F.broadcast(ranges.withColumnRenamed("length", "_length")), meets).select(*cut.columns, F.col("_step").alias("step"), F.col("_gap").alias("gap"), (F.col("first_gap") + F.floor(nth / each)).alias("gap_rank"), (capacity - F.col("_gap") + nth % each * F.col("_length")).cast("long").alias("offset"))
    return placed.join(matched.drop("taken"), ["step", "gap", "gap_rank"]).select(*cut.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, for a result of ``packed`` with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
