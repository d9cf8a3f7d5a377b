"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash.  Within its source, a document's virtual finish time is the
words of its source up to and including it, divided by the source's target.  A document can be
taken twice at most, so every document is queued once for each pass; the second pass continues
the virtual clock of the first.  All queued documents are put in order of finish time across
sources, and the order is cut where the words taken reach the total budget.

The order is held in two levels of explicit buckets (hash prefix, then finish time), so that the
hot source and the global order both spread over tasks, and no step depends on where rows lie.

Defined results
    null or empty text     size 0, taken 0
    null source            a source of its own, after all others
    repeated rows          each is a document of its own; equal rows share what they take
    null doc_id            kept, like any other value
    ties                   cannot occur: order ends with the hash and a row number
    empty table            no rows
    other columns          ignored by the plan, kept by ``mixed``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import level_size, running_total, text_column, written

WORD_GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column that isn't null."""
    pieces = F.split(text, WORD_GAP)
    empty = (F.get(pieces, F.lit(0)) == "").cast("long") + (F.get(pieces, F.size(pieces) - 1) == "").cast("long")
    return F.when(F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")) == "", F.lit(0).cast("long")).otherwise(F.size(pieces).cast("long") - empty)


def shuffle_key(docs: DataFrame):
    """32 hexadecimal digits that depend on doc_id, source and text only."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("\x01"))
    return F.md5(F.concat(F.lit("mix|"), part("doc_id"), F.lit("|"), part("source"), F.lit("|"), part("text")))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """One row for each source: source_key, source_size, target, budget.

    Works on one row per source: raise a common level until the budget is spent, with sources
    that reach ``limit`` times their size held there.
    """
    sources = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)))
    everything = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(float(limit)) * F.col("source_size")
    filled = (
        ranked.withColumn("fill", cap / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("held", F.coalesce(F.sum(cap).over(upto), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("held")) / F.col("open"))
        # the first source, by fill, that the level reached there doesn't fill
        .withColumn("level", F.first(F.when(F.col("fill") >= F.col("level"), F.col("level")), ignorenulls=True).over(everything))
    )
    return filled.select("source_key", "source_size", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"), "budget")


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source): one row for each input row.

    Returns key, doc_id, source, size, source_size, target, copies, taken.
    """
    sized = docs.select(
        shuffle_key(docs).alias("key"),
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("source_key"),
        word_count(text_column(docs)).alias("size"),
    )
    sized = written(sized, "mix-sizes")
    buckets = level_size(sized.count())
    targets = written(source_targets(sized, weights, share, limit), "mix-targets")

    hashed = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    queued = sized.withColumn("hash_bucket", F.shiftright(hashed * buckets, 32))
    line = Window.partitionBy("source_key", "hash_bucket").orderBy("key", "size", F.col("doc_id").asc_nulls_first())
    queued = queued.withColumn("place", F.row_number().over(line))
    queued = running_total(queued, ["source_key"], "hash_bucket", ["place"], "size", "ahead")
    queued = written(queued.join(targets, "source_key"), "mix-queue")

    def finish(turn):
        return (turn * F.col("source_size") + F.col("ahead") + F.col("size")).cast("double") / F.col("target")

    def stamp(turn):
        """Place in the global order."""
        return F.struct(finish(turn).alias("finish"), "source_key", turn.cast("int").alias("turn"), "key", "hash_bucket", "place")

    can = (F.col("target") > 0) & (F.col("size") > 0)
    turns = queued.filter(can).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(limit - 1)))).withColumn("at", stamp(F.col("turn")))
    # linear buckets up to 2, then ever wider ones: as many rows in each, and few buckets
    t = F.col("at.finish")
    turns = turns.select("at", "size", "budget", F.when(t < 2, F.floor(t * buckets)).otherwise(2 * buckets + F.floor(F.log2(t / 2) * buckets)).cast("long").alias("time_bucket"))
    ordered = running_total(turns, [], "time_bucket", ["at"], "size", "spent")
    over = ordered.filter(F.col("spent") + F.col("size") > F.col("budget")).agg(F.min("at").alias("cut"))
    cut = over.first()["cut"]  # the first document over the budget, if there is one
    if cut is None:
        copies = F.lit(limit)
    else:
        border = F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in over.schema["cut"].dataType.fields])
        copies = sum((F.when(stamp(F.lit(k)) < border, 1).otherwise(0) for k in range(limit)), F.lit(0))
    return (
        queued.withColumn("copies", F.when(can, copies).otherwise(0).cast("int"))
        .select("key", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as it is taken."""
    plan = mix_plan(docs, weights, share, limit)
    plan = plan.groupBy(F.col("key").alias("__mix_key")).agg(F.sum("copies").alias("__mix_all"), F.count("*").alias("__mix_rows")).filter("__mix_all > 0")
    rows = docs.withColumn("__mix_key", shuffle_key(docs)).join(plan, "__mix_key")
    rows = rows.withColumn("__mix_nth", F.row_number().over(Window.partitionBy("__mix_key").orderBy("__mix_key")))
    own = F.floor(F.col("__mix_all") / F.col("__mix_rows")) + F.when(F.col("__mix_nth") <= F.col("__mix_all") % F.col("__mix_rows"), 1).otherwise(0)
    return rows.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), own.cast("int")))).select(*docs.columns)
