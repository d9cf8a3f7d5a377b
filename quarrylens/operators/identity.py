"""Entities across names: mentions that share an identity key are one entity, kept up batch by batch.

A mention has a key for its name and type, and one for its identifier in an outside catalogue, if
it has one.  Keys of one mention are linked, and an entity is a connected component of keys, named
by the least.  What is known is a table of keys and their entities; a new batch is joined with
it, only the entities that it touches are merged, and only what changes comes back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import step

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of undirected ``links`` (a, b).

    Rounds of large and small stars: every node sends its larger neighbours, then its smaller ones, to
    the smallest of them, until all hang on the smallest of their component.  Rows are never more
    than the links and the nodes.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = step(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "identity-links")
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = step(large, "identity-large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        small = step(small.unionByName(low.select("v", F.col("m").alias("u"))).filter("v <> u").distinct(), "identity-small")
        changed = small.join(now, ["v", "u"], "left_anti").limit(1).count() or now.join(small, ["v", "u"], "left_anti").limit(1).count()
        now = small
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("u", "node").alias("component"))


def identity_keys(normalized_name: Column, type: Column, outside_id: Column) -> Column:
    """The keys of a mention; without a name or type there is no key of those."""
    named = F.when(normalized_name.isNotNull() & (normalized_name != "") & type.isNotNull(), F.concat(F.lit("name:"), type, F.lit(":"), normalized_name))
    outside = F.when(outside_id.isNotNull() & (outside_id != ""), F.concat(F.lit("id:"), outside_id))
    return F.array_compact(F.array(outside, named))


def merged(known: DataFrame, mentions: DataFrame, keys: str = "keys") -> DataFrame:
    """The rows (key, entity) of ``known`` that a batch of mentions adds or changes.

    Keys that are known stand for their entity.  The batch's links are between entities and new keys,
    so components are found among what the batch touches; an entity that is merged into
    another changes the rows of all its keys.
    """
    batch = step(mentions.select(F.array_distinct(keys).alias("keys")).filter(F.size("keys") > 0).distinct(), "identity-batch")
    seen = batch.select(F.explode("keys").alias("key")).distinct().join(known.select("key", "entity"), "key", "left")
    seen = step(seen.select("key", F.coalesce("entity", "key").alias("now"), F.col("entity").isNull().alias("is_new")), "identity-seen")
    pairs = batch.select(F.element_at("keys", 1).alias("one"), F.explode("keys").alias("key")).distinct()
    ends = seen.select(F.col("key").alias("one"), F.col("now").alias("a"))
    links = pairs.join(ends, "one").join(seen.select("key", F.col("now").alias("b")), "key").select("a", "b").distinct()
    found = step(components(links), "identity-found")
    # an entity is named by its least key: a component's least node is that, as nodes are least keys or new keys
    new = seen.filter("is_new").join(found.withColumnRenamed("node", "now"), "now").select("key", F.col("component").alias("entity"))
    moved = found.filter("node <> component").select(F.col("node").alias("entity"), "component")
    changed = known.select("key", "entity").join(moved, "entity").select("key", F.col("component").alias("entity"))
    return new.unionByName(changed)


def entities(batches: Sequence[DataFrame], keys: str = "keys") -> DataFrame:
    """key and entity after all ``batches``, one after the other."""
    known = None
    for batch in batches:
        start = batch.sparkSession.createDataFrame([], "key string, entity string") if known is None else known
        new = step(merged(start, batch, keys), "identity-new")
        known = step(start.join(new.select("key"), "key", "left_anti").unionByName(new), "identity-known")
    return known
