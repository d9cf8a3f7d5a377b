"""The knowledge graph in articles as tables of vertices, edges, assertions and event links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similar import counts_within
from .steps import blocks_for, step


def mentions(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("id").alias("article_id"), F.explode("entities").alias("e")).select("article_id", "e.id", "e.type", "e.name", "e.normalized_name", "e.confidence")


def vertices(articles: DataFrame) -> DataFrame:
    """One vertex for each (normalized_name, type), with the surest mention's name."""
    best = F.max(F.struct("confidence", "name"))
    return mentions(articles).groupBy("normalized_name", "type").agg(F.count("*").alias("n_mentions"), F.count_distinct("article_id").alias("n_articles"), F.max("confidence").alias("confidence"), best["name"].alias("name"))


def _read_once(articles: DataFrame, *columns: str) -> DataFrame:
    """Columns of articles, written.  Where arrays are exploded or joined with themselves, Spark
    would work out again what they are made of, for a filter on their size and for each use."""
    return step(articles.select(*columns), "graph-articles")


def _names(articles: DataFrame) -> DataFrame:
    """article_id, id and normalized_name of every mention, the first if an id is named twice."""
    rows = articles.select(F.col("id").alias("article_id"), F.posexplode("entities").alias("place", "e")).select("article_id", "place", "e.id", "e.normalized_name")
    return rows.groupBy("article_id", "id").agg(F.min_by("normalized_name", "place").alias("name"))


def edges(articles: DataFrame) -> DataFrame:
    """Edges between vertices, summed over articles.

    A relation names entities of its own article, so both ends are equi-joins on (article, id).
    """
    articles = _read_once(articles, "id", "entities", "relationships")
    rows = articles.select(F.col("id").alias("article_id"), F.explode("relationships").alias("r")).select("article_id", "r.source", "r.target", "r.predicate", "r.confidence")
    names = _names(articles)
    named = rows.withColumnRenamed("source", "id").join(names.withColumnRenamed("name", "source"), ["article_id", "id"], "left").drop("id")
    named = named.withColumnRenamed("target", "id").join(names.withColumnRenamed("name", "target"), ["article_id", "id"], "left")
    return named.groupBy("source", "target", "predicate").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def assertions(articles: DataFrame) -> DataFrame:
    """Claims as attributed assertions; never facts."""
    rows = articles.select(F.col("id").alias("article_id"), "provenance.parser_version", F.explode("claims").alias("c"))
    return rows.select("article_id", F.col("c.id").alias("claim_id"), F.col("c.type").alias("type"), F.col("c.confidence").alias("confidence"), F.col("c.source_entity_id").alias("attributed_to"), F.lit("CLAIM").alias("status"), F.size("c.evidence").alias("n_evidence"), "parser_version")


def evidence_with_provenance(articles: DataFrame) -> DataFrame:
    rows = articles.select(F.col("id").alias("article_id"), "raw_document_id", "provenance.extraction_time", F.explode("claims").alias("c"))
    rows = rows.select("article_id", "raw_document_id", "extraction_time", F.col("c.id").alias("claim_id"), F.explode("c.evidence").alias("v"))
    return rows.select("article_id", "raw_document_id", "claim_id", F.col("v.id").alias("evidence_id"), F.col("v.type").alias("type"), F.round("v.confidence", 4).alias("confidence"), "extraction_time")


def event_links(articles: DataFrame) -> DataFrame:
    """Each event with each participant and location, by name."""
    articles = _read_once(articles, "id", "entities", "events")
    rows = articles.select(F.col("id").alias("article_id"), F.explode("events").alias("e"))
    ends = F.concat(
        F.transform("e.participants", lambda x: F.struct(F.lit("participant").alias("role"), x.alias("id"))),
        F.transform("e.locations", lambda x: F.struct(F.lit("location").alias("role"), x.alias("id"))),
    )
    rows = rows.select("article_id", F.col("e.id").alias("event_id"), F.col("e.type").alias("event_type"), F.explode(ends).alias("x")).select("article_id", "event_id", "event_type", "x.role", "x.id")
    return rows.join(_names(articles), ["article_id", "id"], "left").select("article_id", "event_id", "event_type", "role", F.col("name").alias("entity"))


def event_overlap(articles: DataFrame, days: int) -> DataFrame:
    """article_id and n_overlaps: for each of an article's events, the events of other articles that have
    its type and a date within so many days; counted, never paired."""
    events = articles.select(F.col("id").alias("article_id"), F.explode_outer("events").alias("e"))
    events = step(events.select("article_id", F.col("e.type").alias("type"), F.unix_date("e.date").cast("long").alias("day")), "graph-events")
    rows = counts_within(events, ["type"], "day", days, "every")
    rows = counts_within(rows, ["type", "article_id"], "day", days, "own")
    return rows.groupBy("article_id").agg(F.sum(F.col("every") - F.col("own")).alias("n_overlaps"))


BLOCK = 2048  # sets that meet others in one task
TILE = 128  # of them that are compared at once
NAMES = 4096  # names that a comparison takes at once


def _common(column: np.ndarray, owner: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with the sets ``others``; the k-th entry says
    that set owner[k] has the name column[k]."""
    at = np.full((2, max(rows.max(), others.max(), owner.max()) + 1), -1)
    at[0, rows], at[1, others] = np.arange(len(rows)), np.arange(len(others))
    mine = at[0, owner] >= 0
    names, own = np.unique(column[mine], return_inverse=True)
    number = np.full(column.max() + 1, -1)
    number[names] = np.arange(len(names))
    theirs = (at[1, owner] >= 0) & (number[column] >= 0)
    left, right, other = at[0, owner[mine]], at[1, owner[theirs]], number[column[theirs]]
    out = np.zeros((len(rows), len(others)))
    for a in range(0, len(names), NAMES):
        one, two = (np.zeros((n, min(NAMES, len(names) - a)), np.float32) for n in out.shape)
        some = (own >= a) & (own < a + NAMES)
        one[left[some], own[some] - a] = 1
        some = (other >= a) & (other < a + NAMES)
        two[right[some], other[some] - a] = 1
        out += one @ two.T
    return out


def shared_entities(articles: DataFrame, min_share: float) -> DataFrame:
    """article_id, n_links and best_share: other articles whose entities overlap by ``min_share``
    (Jaccard) or more, exact.

    Articles with equal sets are one class.  Two sets that overlap so much share one of their
    rarest names, as many as a share below would miss, so classes meet at those names only
    (prefix filter), in blocks where a name is frequent.  A pair counts at the rarest name it
    shares, so what it has in common is no more than either set has from there on: pairs for
    which this or their sizes leave too little are not compared (positional filter).  Tasks
    return counts for each class, never pairs.
    """
    names = step(mentions(articles).select("article_id", "normalized_name").distinct(), "graph-names")
    df = names.groupBy("normalized_name").agg(F.count("*").alias("df"))
    keyed = names.join(df, "normalized_name").select("article_id", F.struct("df", F.xxhash64("normalized_name").alias("h")).alias("t"))
    sets = keyed.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["h"]).alias("names"))
    sets = step(sets.withColumn("class", F.md5(F.to_json("names"))), "graph-sets")
    classes = sets.groupBy("class").agg(F.count("*").alias("weight"), F.first("names").alias("names"))
    prefix = F.size("names") - F.ceil(F.size("names") * F.lit(min_share) - 1e-9).cast("int") + 1
    met = step(classes.select("class", "weight", "names", F.explode(F.slice("names", F.lit(1), prefix)).alias("name")), "graph-prefixes")
    count = met.groupBy("name").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1")
    parts = blocks_for(count.filter("blocks = 1").agg(F.sum("n")).first()[0] or 0, BLOCK)
    dealt = met.join(count.drop("n"), "name").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    frequent = F.col("blocks") > 1  # a group has a pair of blocks of such a name, or many of the other names
    unit = F.when(frequent, F.col("name")).otherwise(F.pmod("name", F.lit(parts)))
    dealt = dealt.select(frequent.alias("frequent"), unit.alias("unit"), "name", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class", "weight", "names")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        own = part["lo"].iloc[0] == part["hi"].iloc[0]
        part = part.iloc[np.argsort(part["name"].to_numpy(), kind="stable")]
        name, sizes = part["name"].to_numpy(), part["names"].map(len).to_numpy()
        flat = np.concatenate(part["names"].to_list())
        owner = np.repeat(np.arange(len(part)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = place[flat == np.repeat(name, sizes)]  # each set has its name once
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column, before = owner[shared], column[shared], place[shared] < at[owner[shared]]
        blocks, weight = part["block"].to_numpy(), part["weight"].to_numpy()
        links, best = np.zeros(len(part), np.int64), np.zeros(len(part))
        for a in range(0, len(part), TILE):
            tile = np.arange(a, min(a + TILE, len(part)))
            near = np.arange(np.searchsorted(name, name[tile[0]]), np.searchsorted(name, name[tile[-1]], "right"))  # all with the tile's names
            most = np.minimum((sizes - at)[tile, None], (sizes - at)[near])
            may = (name[tile, None] == name[near]) & (most >= (min_share - 1e-9) * (sizes[tile, None] + sizes[near] - most))
            may &= tile[:, None] != near if own else blocks[tile, None] != blocks[near]
            rows, others = tile[may.any(1)], near[may.any(0)]
            if not len(rows):
                continue
            may = may[np.ix_(rows - a, others - near[0])]
            span = slice(*np.searchsorted(owner, [near[0], near[-1] + 1]))
            both = _common(column[span], owner[span], rows, others)
            share = both / (sizes[rows, None] + sizes[others] - both)
            linked = may & (share >= min_share - 1e-9)
            some, few = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if len(some):  # pairs that share a rarer name count there
                early = before[span]
                if early.any():
                    rarer = _common(column[span][early], owner[span][early], rows[some], others[few])
                    linked[np.ix_(some, few)] &= rarer == 0
            links[rows] = linked @ weight[others]
            best[rows] = np.where(linked, share, 0).max(1)
        some = np.flatnonzero(links)
        return pd.DataFrame({"class": part["class"].to_numpy()[some], "links": links[some], "best": best[some]})

    found = dealt.groupBy("frequent", "unit", "lo", "hi").applyInPandas(compare, "class string, links bigint, best double")
    found = classes.select("class", "weight").join(found.groupBy("class").agg(F.sum("links").alias("links"), F.max("best").alias("best")), "class", "left")
    rows = articles.select(F.col("id").alias("article_id")).join(sets.select("article_id", "class"), "article_id", "left").join(found, "class", "left")
    links = F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0))
    return rows.select("article_id", links.cast("long").alias("n_links"), F.when(links > 0, F.round(F.when(F.col("weight") > 1, 1.0).otherwise(F.col("best")), 6)).alias("best_share"))
