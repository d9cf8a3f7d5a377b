"""Joins by nearness: texts within an edit distance, values within a width.  Neither makes pairs that it
doesn't need: equal values are one class, and what is found is counted where it is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import blocks_for, running_sum, step

# --- texts within an edit distance ---


def _part(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of ``parts`` even parts of a text."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    first_longer = parts - longer
    return base * i + F.greatest(i - first_longer, F.lit(0)), base + F.when(i >= first_longer, 1).otherwise(0)


def _signature(length: Column, i: Column, piece: Column) -> Column:
    return F.xxhash64(length.cast("int"), i.cast("int"), piece)


def near_texts(rows: DataFrame, distance: int = 2) -> DataFrame:
    """id, class_id, n_links and nearest for every row of ``rows`` (id, text), exact.

    A row is linked with all rows whose text is within ``distance`` insertions, deletions or changes of
    its own.  Rows of equal texts are a class (class_id, its least id).  A null or empty text
    is in no class and linked with nothing.

    If a text is cut into ``distance`` + 1 parts, one of them stands unchanged in any other text within
    the distance, shifted by so much at most.  So every class is indexed by its parts, and looks
    for the parts of no longer ones in itself.  Lookups that meet nobody are dropped before texts
    are attached; a pair is checked where it meets first, in the join, and only counts leave it.
    """
    parts, d = distance + 1, distance
    usable = rows.filter("text IS NOT NULL AND text <> ''")
    classes = usable.groupBy("text").agg(F.min("id").alias("class_id"), F.count("*").alias("weight"))
    classes = step(classes.select("*", F.monotonically_increasing_id().alias("class"), F.char_length("text").alias("length")), "near-classes")

    i = F.explode(F.sequence(F.lit(0), F.lit(d))).alias("i")
    index = classes.select("class", "text", "length", i)
    at, size = _part(F.col("length"), F.col("i"), parts)
    index = step(index.select("class", "i", _signature(F.col("length"), F.col("i"), F.substring("text", at + 1, size)).alias("sig")), "near-index")

    looks = classes.select("class", "text", "length", i).select("*", F.explode(F.sequence(F.greatest(F.col("length") - d, F.lit(1)), F.col("length"))).alias("other"))
    at, size = _part(F.col("other"), F.col("i"), parts)
    starts = F.sequence(F.greatest(at - d, F.lit(0)), F.greatest(F.greatest(at - d, F.lit(0)), F.least(at + d, F.col("length") - size)))
    looks = looks.withColumns({"__size": size, "__starts": starts})
    found = F.array_distinct(F.transform("__starts", lambda p: _signature(F.col("other"), F.col("i"), F.substring("text", p + 1, F.col("__size")))))
    looks = looks.select("class", "i", F.explode(found).alias("sig"))
    held = index.groupBy("sig").agg(F.count("*").alias("n"), F.min("class").alias("one"))
    looks = step(looks.join(held, "sig").filter((F.col("n") > 1) | (F.col("one") != F.col("class"))).select("sig", "i", "class"), "near-looks")

    text = classes.select("class", "text", "length", "weight")
    named = lambda df, prefix: df.select("sig", *["i"] * (prefix == "b"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("class", "text", "length", "weight")])
    one = named(index.join(looks.select("sig").distinct(), "sig", "left_semi").drop("i").join(text, "class"), "a")
    two = named(looks.join(text, "class"), "b")
    meets = []  # whether the a's part k stands in b
    for k in range(parts):
        at, size = _part(F.col("a_length"), F.lit(k), parts)
        window = F.substring("b_text", F.greatest(at - d, F.lit(0)) + 1, F.least(at, F.lit(d)) + size + d)
        meets.append(F.instr(window, F.substring("a_text", at + 1, size)) > 0)
    first = F.coalesce(*[F.when(m, k) for k, m in enumerate(meets)])
    ordered = (F.col("a_length") < F.col("b_length")) | ((F.col("a_length") == F.col("b_length")) & (F.col("a_class") < F.col("b_class")))
    away = F.levenshtein("a_text", "b_text", d)
    links = one.join(two, "sig").filter(ordered & (F.col("b_length") - F.col("a_length") <= d) & (first == F.col("i")) & (away >= 0))
    ends = F.array(F.struct(F.col("a_class").alias("class"), F.col("b_weight").alias("weight")), F.struct(F.col("b_class").alias("class"), F.col("a_weight").alias("weight")))
    links = links.select(away.alias("away"), F.explode(ends).alias("x")).groupBy("x.class").agg(F.sum("x.weight").alias("links"), F.min("away").alias("away"))

    known = classes.join(links, "class", "left").select("text", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("weight") > 1, 0).otherwise(F.col("away")).alias("nearest"))
    return rows.join(known, "text", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "nearest")


# --- values within a width ---

CLASS_BUCKET = 4096


def counts_within(rows: DataFrame, keys: list[str], at: str, width: int, out: str = "n_within") -> DataFrame:
    """``rows`` with ``out``: how many rows of the same keys have ``at`` (a whole number) within
    ``width`` of their own, themselves included; 0 where a key or ``at`` is null.

    Equal values are one class.  A class's count is a difference of two running totals, up to ``at`` +
    ``width`` and before ``at`` - ``width``; totals go over buckets of values, so a hot key spreads
    over tasks, and nothing is paired.
    """
    whole = F.col(at).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    classes = rows.filter(whole).groupBy(*keys, F.col(at).cast("long").alias("__at")).agg(F.count("*").alias("__n"))
    low, high, n = classes.agg(F.min("__at"), F.max("__at"), F.count("*")).first()
    span = 1 if not n else max(1, (high - low + 2 * width) // blocks_for(n, CLASS_BUCKET))
    mark = lambda shift, kind, n: F.struct((F.col("__at") + shift).alias("__to"), F.lit(kind).alias("__kind"), n.cast("long").alias("__more"))
    marks = classes.select(*keys, "__at", F.explode(F.array(mark(-width, 0, F.lit(0)), mark(0, 1, F.col("__n")), mark(width, 2, F.lit(0)))).alias("m"))
    marks = marks.select(*keys, "__at", "m.*").withColumn("__bucket", F.floor(F.col("__to") / span))
    totals = running_sum(marks, keys, "__bucket", ["__to", "__kind"], "__more", "__before")
    within = totals.filter("__kind <> 1").groupBy(*keys, "__at").agg(F.sum(F.when(F.col("__kind") == 2, F.col("__before")).otherwise(-F.col("__before"))).alias(out))
    return rows.withColumn("__at", F.col(at).cast("long")).join(within, [*keys, "__at"], "left").drop("__at").withColumn(out, F.coalesce(out, F.lit(0)))
