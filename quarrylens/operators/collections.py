"""Writes to a collection: replace-or-insert, delete, unique keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import step


def upserted(existing: DataFrame, new: DataFrame, key: str = "id", newest: Sequence = ()) -> DataFrame:
    """``existing`` with whole rows of ``new`` in place of, or added to, those with the same key.

    Of several new rows with one key the first by ``newest`` wins (all orders, then all columns).
    """
    if newest:
        order = Window.partitionBy(key).orderBy(*newest)
        new = new.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(existing: DataFrame, key: str, value) -> DataFrame:
    """``existing`` without the rows with that key; rows with a null key stay."""
    return existing.filter(~F.col(key).eqNullSafe(F.lit(value)))


def holds(existing: DataFrame, key: str, value) -> DataFrame:
    """One row, ``removed``: whether a delete of that key would remove a row."""
    return existing.filter(F.col(key) == F.lit(value)).agg((F.count("*") > 0).alias("removed"))


def replaced_by_parent(existing: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete-then-insert of all rows of the parents that ``new`` brings; running twice is the same."""
    return existing.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def unique_first(df: DataFrame, keys: Sequence[str], order: Sequence, exempt_nulls: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows kept and rows rejected under a unique key: the first of each by ``order`` stays.

    Rows with a null in the key are exempt, or, if not ``exempt_nulls``, nulls are values too.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    marked = df.withColumn("__ok", (nth == 1) | (~whole if exempt_nulls else F.lit(False)))
    return marked.filter("__ok").drop("__ok"), marked.filter("NOT __ok").drop("__ok")


ROWS_IN_TASK = 200_000  # undecided rows of a scope that one task walks through


def unique_by_two(df: DataFrame, scope: str, one: str, two: str, order: Sequence[str], rows_in_task: int | None = None) -> DataFrame:
    """``df`` with ``accepted`` and ``reason`` (the key that is taken) under two unique keys,
    (scope, one) and (scope, two).

    A row rejected for one key doesn't occupy the other, as if rows came one by one.  Null keys are
    exempt.  A scope of up to ``rows_in_task`` rows is walked through by a task, one by one.  Larger
    ones are decided in rounds, of minima and equi-joins: undecided rows that come first for both
    their keys are accepted; undecided rows that share a key with an accepted one are rejected.
    Each round writes what it marks, and a scope goes to a task when few of its rows are left.
    """
    rows_in_task = ROWS_IN_TASK if rows_in_task is None else rows_in_task
    at = F.struct(*order, "id")
    # ranks stand for the order inside tasks
    rows = step(df.select("id", F.to_json(F.struct(scope)).alias("__scope"), scope, one, two, at.alias("at")), "unique-rows")
    kind = rows.schema["id"].dataType.simpleString()
    keyed = lambda df: df.withColumns({"__one": F.when(F.col(one).isNotNull(), F.to_json(F.struct(one))), "__two": F.when(F.col(two).isNotNull(), F.to_json(F.struct(two)))})

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("nth")
        seen: set = set()
        kept = []
        for a, b in zip(part["__one"], part["__two"]):
            mine = {("one", a)} if a is not None else set()
            mine |= {("two", b)} if b is not None else set()
            kept.append(not mine & seen)
            seen |= mine if kept[-1] else set()
        return part.loc[kept, ["id"]]

    left, taken = rows, []
    while True:
        sizes = step(left.groupBy("__scope").agg(F.count("*").alias("n")), "unique-sizes")
        small = left.join(sizes.filter(F.col("n") <= rows_in_task).select("__scope"), "__scope", "left_semi")
        nth = F.row_number().over(Window.partitionBy("__scope").orderBy("at"))
        walked = keyed(small).withColumn("nth", nth).select("__scope", "id", "__one", "__two", "nth").groupBy("__scope").applyInPandas(walk, f"id {kind}")
        taken.append(step(rows.join(walked, "id", "left_semi").select("id", scope, one, two), "unique-accepted"))
        if not sizes.filter(F.col("n") > rows_in_task).limit(1).count():
            break
        left = left.join(sizes.filter(F.col("n") > rows_in_task).select("__scope"), "__scope", "left_semi")
        first = lambda k, name: left.filter(F.col(k).isNotNull()).groupBy(scope, k).agg(F.min("at").alias(name))  # noqa: B023, E731
        both = left.join(first(one, "first_one"), [scope, one], "left").join(first(two, "first_two"), [scope, two], "left")
        good = lambda k, name: F.col(k).isNull() | (F.col("at") == F.col(name))
        marked = step(both.select(*rows.columns, (good(one, "first_one") & good(two, "first_two")).alias("good")), "unique-marked")
        now = marked.filter("good").select("id", scope, one, two)
        taken.append(now)
        left = marked.filter("NOT good").drop("good")
        for k in (one, two):
            left = left.join(now.select(scope, k).distinct(), [scope, k], "left_anti").select(*rows.columns)
    accepted = reduce(DataFrame.unionByName, taken)
    out = df.join(accepted.select("id", F.lit(True).alias("accepted")), "id", "left").join(_taken_before(rows, accepted, scope, one, two), "id", "left")
    reason = F.when(F.col("accepted"), None).when(F.col("__by_one"), one).otherwise(two)
    return out.withColumn("reason", reason).withColumn("accepted", F.coalesce("accepted", F.lit(False))).select(*df.columns, "accepted", "reason")


def _taken_before(rows: DataFrame, taken: DataFrame, scope: str, one: str, two: str) -> DataFrame:
    """id and __by_one: whether a row's first key was taken by an earlier one."""
    own = taken.select("id").join(rows, "id").filter(F.col(one).isNotNull()).select(scope, one, F.col("at").alias("__at"))
    return rows.join(own, [scope, one]).filter(F.col("__at") < F.col("at")).select("id", F.lit(True).alias("__by_one"))
