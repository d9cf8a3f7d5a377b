"""Notifications: deduplication, routing, locales, templates, delivery reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCALES = ("en", "it", "de")
LEVELS = ("INFO", "WARNING", "CRITICAL")


def stable_key(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def once(notifications: DataFrame, *parts: str) -> DataFrame:
    """The first notification of each key (by ts, event_id), pre-aggregated."""
    first = notifications.groupBy(*parts).agg(F.min(F.struct("ts", "event_id")).alias("__first"))
    return notifications.join(first.select("__first.event_id"), "event_id", "left_semi")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def at_least(notifications: DataFrame, minimums: DataFrame) -> DataFrame:
    """Notifications at or over their category's minimum level; all of a category without one."""
    both = notifications.join(minimums, "category", "left")
    return both.filter(F.col("minimum").isNull() | (level_rank(F.col("level")) >= level_rank(F.col("minimum")))).drop("minimum")


def locale_of(wanted: Column) -> Column:
    short = F.lower(F.substring(wanted, 1, 2))
    return F.when(short.isin(*LOCALES), short).otherwise("en")


def eligible(status: Column, level: Column) -> Column:
    """Ended work and warnings produce notifications; progress and repeated states don't."""
    return F.coalesce(status.isin("FAILED", "SUCCEEDED") | (level_rank(level) >= 2), F.lit(False))


def filled(template: str, metadata: str = "props") -> Column:
    """A template's ``{event_type}`` and ``{metadata.name}`` from columns and a JSON payload."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{([A-Za-z_.]+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[1]
        value = F.get_json_object(metadata, "$." + name[9:]) if name.startswith("metadata.") else F.col(name).cast("string")
        parts.append(F.coalesce(value, F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def volume_report(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("category", "level", "status").agg(F.count("*").alias("n"))


def delivery_report(notifications: DataFrame) -> DataFrame:
    """Counts by delivery state and the error rate of each category."""
    n = lambda s: F.count_if(F.col("delivery") == s)
    return notifications.groupBy("category").agg(
        *[n(s).alias(s.lower().replace("-", "_")) for s in ("PENDING", "RETRYING", "FAILED", "DEAD-LETTER")], F.round((n("FAILED") + n("DEAD-LETTER")) / F.count("*"), 6).alias("error_rate")
    )


def unusual_days(notifications: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Days of a category whose volume is ``deviations`` from its mean or more.

    Counted by day first, so the window sees one row a day.
    """
    days = notifications.groupBy("category", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    over = Window.partitionBy("category")
    scored = days.withColumn("z", F.round((F.col("n") - F.avg("n").over(over)) / F.nullif(F.stddev_pop("n").over(over), F.lit(0.0)), 4))
    return scored.filter(F.abs("z") >= deviations)


def repeated_failures(events: DataFrame, window: str, threshold: int) -> DataFrame:
    """Users with ``threshold`` failures or more in a tumbling window."""
    failures = events.filter(F.col("event_type") == "error")
    counts = failures.groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= threshold).select(F.col("w.start").alias("start"), "user_id", "n")


def routed(notifications: DataFrame, rules: DataFrame) -> DataFrame:
    """Owner by the first matching rule of a category, escalated if unread past its minutes."""
    order = Window.partitionBy("event_id").orderBy("rule_priority", "rule_id")
    both = notifications.join(rules, "category").filter(level_rank(F.col("level")) >= level_rank(F.col("rule_level")))
    chosen = both.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1")
    late = F.col("unread_minutes") > F.col("escalate_after")
    return chosen.withColumn("recipient", F.when(late, F.col("escalate_to")).otherwise(F.col("owner"))).drop("__nth")


def audit_page(entries: DataFrame, members: DataFrame, offset: int, limit: int) -> DataFrame:
    """Entries whose actor is a member of the scope, newest first, one page."""
    return entries.join(members, "user_id", "left_semi").orderBy(F.desc("ts"), "event_id").offset(offset).limit(limit)


def audit_metadata(metadata: Column, denied: tuple[str, ...] = ("password", "token", "secret", "prompt", "text")) -> Column:
    """A map without its denied keys."""
    return F.map_filter(metadata, lambda k, v: ~F.lower(k).isin(*denied))
