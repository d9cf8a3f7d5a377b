"""Alarms from events: keys, deduplication, episodes, service levels, retention, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import running_sum, step

# Time to the service level, in minutes; working time runs 8 to 16 on weekdays.
SLA_MINUTES = {"CRITICAL": 60, "HIGH": 8 * 60, "MEDIUM": 2 * 480, "LOW": 5 * 480}
WORK_START, WORK_MINUTES = 8 * 60, 8 * 60
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
ACTIVE = ("OPEN", "ACKNOWLEDGED", "IN_PROGRESS")
# The legal status transitions; those for administrators only, and those not for plain users.
TRANSITIONS = (
    ("OPEN", "ACKNOWLEDGED"), ("OPEN", "IN_PROGRESS"), ("OPEN", "RESOLVED"), ("ACKNOWLEDGED", "IN_PROGRESS"), ("ACKNOWLEDGED", "RESOLVED"),
    ("IN_PROGRESS", "RESOLVED"), ("RESOLVED", "CLOSED"), ("RESOLVED", "IN_PROGRESS"), ("CLOSED", "OPEN"),
)
ADMINISTRATOR_ONLY = (("CLOSED", "OPEN"),)
NOT_FOR_USERS = (("RESOLVED", "CLOSED"),)


def alarm_key(*parts: str) -> Column:
    """Idempotency key from a template of columns."""
    return F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts])


def severity_of(value: Column) -> Column:
    return F.when(value >= 40, "CRITICAL").when(value >= 20, "HIGH").when(value >= 10, "MEDIUM").otherwise("LOW")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def alarm_history(events: DataFrame) -> DataFrame:
    """Alarms from ``events`` (alarm_key, event_id, ts, severity, closes): one row for each alarm.

    An event whose key has an alarm that isn't closed adds to its occurrences and last time, and
    changes nothing else; its severity stays that of the first event.  A closing event (``closes``)
    closes the key's alarm.  The next event with that key opens a new alarm, which names the one
    before.  Events are in order of (ts, event_id).
    """
    rows = events.withColumns({"__day": F.to_date("ts"), "__one": F.col("closes").cast("int")})
    rows = running_sum(rows, ["alarm_key"], "__day", ["ts", "event_id"], "__one", "closings")
    alarms = rows.filter("NOT closes").groupBy("alarm_key", "closings").agg(
        F.min(F.struct("ts", "event_id", "severity")).alias("first"), F.count("*").alias("occurrence_count"), F.max("ts").alias("last_at")
    )
    closed = rows.filter("closes").groupBy("alarm_key", "closings").agg(F.min("ts").alias("closed_at"))
    found = alarms.join(closed, ["alarm_key", "closings"], "left")
    before = F.lag("first.event_id").over(Window.partitionBy("alarm_key").orderBy("closings"))
    return found.select(
        "alarm_key", F.col("first.event_id").alias("alarm_id"), before.alias("previous_alarm_id"), F.col("first.severity").alias("severity"), "occurrence_count",
        (F.col("occurrence_count") - 1).alias("n_ignored"), F.col("first.ts").alias("first_at"), "last_at", "closed_at", F.when(F.col("closed_at").isNull(), "OPEN").otherwise("CLOSED").alias("status"),
    )


def deduplicated(events: DataFrame) -> DataFrame:
    """The alarm that is open now for each key that has one."""
    return alarm_history(events).filter("status = 'OPEN'")


def reopened(events: DataFrame) -> DataFrame:
    """Alarms that follow a closed one with the same key."""
    return alarm_history(events).filter("previous_alarm_id IS NOT NULL")


def episodes(events: DataFrame, gap: str) -> DataFrame:
    """Alarms of a key that begin anew after a quiet ``gap``: one row each, with the alarm before.

    A key's events are taken day by day, so that no task has all of a hot key.  Events without a key
    or time are left out.
    """
    day = F.to_date("ts")
    rows = events.withColumn("__day", day)
    # a day's first event looks back to the last one of its key's day before, others within their day
    days = rows.groupBy("alarm_key", "__day").agg(F.max("ts").alias("__last"))
    days = days.select("alarm_key", "__day", F.lag("__last").over(Window.partitionBy("alarm_key").orderBy("__day")).alias("__earlier"))
    in_day = Window.partitionBy("alarm_key", "__day").orderBy("ts", "event_id")
    rows = rows.join(days, ["alarm_key", "__day"])
    fresh = F.coalesce(F.col("ts") - F.coalesce(F.lag("ts").over(in_day), "__earlier") > F.expr(f"INTERVAL {gap}"), F.lit(True))
    rows = rows.withColumn("fresh", fresh.cast("int"))
    numbered = running_sum(rows, ["alarm_key"], "__day", ["ts", "event_id"], "fresh", "__before").withColumn("episode", F.col("__before") + F.col("fresh"))
    alarms = numbered.groupBy("alarm_key", "episode").agg(F.count("*").alias("occurrence_count"), F.min_by("event_id", F.struct("ts", "event_id")).alias("alarm_id"))
    return alarms.withColumn("previous_alarm_id", F.lag("alarm_id").over(Window.partitionBy("alarm_key").orderBy("episode")))


def illegal_transitions(history: DataFrame) -> DataFrame:
    """Status changes (alarm_id, nth, status, profile of the actor) that aren't allowed.

    A closed alarm is opened again by administrators only, and plain users don't close alarms.
    """
    before = F.lag("status").over(Window.partitionBy("alarm_id").orderBy("nth"))
    change = F.concat_ws(">", "before", "status")
    among = lambda table: change.isin(*[f"{a}>{b}" for a, b in table])
    profile = F.coalesce("profile", F.lit(""))
    legal = among(TRANSITIONS) & (~among(ADMINISTRATOR_ONLY) | (profile == "ADMINISTRATOR")) & (~among(NOT_FOR_USERS) | (profile != "USER"))
    return history.withColumn("before", before).filter(F.col("before").isNotNull() & ~legal)


def sla_due(created: Column, severity: Column) -> Column:
    """When the alarm is due; only CRITICAL counts the clock, others working minutes.

    Working minutes are counted from the creation, or from the next working morning if that is
    outside working time.
    """
    day = F.date_trunc("DAY", created)
    minute = F.floor((F.unix_seconds(created) - F.unix_seconds(day)) / 60)
    weekday = F.weekday(created)  # Monday is 0
    # working days and minutes since the Monday of that week
    days = F.least(weekday, F.lit(5))
    inside = F.when(weekday >= 5, 0).otherwise(F.least(F.greatest(minute - WORK_START, F.lit(0)), F.lit(WORK_MINUTES)))
    need = F.coalesce(*[F.when(severity == s, m) for s, m in SLA_MINUTES.items()])
    total = days * WORK_MINUTES + inside + need
    # a deadline at the end of a working day stays on that day
    whole, rest = F.floor((total - 1) / WORK_MINUTES), (total - 1) % WORK_MINUTES + 1
    monday = F.date_sub(F.to_date(created), weekday)
    due_day = F.date_add(monday, (F.floor(whole / 5) * 7 + whole % 5).cast("int"))
    working = F.timestamp_seconds(F.unix_seconds(due_day.cast("timestamp")) + (rest + WORK_START) * 60)
    return F.when(severity == "CRITICAL", F.timestamp_seconds(F.unix_seconds(created) + 3600)).when(severity.isNotNull(), working)


def with_escalation(alarms: DataFrame, now: Column) -> DataFrame:
    """``overdue`` and ``level``: past due and active raises the level by one.

    RESOLVED stops the service level; CLOSED stops escalation too.
    """
    active = F.col("status").isin(*ACTIVE)
    overdue = active & (now > F.col("due_at"))
    return alarms.withColumn("overdue", overdue).withColumn("level", F.col("level") + F.when(overdue, 1).otherwise(0))


def with_new_severity(alarms: DataFrame, changes: DataFrame) -> DataFrame:
    """Severity changes (alarm_id, new_severity); the due time follows unless RESOLVED or CLOSED."""
    both = alarms.join(changes, "alarm_id", "left")
    severity = F.coalesce("new_severity", "severity")
    open_ones = F.col("new_severity").isNotNull() & ~F.col("status").isin("RESOLVED", "CLOSED")
    return both.withColumn("due_at", F.when(open_ones, sla_due(F.col("created_at"), severity)).otherwise(F.col("due_at"))).withColumn("severity", severity).drop("new_severity")


FILTERS = ("status", "severity", "recipient_type", "organization", "recipient_user", "responsible_user", "source_type", "overdue")


def filtered(alarms: DataFrame, **given) -> DataFrame:
    """Optional filters, all of those given: those of FILTERS by a value or a list of values, and
    created_from (included) and created_to (not)."""
    for name in FILTERS:
        value = given.pop(name, None)
        if value is not None:
            alarms = alarms.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == F.lit(value))
    begin, end = given.pop("created_from", None), given.pop("created_to", None)
    if given:
        raise ValueError(f"unknown filters: {sorted(given)}")
    if begin is not None:
        alarms = alarms.filter(F.col("created_at") >= F.lit(begin))
    return alarms.filter(F.col("created_at") < F.lit(end)) if end is not None else alarms


def visible(alarms: DataFrame, profile: str, tenant=None, org=None, user_id=None) -> DataFrame:
    """What a viewer may see: ADMINISTRATOR all, TENANT its tenant's, ORGANIZATION its
    organization's, USER its own."""
    rules = {"ADMINISTRATOR": F.lit(True), "TENANT": F.col("tenant") == F.lit(tenant), "ORGANIZATION": F.col("org") == F.lit(org), "USER": F.col("user_id") == F.lit(user_id)}
    if profile not in rules:
        raise ValueError(f"unknown profile: {profile}")
    return alarms.filter(rules[profile])


def timeline(history: DataFrame, alarm_id) -> DataFrame:
    return history.filter(F.col("alarm_id") == F.lit(alarm_id)).orderBy("nth")


def summary(alarms: DataFrame, now: Column, retention_days: int = 365) -> DataFrame:
    """One row of counts."""
    old = (F.col("status") == "CLOSED") & (F.col("closed_at") < now - F.expr(f"INTERVAL {int(retention_days)} DAYS"))
    return alarms.agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if("overdue").alias("overdue"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"), F.count_if(old & F.col("archived_at").isNull()).alias("retention_candidates"),
    )


def archived(alarms: DataFrame, now: Column, retention_days: int = 365) -> DataFrame:
    """``alarms`` with ``archived_at`` set on closed ones past retention; nothing is deleted."""
    old = (F.col("status") == "CLOSED") & (F.col("closed_at") < now - F.expr(f"INTERVAL {int(retention_days)} DAYS"))
    return alarms.withColumn("archived_at", F.coalesce("archived_at", F.when(old, now)))


def reminders(alarms: DataFrame, now: Column, lead_minutes: int) -> DataFrame:
    """Active alarms due within the lead time."""
    return alarms.filter(F.col("status").isin(*ACTIVE) & (F.col("due_at") > now) & (F.col("due_at") <= now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lead_minutes))))


def allowed_actions(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Requests (profile, action) with ``allowed``, from a small table of permissions."""
    return requests.join(permissions.select("profile", "action", F.lit(True).alias("allowed")).distinct(), ["profile", "action"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def scope_faults(alarms: DataFrame, users: DataFrame) -> DataFrame:
    """alarm_id and fault: unknown recipient, responsible user of another organization."""
    known = users.select(F.col("user_id").alias("responsible"), F.col("org").alias("responsible_org"))
    both = alarms.join(known, "responsible", "left")
    fault = F.when(F.col("responsible_org").isNull(), "no such user").when(F.col("responsible_org") != F.col("org"), "other organization")
    return both.withColumn("fault", fault).filter("fault IS NOT NULL").select("alarm_id", "fault")


CALENDAR_STEP = 480  # working minutes of a bucket of the calendar


def summed_calendar(calendar: DataFrame) -> DataFrame:
    """org, day, opens, minutes worked and ``before``, the minutes worked on the days before, for every
    day from an organization's first to its last.

    calendar: org, day, opens and closes (minutes of the day).  A day that isn't there, or doesn't open,
    isn't worked; of several rows for one day the first to open counts.
    """
    given = calendar.filter("org IS NOT NULL AND day IS NOT NULL").groupBy("org", "day").agg(F.min(F.struct("opens", "closes")).alias("d"))
    span = given.groupBy("org").agg(F.sequence(F.min("day"), F.max("day")).alias("days")).select("org", F.explode("days").alias("day"))
    days = span.join(given, ["org", "day"], "left").select("org", "day", F.coalesce("d.opens", F.lit(0)).alias("opens"), F.coalesce(F.greatest(F.col("d.closes") - F.col("d.opens"), F.lit(0)), F.lit(0)).alias("minutes"))
    return days.withColumn("before", F.sum("minutes").over(Window.partitionBy("org").orderBy("day")) - F.col("minutes"))


def with_calendar_due(alarms: DataFrame, calendar: DataFrame) -> DataFrame:
    """``alarms`` (org, created_at, severity) with ``due_at`` by the calendar of their organization.

    CRITICAL counts the clock; others count working minutes from the creation on, and a deadline at
    the end of a working day stays on that day.  Null without a severity, for an organization without
    a calendar, and where the calendar begins after the creation or ends before the deadline.

    Working minutes are summed along an organization's days.  The creation's day gives the sum so far;
    the day on which the sum passes what the alarm needs is the last one that begins before, which an
    as-of join finds: days are dealt to the buckets of the sum that they touch, so it is an equi-join.
    """
    days = step(summed_calendar(calendar), "alarms-calendar")
    today = days.select("org", F.col("day").alias("__day"), F.col("opens").alias("__opens"), F.col("minutes").alias("__minutes"), F.col("before").alias("__before"))
    minute = F.floor((F.unix_seconds("created_at") - F.unix_seconds(F.date_trunc("DAY", F.col("created_at")))) / 60)
    need = F.coalesce(*[F.when(F.col("severity") == s, m) for s, m in SLA_MINUTES.items() if s != "CRITICAL"])
    worked = F.least(F.greatest(minute - F.col("__opens"), F.lit(0)), F.col("__minutes"))
    rows = alarms.withColumn("__day", F.to_date("created_at")).join(today, ["org", "__day"], "left").withColumn("__until", F.col("__before") + worked + need)
    rows = rows.withColumn("__bucket", F.floor((F.col("__until") - 1) / CALENDAR_STEP)).drop("__day", "__opens", "__minutes", "__before")
    touched = F.sequence(F.floor(F.col("before") / CALENDAR_STEP), F.floor((F.col("before") + F.col("minutes") - 1) / CALENDAR_STEP))
    ends = days.filter("minutes > 0").select("org", F.col("day").alias("__on"), F.col("opens").alias("__from"), F.col("minutes").alias("__length"), F.col("before").alias("__sum"), F.explode(touched).alias("__bucket"))
    reached = (F.col("__until") > F.col("__sum")) & (F.col("__until") <= F.col("__sum") + F.col("__length"))
    found = rows.alias("a").join(ends.alias("b"), (F.col("a.org") == F.col("b.org")) & (F.col("a.__bucket") == F.col("b.__bucket")) & reached, "left")
    due = F.timestamp_seconds(F.unix_seconds(F.col("__on").cast("timestamp")) + (F.col("__from") + F.col("__until") - F.col("__sum")) * 60)
    due = F.when(F.col("severity") == "CRITICAL", F.timestamp_seconds(F.unix_seconds("created_at") + SLA_MINUTES["CRITICAL"] * 60)).otherwise(due)
    return found.select(*[F.col(f"a.{c}") for c in alarms.columns if c != "due_at"], due.alias("due_at"))
