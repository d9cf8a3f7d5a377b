import datetime as dt
import random

from pyspark.sql import functions as F

from quarrylens.operators import alarms

NEED = {"HIGH": 480, "MEDIUM": 960, "LOW": 2400}


def brute(org, created, severity, calendar):
    """Walks the calendar day by day."""
    if severity == "CRITICAL":
        return created.replace(microsecond=0) + dt.timedelta(hours=1)
    days = {d: (o, c) for g, d, o, c in calendar if g == org}
    if severity is None or not days or not min(days) <= created.date() <= max(days):
        return None
    left, day = NEED[severity], created.date()
    begin = created.hour * 60 + created.minute
    while day <= max(days):
        opens, closes = days.get(day, (0, 0))
        start = max(opens, begin) if day == created.date() else opens
        if closes > start:
            if closes - start >= left:
                return dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=start + left)
            left -= closes - start
        day += dt.timedelta(days=1)
    return None


def test_due_times_by_brute_force(spark):
    rng = random.Random(6)
    first = dt.date(2024, 1, 1)
    calendar = []
    for org in "abc":
        for k in range(60):
            if rng.random() < 0.8:  # others aren't there
                opens = rng.choice([0, 480, 540, 700])
                calendar.append((org, first + dt.timedelta(days=k), opens, opens + rng.choice([0, 1, 240, 480, 600]) if rng.random() < 0.9 else opens - 5))
    rows = [(n, rng.choice(["a", "a", "b", "c", "none", None]), dt.datetime(2023, 12, 30) + dt.timedelta(minutes=rng.randrange(66 * 1440), seconds=7), rng.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW", None])) for n in range(400)]
    got = alarms.with_calendar_due(spark.createDataFrame(rows, "n int, org string, created_at timestamp, severity string"), spark.createDataFrame(calendar, "org string, day date, opens int, closes int"))
    assert {r["n"]: r["due_at"] for r in got.collect()} == {n: brute(o, c, s, calendar) for n, o, c, s in rows} and got.count() == 400


def test_agrees_with_the_formula_without_holidays(spark):
    rows = spark.range(3000).select(F.col("id").alias("n"), F.lit("o").alias("org"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 17 % 40_000).cast("int"))).alias("created_at"), F.element_at(F.array(*[F.lit(s) for s in ("CRITICAL", *NEED)]), (F.col("id") % 4 + 1).cast("int")).alias("severity"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    calendar = spark.range(60).select(F.lit("o").alias("org"), day.alias("day"), F.lit(480).alias("opens"), F.when(F.weekday(day) < 5, 960).otherwise(480).alias("closes"))
    got = alarms.with_calendar_due(rows, calendar).withColumn("formula", alarms.sla_due(F.col("created_at"), F.col("severity")))
    assert got.filter(~F.col("due_at").eqNullSafe(F.col("formula"))).count() == 0 and got.count() == 3000
