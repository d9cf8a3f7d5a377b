import datetime as dt

from pyspark.sql import functions as F

from quarrylens.operators.alarms import ACTIVE
from quarrylens.streaming import streams, timers

START = dt.datetime(2024, 3, 1)
SCHEMA = "alarm_id bigint, ts timestamp, seq int, status string, due_at timestamp"


def at(hours):
    return None if hours is None else START + dt.timedelta(hours=hours)


def brute(changes, lead):
    """changes: (alarm, hour, seq, status, due hour), in order.  What each alarm is told by the end of time."""
    found = set()
    for alarm in {c[0] for c in changes}:
        own = sorted((h, seq, status, due) for a, h, seq, status, due in changes if a == alarm)
        status = due = None
        level, seen = 0, set()
        for k, (_, _, new, new_due) in enumerate(own):
            status, due = new or status, due if new_due is None else new_due
            until = own[k + 1][0] if k + 1 < len(own) else float("inf")
            if status not in ACTIVE or due is None:
                continue
            for kind, fires in (("reminded", due - lead), ("escalated", due)):
                if fires <= until and (kind, due) not in seen:
                    seen.add((kind, due))
                    level += kind == "escalated"
                    found.add((alarm, kind, at(fires), at(due), level))
    return found


def run(spark, batches, lead=2, **more):
    frames = [spark.createDataFrame([(a, at(h), seq, s, at(due)) for a, h, seq, s, due in b], SCHEMA) for b in batches]
    with timers.timer_state(spark):
        rows = streams.finished(timers.service_timers(streams.delivered(spark, frames), lead * 60, watermark="1 hour", **more))
    return [tuple(r) for r in rows.collect()]


TICK = [(0, 100_000, 1, "CLOSED", None)]


def test_an_alarm_with_no_further_event(spark):
    assert sorted(run(spark, [[(1, 0, 1, "OPEN", 10)], TICK])) == [(1, "escalated", at(10), at(10), 1), (1, "reminded", at(8), at(10), 0)]
    # not before the watermark passes: 30 hours are over, an hour's delay, and the tick is not there
    assert run(spark, [[(1, 0, 1, "OPEN", 10)], [(2, 10, 1, "OPEN", 90)]]) == [(1, "reminded", at(8), at(10), 0)]
    assert {r[1] for r in run(spark, [[(1, 0, 1, "OPEN", 10)], [(2, 12, 1, "OPEN", 90)]])} == {"reminded", "escalated"}


def test_changes_by_brute_force(spark):
    changes = [
        (1, 0, 1, "OPEN", 10), (1, 5, 2, None, 30), (1, 29, 3, "ACKNOWLEDGED", None),  # due later
        (2, 0, 1, "OPEN", 10), (2, 9, 2, "RESOLVED", None),  # reminded, not escalated
        (3, 0, 1, "OPEN", 10), (3, 3, 2, "CLOSED", None), (3, 40, 3, "OPEN", None),  # open again, long overdue
        (4, 0, 1, "OPEN", 10), (4, 10, 2, "CLOSED", None),  # closed when due: that comes first
        (5, 1, 1, "OPEN", None), (5, 1, 2, None, 3), (5, 6, 3, None, 8), (5, 20, 4, "IN_PROGRESS", 50),  # escalated three times
        (6, 2, 1, "RESOLVED", 4), (7, 0, 1, "OPEN", -5),
    ]
    want = brute(changes, 2)
    for batches in ([changes, TICK], [[c for c in changes if c[1] < 7], [c for c in changes if c[1] >= 7], TICK], [[c for c in changes if k <= c[1] < k + 10] for k in range(0, 50, 10)] + [TICK]):
        got = run(spark, batches)
        assert set(got) == want and len(got) == len(want)


def test_state_of_closed_alarms_goes(spark):
    """Closed at 1, kept for 3 hours: what comes at 60 is a new alarm; within 3 hours it is the old one."""
    tick = [(9, 30, 1, "CLOSED", None)]
    again = run(spark, [[(1, 0, 1, "OPEN", 0), (1, 1, 2, "CLOSED", None)], tick, [(9, 31, 1, "CLOSED", None)], [(1, 60, 3, "OPEN", 0)], TICK], keep_minutes=180)
    assert sorted((r[1], r[4]) for r in again if r[0] == 1) == [("escalated", 1), ("escalated", 1), ("reminded", 0), ("reminded", 0)]
    kept = run(spark, [[(1, 0, 1, "OPEN", 0), (1, 1, 2, "CLOSED", None)], tick, [(9, 31, 1, "CLOSED", None)], [(1, 60, 3, "OPEN", 0)], TICK], keep_minutes=60 * 500)
    assert sorted((r[1], r[4]) for r in kept if r[0] == 1) == [("escalated", 1), ("reminded", 0)]


def test_many_alarms_at_once(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 50).cast("int").alias("due"))
    batch = [(r["id"] + 1, 0, 1, "OPEN", r["due"] + 1) for r in rows.collect()]
    assert len(run(spark, [batch, TICK])) == 6000
