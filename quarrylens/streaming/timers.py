"""Reminders and escalation of alarms as event-time timers: an alarm that nothing more happens to is
reminded and escalated when the watermark passes its time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alarms import ACTIVE

OUT = "alarm_id bigint, kind string, at timestamp, due_at timestamp, level int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MINUTE = 60_000  # milliseconds
BUCKETS = 1024  # of alarms; fixed for the life of a stream
NOBODY = -1  # the bucket of rows without an alarm_id
NEVER = -(1 << 62)  # no such time
ALARM = {"alarm_id": "int64", "status": object, "due": "int64", "level": "int64", "reminded": "int64", "escalated": "int64", "last": "int64"}
ALARM_ROWS = pa.schema([(c, pa.string() if kind is object else pa.int64()) for c, kind in ALARM.items()])
CHANGE_ROWS = pa.schema([("alarm_id", pa.int64()), ("at", pa.int64()), ("status", pa.string())])


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB state store; it is set for the streams that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class ServiceTimers(StatefulProcessor):
    """State of a bucket of alarms: for each alarm its status, due time and level, for which due times it was
    reminded and escalated, and the times of its last changes (oldest first, ``kept`` at most).

    A call for each alarm, with its own reads and writes of state, costs milliseconds; so alarms
    are dealt to BUCKETS by hash, a bucket's are worked on together as arrays, and its timer is that of
    the alarm which comes first.
    """

    def __init__(self, lead_minutes: int, keep_minutes: int, kept: int = 20):
        self.lead, self.keep, self.kept = lead_minutes * MINUTE, keep_minutes * MINUTE, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarms = handle.getValueState("alarms", "rows binary")
        self.changes = handle.getValueState("changes", "rows binary")

    def _load(self) -> tuple[dict[str, np.ndarray], pd.DataFrame]:
        if not self.alarms.exists():
            return {c: np.array([], kind) for c, kind in ALARM.items()}, pd.DataFrame({"alarm_id": np.array([], "int64"), "at": np.array([], "int64"), "status": np.array([], object)})
        unpacked = lambda state: pa.ipc.open_stream(bytes(state.get()[0])).read_all().to_pandas()
        rows = unpacked(self.alarms)
        return {c: rows[c].to_numpy(kind, copy=True) for c, kind in ALARM.items()}, unpacked(self.changes)

    def _store(self, alarms: dict[str, np.ndarray], changes: pd.DataFrame) -> None:
        """Keeps the bucket, and one timer: for the next thing to do, or to forget an alarm that is over."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if not len(alarms["alarm_id"]):
            self.alarms.clear()
            self.changes.clear()
            return

        def packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, schema) as stream:
                stream.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
            return out.getvalue().to_pybytes()

        self.alarms.update((packed(pd.DataFrame(alarms), ALARM_ROWS),))
        self.changes.update((packed(changes, CHANGE_ROWS),))
        active, due = np.isin(alarms["status"], ACTIVE), alarms["due"]
        waiting = active & (due != NEVER) & (alarms["escalated"] != due)
        times = [np.where(alarms["reminded"] != due, due - self.lead, due)[waiting], (alarms["last"] + self.keep)[~active]]
        if len(times := np.concatenate(times)):
            self.handle.registerTimer(int(times.min()))

    def _passed(self, alarms: dict[str, np.ndarray], at: np.ndarray, until: np.ndarray | int) -> list[pd.DataFrame]:
        """What has come due for the alarms at ``at`` (each once) up to a time; marks it in ``alarms``."""
        due, level = alarms["due"][at], alarms["level"][at]
        known = np.isin(alarms["status"][at], ACTIVE) & (due != NEVER)
        remind = known & (alarms["reminded"][at] != due) & (due - self.lead <= until)
        escalate = known & (alarms["escalated"][at] != due) & (due <= until)
        alarms["reminded"][at[remind]] = due[remind]
        alarms["escalated"][at[escalate]] = due[escalate]
        alarms["level"][at[escalate]] += 1
        told = lambda some, kind, ms, level: pd.DataFrame({"alarm_id": alarms["alarm_id"][at[some]], "kind": kind, "at": pd.to_datetime(ms[some], unit="ms"), "due_at": pd.to_datetime(due[some], unit="ms"), "level": level[some]})
        return [told(some, *more) for some, *more in ((remind, "reminded", due - self.lead, level), (escalate, "escalated", due, level + 1)) if some.any()]

    def _frame(self, key: tuple, found: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if found:
            rows = pd.concat(found, ignore_index=True).astype({"level": "int32"})
            yield rows.assign(alarm_id=pd.array([None] * len(rows), "Int64")) if key[0] == NOBODY else rows

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alarms, changes = self._load()
        new = pd.concat(list(rows), ignore_index=True).sort_values(["alarm_id", "ms", "seq"], kind="stable")
        fresh = np.setdiff1d(new["alarm_id"].to_numpy("int64"), alarms["alarm_id"])
        start = {"alarm_id": fresh, "status": None, "due": NEVER, "level": 0, "reminded": NEVER, "escalated": NEVER, "last": 0}
        alarms = {c: np.concatenate([alarms[c], np.full(len(fresh), start[c], kind)]) for c, kind in ALARM.items()}
        order = np.argsort(alarms["alarm_id"])
        alarms = {c: v[order] for c, v in alarms.items()}
        # the first change of every alarm, then the second, and so on
        new = new.assign(nth=new.groupby("alarm_id").cumcount()).sort_values("nth", kind="stable")
        place = np.searchsorted(alarms["alarm_id"], new["alarm_id"].to_numpy("int64"))
        ms, status = new["ms"].to_numpy("int64"), new["status"].astype(object).where(new["status"].notna(), None).to_numpy()
        due = new["due_ms"].astype("Int64").fillna(NEVER).to_numpy("int64")
        ends = np.cumsum(np.bincount(new["nth"])) if len(new) else []
        found, changed, a = [], np.zeros(len(new), bool), 0
        for b in ends:
            at, some = place[a:b], slice(a, b)
            found += self._passed(alarms, at, ms[some])  # what was due before this change
            given = np.array([s is not None for s in status[some]])
            changed[some] = given & (status[some] != alarms["status"][at])
            alarms["status"][at[given]] = status[some][given]
            dated = due[some] != NEVER
            alarms["due"][at[dated]] = due[some][dated]
            alarms["last"][at] = np.maximum(alarms["last"][at], ms[some])
            a = b
        more = pd.DataFrame({"alarm_id": alarms["alarm_id"][place], "at": ms, "status": status})[changed]
        changes = pd.concat([changes, more], ignore_index=True) if len(changes) else more
        self._store(alarms, changes.groupby("alarm_id").tail(self.kept))
        yield from self._frame(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        alarms, changes = self._load()
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = ~np.isin(alarms["status"], ACTIVE) & (alarms["last"] + self.keep <= until)
        changes = changes[~changes["alarm_id"].isin(alarms["alarm_id"][over])]
        alarms = {c: v[~over] for c, v in alarms.items()}
        found = self._passed(alarms, np.arange(len(alarms["alarm_id"])), until)
        self._store(alarms, changes)
        yield from self._frame(key, found)

    def close(self) -> None:
        pass


def service_timers(events: DataFrame, lead_minutes: int, keep_minutes: int = 7 * 24 * 60, watermark: str = "2 days") -> DataFrame:
    """alarm_id, kind (reminded, escalated), at, due_at and level, as the stream of changes goes by.

    events: alarm_id, ts, seq (settles ties), status and due_at; a null status or due time stays as it
    was.  An active alarm is reminded ``lead_minutes`` before it is due and escalated when it is, once for
    each due time; what came due before a change counts as it was before the change.  A RESOLVED
    or CLOSED alarm's state goes ``keep_minutes`` after its last change.  Changes that come later than
    the watermark allows are dropped.  Alarms are kept in BUCKETS, each with one timer, and an alarm's state
    is of a bounded size.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    bucket = F.when(F.col("alarm_id").isNull(), NOBODY).otherwise(F.pmod(F.xxhash64("alarm_id"), F.lit(BUCKETS)))
    rows = rows.select(bucket.cast("int").alias("bucket"), F.coalesce("alarm_id", F.lit(0)).alias("alarm_id"), "ts", "seq", "status", F.unix_millis("ts").alias("ms"), F.unix_millis(F.col("due_at").cast("timestamp")).alias("due_ms"))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=ServiceTimers(lead_minutes, keep_minutes), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
