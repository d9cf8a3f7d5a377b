"""Streams with many keys: state in buckets, batches in several files."""

from pyspark.sql import functions as F

from quarrylens.streaming import streams, timers


def events(spark, users, day):
    rows = spark.range(users).select(F.col("id").alias("event_id"), F.when(F.col("id") > 0, F.col("id")).alias("user_id"), F.lit("error").alias("event_type"))
    return rows.withColumn("ts", F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp"))


def test_a_batch_of_several_files_stays_one_batch(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    batches = [events(spark, 250, 1), events(spark, 5, 2).limit(0), events(spark, 3, 9)]
    stream = streams.delivered(spark, batches)
    rows = []
    stream.writeStream.trigger(availableNow=True).foreachBatch(lambda b, n: rows.append(b.count())).start().awaitTermination()
    assert rows == [250, 0, 3]


def test_open_alarms_keep_a_row_of_state_for_a_bucket(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(streams, "USER_BUCKETS", 4, raising=False)
    stream = streams.open_alarms(streams.delivered(spark, [events(spark, 200, 1), events(spark, 200, 2), events(spark, 50, 5)]), 48 * 3600, watermark="60 days")
    found = streams.finished(stream, ["user_id"], checkpoint=str(tmp_path / "mark")).collect()
    assert sorted((-1 if r["user_id"] is None else r["user_id"], r["episode"], r["occurrences"]) for r in found) == [(k if k else -1, 2, 1) if k < 50 else (k, 1, 2) for k in range(200)]
    assert spark.read.format("statestore").load(str(tmp_path / "mark")).count() <= 5


def test_timers_keep_a_row_of_state_for_a_bucket(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(timers, "BUCKETS", 4, raising=False)
    made = spark.range(200).select(F.col("id").alias("alarm_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(1).alias("seq"), F.lit("OPEN").alias("status"), F.lit("2024-01-03").cast("timestamp").alias("due_at"))
    tick = made.limit(1).withColumns({"alarm_id": F.lit(-1).cast("long"), "ts": F.lit("2024-03-01").cast("timestamp"), "status": F.lit("CLOSED")})
    with timers.timer_state(spark):
        found = streams.finished(timers.service_timers(streams.delivered(spark, [made, tick]), 60), checkpoint=str(tmp_path / "mark"))
        assert found.count() == 400
        assert spark.read.format("statestore").option("stateVarName", "alarms").load(str(tmp_path / "mark")).count() <= 4
