import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import acquisition
from quarrylens.sources.feed import FolderFetcher, PostFetcher
from quarrylens.sources.store import Collection

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def write(path, *posts, mode="a"):
    path.parent.mkdir(exist_ok=True)
    with open(path, mode) as f:
        f.writelines((p if isinstance(p, str) else json.dumps(p)) + "\n" for p in posts)


def opened(spark, root, *given):
    """Collections, with sources given as (id, type, status, priority, polling minutes, endpoint)."""
    sources, documents = Collection(spark, str(root), "sources"), Collection(spark, str(root), "raw_documents")
    rows = spark.createDataFrame(given, "id string, type string, status string, priority int, m int, endpoint string").withColumn("name", F.col("id")).withColumn("polling_interval", F.make_dt_interval(F.lit(0), F.lit(0), F.col("m")))
    sources.save(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in sources.schema.fields]))
    return sources, documents


def ran(report):
    return {r["source_id"]: (r["fetched"], r["saved"], r["error"] is not None) for r in report.collect()}


FETCHERS = {"API": PostFetcher(), "FILESYSTEM": FolderFetcher()}


def test_runs_go_on_from_their_state(spark, tmp_path):
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    write(a, {"url": "u1", "time": minutes(-9).isoformat(), "body": "one"}, {"url": "u1", "time": minutes(-8).isoformat(), "body": "other"}, {"url": "u2", "time": minutes(-7).isoformat(), "body": "one"}, "", {"url": "u3", "body": "é🙂"})
    write(b, {"url": "u1", "time": "2024-04-30T20:00:00", "x": 1})
    sources, documents = opened(spark, tmp_path / "store", ("a", "API", "ENABLED", 2, 30, str(a)), ("b", "API", "ENABLED", 1, 60, f"file:{b}"), ("c", "API", "DISABLED", 0, 1, str(a)), ("d", "RSS", "ENABLED", 0, 1, str(a)), ("e", "API", "ENABLED", 3, 15, str(tmp_path / "nowhere")))
    assert ran(acquisition.acquire(sources, documents, FETCHERS, START)) == {"a": (4, 2, False), "b": (1, 1, False), "e": (0, 0, True)}
    assert ran(acquisition.acquire(sources, documents, FETCHERS, minutes(10))) == {}
    write(a, {"url": "u9", "time": minutes(5).isoformat(), "body": "new"}, {"url": "u0", "time": minutes(-60).isoformat(), "body": "older than the mark"})
    assert ran(acquisition.acquire(sources, documents, FETCHERS, minutes(40))) == {"a": (2, 1, False), "e": (0, 0, True)}  # u3 has no time: asked for again, known
    assert ran(acquisition.acquire(sources, documents, FETCHERS, minutes(61))) == {"b": (0, 0, False), "e": (0, 0, True)}
    assert sorted(r["original_uri"] for r in documents.read().filter("source_id = 'a'").collect()) == ["u1", "u3", "u9"]
    state = {r["id"]: r for r in sources.read().select("id", *[F.unix_timestamp(c).alias(c) for c in ("last_execution", "last_successful_run", "last_content_timestamp")]).collect()}
    at = lambda n: int(minutes(n).timestamp())
    assert tuple(state["a"])[1:] == (at(40), at(40), at(5)) and tuple(state["b"])[1:] == (at(61), at(61), at(-240)) and tuple(state["e"])[1:] == (at(61), None, None)


def test_limit_takes_the_others_next(spark, tmp_path):
    for n in range(4):
        write(tmp_path / "in" / f"{n}.jsonl", {"url": f"u{n}"})
    sources, documents = opened(spark, tmp_path / "store", *[(str(n), "API", "ENABLED", n // 2, 600, str(tmp_path / "in" / f"{n}.jsonl")) for n in range(4)])
    taken = [sorted(ran(acquisition.acquire(sources, documents, FETCHERS, minutes(k), limit=3))) for k in range(3)]
    assert taken == [["0", "1", "2"], ["3"], []] and documents.read().count() == 4


def test_run_that_dies_before_its_state_is_saved(spark, tmp_path, monkeypatch):
    write(tmp_path / "in" / "a.jsonl", {"url": "u1", "time": START.isoformat()}, {"url": "u2", "time": START.isoformat()})
    sources, documents = opened(spark, tmp_path / "store", ("a", "API", "ENABLED", 0, 5, str(tmp_path / "in" / "a.jsonl")))
    with monkeypatch.context() as m:
        m.setattr(sources, "save", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            acquisition.acquire(sources, documents, FETCHERS, START)
    assert documents.read().count() == 2
    assert ran(acquisition.acquire(sources, documents, FETCHERS, START)) == {"a": (2, 0, False)} and documents.read().count() == 2


def test_a_fault_amid_a_source_keeps_its_mark(spark, tmp_path):
    path = tmp_path / "in" / "a.jsonl"
    write(path, {"url": "u1", "time": START.isoformat()}, "no json", {"url": "u2", "time": START.isoformat()})
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "p.html").write_text("<p>")
    (tmp_path / "files" / "_hidden").write_text("x")
    sources, documents = opened(spark, tmp_path / "store", ("a", "API", "ENABLED", 0, 5, str(path)), ("f", "FILESYSTEM", "ENABLED", 0, 5, str(tmp_path / "files")))
    assert ran(acquisition.acquire(sources, documents, FETCHERS, START)) == {"a": (1, 1, True), "f": (1, 1, False)}
    write(path, {"url": "u1", "time": START.isoformat()}, {"url": "u2", "time": START.isoformat()}, mode="w")
    assert ran(acquisition.acquire(sources, documents, FETCHERS, minutes(6)))["a"] == (2, 1, False)
    assert {(r["mime_type"], bytes(r["raw_content"])) for r in documents.read().filter("source_id = 'f'").collect()} == {("text/html", b"<p>")}


def test_one_partition_for_each_source(spark, tmp_path):
    for n in range(5):
        write(tmp_path / "in" / f"{n}.jsonl", {"url": f"u{n}"}, {"url": f"v{n}"})
    due = spark.createDataFrame([(str(n), "API", str(tmp_path / "in" / f"{n}.jsonl"), None) for n in range(5)], "id string, type string, endpoint string, mark timestamp")
    rows = acquisition.fetched(spark, due, FETCHERS, F.current_timestamp())
    assert rows.groupBy("source_id").count().filter("count = 2").count() == 5
    from quarrylens.sources import feed

    due.coalesce(1).write.parquet(str(tmp_path / "due"))
    read = spark.read.format(feed.register(spark, FETCHERS)).option("due", str(tmp_path / "due")).load()
    assert read.rdd.getNumPartitions() == 5


def test_stream_of_sources(spark, tmp_path):
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    write(a, {"url": "u1", "time": minutes(1).isoformat()}, {"url": "u2", "time": minutes(2).isoformat()})
    write(b, {"url": "u1", "time": minutes(1).isoformat()})
    sources, documents = opened(spark, tmp_path / "store", ("a", "API", "ENABLED", 0, 5, str(a)), ("b", "API", "ENABLED", 0, 5, str(b)), ("c", "API", "ENABLED", 0, 5, str(tmp_path / "none")))
    run = lambda: acquisition.acquire_stream(sources, documents, FETCHERS, str(tmp_path / "checkpoint"))
    assert run() == 3 and run() == 0
    write(a, {"url": "u3", "time": minutes(9).isoformat()}, {"url": "old", "time": minutes(1).isoformat()})
    assert run() == 1
    assert sorted((r["source_id"], r["original_uri"]) for r in documents.read().collect()) == [("a", "u1"), ("a", "u2"), ("a", "u3"), ("b", "u1")]
    for name in ("1", ".1.crc"):  # the last batch is run again
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    before = documents.versions()
    assert run() == 0 and documents.versions() == before and documents.read().count() == 4
