import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylens import config, schemas
from quarrylens.functions import codecs
from quarrylens.functions.text import canonical_url, normal_title
from quarrylens.operators import alarms, collections, finders, graph, preparation, retrieval, rules
from quarrylens.sources.connectors import FolderConnector, JsonLinesConnector
from quarrylens.sources.store import Collection, DuplicateKey
from quarrylens.streaming import streams


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_durations(spark):
    df = spark.createDataFrame([("PT30M",), ("PT1H30M",), ("P1DT2H",), ("PT0S",), ("-PT5M",), ("PT1.5S",), ("P",), ("PT",), ("30M",), (None,)], "t string")
    got = [r[0] for r in df.select(codecs.duration_seconds(codecs.parse_duration(F.col("t")))).collect()]
    assert got == [1800, 5400, 93600, 0, -300, 1.5, None, None, None, None]
    back = [r[0] for r in df.limit(4).select(codecs.format_duration(codecs.parse_duration(F.col("t")))).collect()]
    assert back == ["PT30M", "PT1H30M", "PT26H", "PT0S"]


def test_json_ignores_unknown_fields_and_fills_lists(spark):
    text = '{"id":"a","surprise":1,"metadata":{"title":"T","publication_date":"2019-11-30","else":2},"taxonomy":{"domain":"D"},"entities":null}'
    rows = codecs.empty_lists(codecs.from_json_lines(spark.createDataFrame([(text,)], "value string"), schemas.ARTICLE))
    r = rows.first()
    assert (r["id"], r["metadata"]["title"], r["metadata"]["publication_date"]) == ("a", "T", dt.date(2019, 11, 30))
    assert r["entities"] == [] and r["claims"] == [] and r["metadata"]["tags"] == [] and r["taxonomy"]["topics"] == []
    assert '"publication_date":"2019-11-30"' in codecs.to_json_lines(rows).first()[0]


def test_source_round_trip(spark):
    text = '{"id":"s","name":"Harbour log","type":"SITEMAP","endpoint":"https://ships.example.net/map","priority":3,"last_successful_run":"2018-02-28T21:15:30Z","configuration":"{\\"depth\\":4}","tags":["north","coast"]}'
    rows = codecs.with_source_defaults(codecs.from_json_lines(spark.createDataFrame([(text,)], "value string"), schemas.SOURCE))
    r = rows.select("status", "tags", codecs.format_instant(F.col("last_successful_run")).alias("run")).first()
    assert tuple(r) == ("ENABLED", ["north", "coast"], "2018-02-28T21:15:30Z")


def test_base64_and_enums(spark):
    df = spark.createDataFrame([("dGlkZSB0YWJsZXM=", "RSS"), (None, "nope")], "b string, e string")
    assert bytes(df.select(codecs.decode_bytes(F.col("b"))).first()[0]) == b"tide tables"
    assert values(df.select(codecs.enum_value(F.col("e"), "SourceType").alias("e"), codecs.enum_ordinal(F.col("e"), "SourceType").alias("o")), "e", "o") == [("RSS", 1), (None, None)]
    with pytest.raises(Exception, match="not a SourceType"):
        df.select(codecs.enum_value(F.col("e"), "SourceType", strict=True)).collect()


def test_limits_nulls_and_ties(spark):
    assert [finders.normal_limit(n) for n in (3, 0, -1)] == [3, 100, 100]
    with pytest.raises(ValueError):
        finders.articles_by_domain(spark.range(1), None)
    df = spark.createDataFrame([("b", None, 1), ("a", None, 1), ("c", 1, 1)], "id string, priority int, name int")
    assert [r["id"] for r in df.orderBy(*finders.source_order()).collect()] == ["a", "b", "c"]


def test_any_element_is_false_on_null(spark):
    df = spark.createDataFrame([(1, [("x",)]), (2, None), (3, [(None,)])], "id int, events array<struct<type:string>>")
    assert [r["id"] for r in df.filter(~finders.any_element("events", "type", "x")).collect()] == [2, 3]


def test_two_unique_keys_in_turn(spark):
    rows = [("r1", "s", "A", "h1", 1), ("r2", "s", "A", "h2", 2), ("r3", "s", "B", "h2", 3), ("r4", "s", None, None, 4), ("r5", "s", None, None, 5), ("r6", "t", "A", "h1", 6)]
    df = spark.createDataFrame(rows, "id string, source_id string, original_uri string, content_hash string, acquisition_time int")
    got = {r["id"]: r["reason"] for r in collections.unique_by_two(df, "source_id", "original_uri", "content_hash", ["acquisition_time"]).collect()}
    assert got == {"r1": None, "r2": "original_uri", "r3": None, "r4": None, "r5": None, "r6": None}


@pytest.mark.parametrize("in_task", [200_000, 60, 0])
def test_two_unique_keys_by_brute_force(spark, in_task):
    import random

    rng = random.Random(3)
    rows = [(f"{n:04}", rng.choice("st"), rng.choice([None, *range(12)]), rng.choice([None, *range(15)]), n // 2) for n in range(300)]
    seen, want = set(), {}
    for i, scope, a, b, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        reason = "one" if a is not None and (scope, "a", a) in seen else "two" if b is not None and (scope, "b", b) in seen else None
        if reason is None:
            seen |= {(scope, "a", a), (scope, "b", b)}
        want[i] = reason
    df = spark.createDataFrame(rows, "id string, scope string, one int, two int, at int")
    got = collections.unique_by_two(df, "scope", "one", "two", ["at"], rows_in_task=in_task).collect()
    assert {r["id"]: r["reason"] for r in got} == want and all(r["accepted"] == (r["reason"] is None) for r in got) and len(got) == 300


def test_null_keys(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "k"), ("d", "k")], "id string, k string")
    kept, rejected = collections.unique_first(df, ["k"], ["id"])
    assert sorted(r["id"] for r in kept.collect()) == ["a", "b", "c"] and [r["id"] for r in rejected.collect()] == ["d"]
    kept, _ = collections.unique_first(df, ["k"], ["id"], exempt_nulls=False)
    assert sorted(r["id"] for r in kept.collect()) == ["a", "c"]


def test_collection_on_disk(spark, tmp_path):
    store = Collection(spark, str(tmp_path), "raw_documents")
    row = lambda i, uri, h: (i, "s", uri, h, "text/plain")
    make = lambda *rows: codecs.from_json_lines(spark.createDataFrame([(f'{{"id":{i!r},"source_id":"{s}","original_uri":"{u}","content_hash":"{h}","mime_type":"{m}"}}'.replace("'", '"'),) for i, s, u, h, m in rows], "value string"), schemas.RAW_DOCUMENT)
    assert store.read().count() == 0
    store.save(make(row("1", "u1", "h1"), row("2", "u2", "h2")))
    store.save(make(row("2", "u3", "h3")))
    assert sorted(values(store.read(), "id", "original_uri")) == [("1", "u1"), ("2", "u3")]
    with pytest.raises(DuplicateKey):
        store.save(make(row("9", "u1", "h9")))
    assert store.delete("1") and not store.delete("1")
    assert values(store.read(), "id") == [("2",)]


def test_save_fills_in(spark, tmp_path):
    docs, sources = Collection(spark, str(tmp_path), "raw_documents"), Collection(spark, str(tmp_path), "sources")
    make = lambda text, schema: codecs.from_json_lines(spark.createDataFrame([(text,)], "value string"), schema)
    saved = docs.save(make('{"source_id":"s","original_uri":"u","mime_type":"text/plain"}', schemas.RAW_DOCUMENT)).first()
    stored = docs.read().first()
    assert stored["id"] == saved["id"] and stored["acquisition_time"] == saved["acquisition_time"] is not None
    sources.save(make('{"id":"a","name":"n","tags":["x","y"]}', schemas.SOURCE))
    assert values(sources.read(), "status", "priority", "tags") == [("ENABLED", 0, ["x", "y"])]
    assert values(sources.in_folder("ENABLED"), "id") == [("a",)] and sorted(values(sources.side("tags"), "own_id", "value")) == [("a", "x"), ("a", "y")]
    assert "by_status" in sources.in_folder("ENABLED")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    sources.save(make('{"id":"b","name":"m"}', schemas.SOURCE))
    assert sources.read().count() == 2


def test_connectors(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html></html>")
    rows = FolderConnector().fetch(spark, "s", str(tmp_path)).select("source_id", "mime_type", "content_hash").collect()
    assert [r["mime_type"] for r in rows] == ["text/html"] and rows[0]["content_hash"].startswith("sha256:")
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "p.jsonl").write_text('{"url":"u","time":"2018-02-28T21:15:30Z"}\n\n{"x":1}\n')
    rows = JsonLinesConnector().fetch(spark, "s", str(tmp_path / "posts"))
    assert rows.count() == 2 and rows.filter("original_uri = 'u' AND content_timestamp IS NOT NULL").count() == 1


def test_addresses_and_titles(spark):
    df = spark.createDataFrame([("https://WWW.Example.org:81/a/?x=2&utm_medium=m&b=1&fbclid#y", "  The  BIG, news! "), ("http://m.example.org?gclid=1", None), (None, "")], "u string, t string")
    got = [tuple(r) for r in df.select(canonical_url(F.col("u")), normal_title(F.col("t"))).collect()]
    assert got == [("example.org:81/a?b=1&x=2", "the big news"), ("example.org", None), (None, "")]


@pytest.mark.parametrize("block", [4096, 50])
def test_close_vectors(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
    x = np.random.default_rng(1).normal(size=(300, 12))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    products = np.round(unit @ unit.T, 6)
    np.fill_diagonal(products, -2)
    want = {i: (int((row >= 0.5).sum()), float(row.max()) if row.max() >= 0.5 else None) for i, row in enumerate(products)} | {i: (0, None) for i in range(900, 904)}
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0])]
    got = retrieval.close_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.5).collect()
    assert {r["vec_id"]: (r["n_close"], r["best_cosine"]) for r in got} == want and len(got) == 304


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_in_blocks(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
    x = np.random.default_rng(2).normal(size=(120, 6))
    x[7] = x[3]  # a tie
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, "a" if i < 100 else "b", [float(c) for c in v]) for i, v in enumerate(x)] + [(500, "a", [0.0] * 6)], "vec_id bigint, kb string, vector array<double>")
    queries = rows.filter("vec_id % 10 = 3").select(F.col("vec_id").alias("query_id"), "kb", F.col("vector").alias("query_vector"))
    got = {}
    for r in retrieval.nearest(rows, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(3, 120, 10):
        base = range(100) if q < 100 else range(100, 120)
        assert got[q] == sorted(base, key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:4]


@pytest.mark.parametrize("block", [512, 8])
def test_shared_entities(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(graph, "BLOCK", block)
    rng = random.Random(4)
    sets = [frozenset(rng.choice(["common", "often", *"abcdefghijklmnop"]) for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    rows = [(f"a{n}", [(f"{n}{e}", "T", e, e, 0.5) for e in sorted(x)]) for n, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "id string, entities array<struct<id:string,type:string,name:string,normalized_name:string,confidence:double>>")
    got = {r["article_id"]: (r["n_links"], r["best_share"]) for r in graph.shared_entities(df, 0.5).collect()}
    for n, x in enumerate(sets):
        shares = [len(x & y) / len(x | y) for m, y in enumerate(sets) if m != n and x | y]
        close = [s for s in shares if s >= 0.5]
        assert got[f"a{n}"] == (len(close), round(max(close), 6) if close else None)


def test_cycles(spark):
    edges = [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "c", "d"), ("g", "d", "e"), ("h", "a", "b"), ("h", "b", "c"), ("i", "x", "x"), ("j", "p", "q"), ("j", "q", "p"), ("j", "q", "r"), ("j", "r", "s"), ("j", "s", "r")]
    got = values(rules.cycles(spark.createDataFrame(edges, "graph string, source string, target string")), "graph", "node")
    assert sorted(got) == [("g", "a"), ("g", "b"), ("g", "c"), ("i", "x"), ("j", "p"), ("j", "q"), ("j", "r"), ("j", "s")]


def test_streams_go_on_from_a_checkpoint(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    day = lambda n, h=0: f"2024-01-{n:02} {h:02}:00:00"
    folder = str(tmp_path / "in")
    make([(1, 1, "error", day(1)), (2, 1, "error", day(1, 5)), (3, 2, "error", day(2))]).coalesce(1).write.parquet(folder)
    follow = lambda: streams.open_alarms(streams.read(spark, folder), 24 * 3600, watermark="3 days")
    one = streams.finished(follow(), ["user_id"], checkpoint=str(tmp_path / "mark"))
    assert sorted(values(one, "user_id", "episode", "occurrences")) == [(1, 1, 2), (2, 1, 1)]
    make([(4, 1, "error", day(1, 20)), (5, 1, "error", day(9))]).coalesce(1).write.mode("append").parquet(folder)
    two = streams.finished(follow(), ["user_id"], checkpoint=str(tmp_path / "mark"))
    assert values(two, "user_id", "episode", "occurrences") == [(1, 2, 1)]  # only what is new is read
    # user 2's state has timed out by now: the next event begins again
    make([(6, 2, "error", day(12)), (7, 2, "error", day(1))]).coalesce(1).write.mode("append").parquet(folder)
    three = streams.finished(follow(), ["user_id"], checkpoint=str(tmp_path / "mark"))
    assert (2, 1, 1) in values(three, "user_id", "episode", "occurrences")


def test_stages_resume(spark):
    import uuid

    docs, ran = spark.createDataFrame([(1, "One line.\n\nTwo  words 12"), (2, " "), (3, None)], "id bigint, text string"), []

    def counted(name, work):
        def run(df):
            ran.append(name)
            if name == "extract" and ran.count("extract") == 1:
                raise RuntimeError("lost")
            return work(df)

        return name, run

    stages, request = [counted(*s) for s in preparation.STAGES], uuid.uuid4().hex
    with pytest.raises(RuntimeError):
        preparation.run_stages(spark, request, docs, stages)
    rows, log = preparation.run_stages(spark, request, docs, stages)
    assert [there for _, there in log] == [True] * 3 + [False] * 4 and ran.count("parse") == ran.count("classify") == 1
    assert sorted(values(rows, "id", "status", "n_chunks", "title")) == [(1, "INDEXED", 1, "One line."), (2, "FAILED", 0, ""), (3, "FAILED", 0, "")]


def test_working_hours(spark):
    rows = [("2024-01-05 15:00:00", "HIGH"), ("2024-01-05 15:00:00", "CRITICAL"), ("2024-01-06 12:00:00", "HIGH"), ("2024-01-01 07:00:00", "MEDIUM"), ("2024-01-01 20:00:00", "LOW")]
    df = spark.createDataFrame(rows, "t string, s string").select(alarms.sla_due(F.col("t").cast("timestamp"), F.col("s")).cast("string").alias("d"))
    assert [r["d"] for r in df.collect()] == ["2024-01-08 15:00:00", "2024-01-05 16:00:00", "2024-01-08 16:00:00", "2024-01-02 16:00:00", "2024-01-08 16:00:00"]


def test_field_conditions(spark):
    df = spark.createDataFrame([('{"a":5,"b":"xyz"}',), ('{"b":null}',), (None,)], "props string")
    ask = lambda op, v=None, path="$.a": [r[0] for r in df.select(rules.field_condition(path, op, v)).collect()]
    assert ask("gt", 4) == [True, False, False] and ask("exists") == [True, False, False] and ask("in", [4, 5]) == [True, False, False]
    assert ask("contains", "yz", "$.b") == [True, False, False]
    bad = spark.createDataFrame([('{"a":5}',), ('{"a":"x"}',), ('{"a":',), (None,), ("{}",)], "props string")
    assert [r["relation"] for r in rules.field_filter(bad, [{"path": "$.a", "op": "gt", "value": 4}]).collect()] == ["True", "Failure", "Failure", "Failure", "False"]
    with pytest.raises(ValueError):
        ask("like", 1)


def test_fan_in_and_rejects(spark):
    plans = spark.createDataFrame([("a",), ("a",), ("b",)], "domain string")
    with pytest.raises(Exception, match="two plans for a"):
        preparation.one_plan_each(plans, "domain").collect()
    assert values(preparation.one_plan_each(plans, "domain", strict=False), "domain") == [("a",)]
    with pytest.raises(ValueError):
        preparation.branches(plans, "domain", ["b"], needed="a")


def test_settings(tmp_path):
    usual = config.Settings()
    assert config.load(tmp_path / "none.yaml") == usual
    assert (usual.mongodb, usual.qdrant.grpcPort, usual.theme.offlineColor, usual.ui) == (config.Endpoint("localhost", 27017), 6334, "RED_BRIGHT", config.Display(True, "COMFORTABLE"))
    path = tmp_path / "deep" / "settings.yaml"
    own = config.Settings(config.Endpoint("graph.example.net", 9001), config.VectorStore("vectors.example.net", 9002, 9003), config.Endpoint("docs.example.net", 9004), config.Theme("BLUE_BRIGHT", "WHITE_BRIGHT", "CYAN_BRIGHT"), config.Display(False, "LARGE"))
    config.save(own, path)
    assert config.load(path) == own
    (tmp_path / "odd.yaml").write_text("# made by hand\nneo4j:\n  host: '  '\n  port: 70000\nqdrant:\n  host: v.example.net  # ours\n  httpPort: -1\n  grpcPort: 9005\ntheme:\n  onlineColor: blue_bright\n  offlineColor: RED\nui:\n  density: compact\n  mouseEnabled: true\n")
    got = config.load(tmp_path / "odd.yaml")
    assert got.neo4j == usual.neo4j and got.qdrant == config.VectorStore("v.example.net", 6333, 9005) and got.mongodb == usual.mongodb
    assert got.theme == config.Theme("BLUE_BRIGHT", "RED_BRIGHT", "YELLOW_BRIGHT") and got.ui == config.Display(True, "COMPACT")
    # what is saved is normalized first
    config.save(config.Settings(ui=config.Display(True, "NORMAL"), mongodb=config.Endpoint("", 0)), path)
    assert config.load(path) == usual and "COMFORTABLE" in path.read_text()
    (tmp_path / "bad.yaml").write_text("{")
    assert config.load(tmp_path / "bad.yaml") == usual
    assert config.Endpoint("h", 0).state() == "INVALID"


def test_episodes_of_a_hot_key(spark):
    """A third of all events on one key, gaps over midnight and over empty days."""
    import random

    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(n, "hot" if n % 3 == 0 else f"k{n % 5}", start + dt.timedelta(minutes=rng.choice([rng.randrange(30_000), 1439, 1440, 1441]))) for n in range(900)]
    want = set()
    for key in {r[1] for r in rows}:
        last, before, episode, found = None, None, 0, None
        for ts, n in sorted((t, n) for n, k, t in rows if k == key):
            if last is None or ts - last > dt.timedelta(hours=2):
                if found:
                    want.add(tuple(found))
                    before = found[3]
                episode += 1
                found = [key, episode, 0, n, before]
            found[2] += 1
            last = ts
        want.add(tuple(found))
    got = alarms.episodes(spark.createDataFrame(rows, "event_id int, alarm_key string, ts timestamp"), "2 HOURS")
    assert {tuple(r) for r in got.select("alarm_key", "episode", "occurrence_count", "alarm_id", "previous_alarm_id").collect()} == want
