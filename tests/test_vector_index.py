import numpy as np
import pytest

from quarrylens.operators import retrieval
from quarrylens.sources.vector_index import VectorIndex


def brute(points, queries, k):
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    out = set()
    for q, kb, v in queries:
        scores = sorted((-round(float(unit(x) @ unit(v)), 9), i, p) for i, b, p, x in points if b == kb)
        out |= {(q, kb, i, p, n) for n, (_, i, p) in enumerate(scores[:k], 1)}
    return out


def frame(spark, points):
    return spark.createDataFrame([(i, b, p, [float(c) for c in v]) for i, b, p, v in points], "id string, kb string, parent string, vector array<double>")


def asked(spark, queries):
    return spark.createDataFrame([(q, kb, [float(c) for c in v]) for q, kb, v in queries], "query_id bigint, kb string, query_vector array<double>")


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_search_is_exact_and_prunes(spark, tmp_path, spread):
    """Two bases in clusters, one with copies of one vector on a third of its rows; documents replaced, and gone."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    points = [(f"p{n}", "ab"[n % 2], f"d{n // 5}", centers[n % 12] + spread * rng.normal(size=16)) for n in range(360)]
    points += [(f"same{n}", "a", f"s{n}", points[0][3]) for n in range(120)]
    index = VectorIndex(spark, str(tmp_path))
    index.fit(frame(spark, points[:300]), cells=12)
    index.upsert(frame(spark, [(i, b, p, -v) for i, b, p, v in points[:250]]))
    index.upsert(frame(spark, points[:250]))
    index.upsert(frame(spark, points[250:]))
    late = [("d7new", "b", "d7", centers[3])]
    index.upsert(frame(spark, late))  # its five points before are gone
    now = [x for x in points if x[2] != "d7"] + late
    queries = [(n, "ab"[n % 2], centers[n % 12] + spread * rng.normal(size=16)) for n in range(20)] + [(99, "none", centers[0])]
    got = index.search(asked(spark, queries), 7)
    assert {(r["query_id"], r["kb"], r["id"], r["parent"], r["rank"]) for r in got.collect()} == brute(now, queries, 7)
    assert index.last_read < 0.5 if spread < 1 else index.last_read <= 1
    few = index.search(asked(spark, queries[:2]), 1000)
    assert few.groupBy("query_id").count().orderBy("query_id").collect()[0]["count"] == sum(x[1] == "a" for x in now)


def test_vectors_that_cannot_be_indexed(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    assert index.upsert(frame(spark, [("1", "k", "d", [1, 0]), ("2", "k", "d", [0, 0]), ("3", "k", "e", [1, 2, 3])])) == 1
    rows = index.search(asked(spark, [(1, "k", [1, 0]), (2, "k", [0, 0])]), 3)
    assert rows.filter("query_id = 2").count() == 0


def test_sources_of_several_bases(spark):
    rows = [(1, "a", "p", "d", 0.5), (1, "a", "q", "d", 0.9), (1, "b", "r", "e", 0.7), (1, "b", "s", "d", 0.9), (2, "a", "t", "d", 0.1)]
    df = spark.createDataFrame(rows, "query_id int, kb string, id string, parent string, score double")
    got = {r["query_id"]: [tuple(x) for x in r["sources"]] for r in retrieval.with_sources(df).collect()}
    assert got == {1: [("a", "d", 0.9, 2), ("b", "d", 0.9, 1), ("b", "e", 0.7, 1)], 2: [("a", "d", 0.1, 1)]}
