from collections import Counter
from functools import partial

import pytest

import corpus_pipeline
from quarrylens.llm._spark import finished

from . import brute


@pytest.fixture(scope="module")
def steps(spark, middle, tmp_path_factory):
    """Every stage's input and output."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{middle}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, middle).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns(spark, middle, steps):
    columns = spark.read.parquet(f"{middle}/documents.parquet").columns
    assert [n for n, _, _ in steps] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(after.columns == columns for _, _, after in steps[:-1])


def test_quality_keeps_good_documents(spark, middle, steps):
    _, before, after = steps[0]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())


def test_lines_are_only_deleted(steps):
    _, before, after = steps[1]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["n_chars"] == len(r["text"])
        left = iter(old[r["doc_id"]].split("\n"))
        assert all(line in left for line in r["text"].split("\n"))
    # a removed line stands earlier, so every distinct line stays somewhere
    distinct = lambda texts: {x for t in texts for x in t.split("\n") if x.strip()}
    assert distinct(old.values()) == distinct(r["text"] for r in after.collect())


def test_one_of_each_group_stays(steps):
    _, before, after = steps[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want, _ = brute.near_duplicates(rows, 5, 80)
    assert {r["doc_id"] for r in after.collect()} == {i for i in want if want[i] == i}


def test_mix_takes_whole_documents(steps):
    _, before, after = steps[3]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    count = Counter(r["doc_id"] for r in after.collect())
    assert all(r["text"] == old[r["doc_id"]] for r in after.collect()) and max(count.values()) <= 2
    size = lambda t: len((t or "").encode().split())
    assert abs(sum(size(old[i]) * n for i, n in count.items()) - 1.5 * sum(map(size, old.values()))) <= max(map(size, old.values()))


def test_everything_is_packed(steps):
    from quarrylens.llm.packing import default_vocabulary

    _, before, after = steps[4]
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after.collect())
    assert got == brute.token_pieces([(r["doc_id"], r["text"]) for r in before.collect()], default_vocabulary(), 1024, 2)


def test_odd_rows_pass_every_stage(spark, edge):
    """Stage by stage on rows with nulls, repeats, very long texts and clashing columns."""
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = finished(spark, name, partial(stage, spark, docs, edge))
        if name not in ("mixing", "packing"):
            assert docs.count() <= rows
            rows = docs.count()
        assert name == "packing" or docs.columns == columns
    assert docs.count() > 0


def test_run_and_empty(spark, empty, middle, steps):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, middle).count() == steps[-1][2].count()
