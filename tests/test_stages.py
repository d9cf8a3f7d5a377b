"""What runs of stages leave on disk."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import preparation
from quarrylens.operators.steps import shared_folder
from quarrylens.plans.queries import QUERIES


def left(spark, request):
    folder = f"{shared_folder(spark)}/requests/{request}"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def documents(spark):
    """Titles as long as the text, short and long ones, none."""
    return spark.createDataFrame([(1, "a" * 5000), (2, "b\n" + "c é" * 900), (3, "short"), (4, " "), (5, None)], "id bigint, text string")


def test_a_run_keeps_two_stages_at_most(spark):
    request, seen = uuid.uuid4().hex, []

    def watched(name, work):
        def run(df):
            seen.append(left(spark, request))
            return work(df)

        return name, run

    rows, log = preparation.run_stages(spark, request, documents(spark), [watched(*s) for s in preparation.STAGES])
    assert seen == [[], ["parse"], ["normalize"], ["classify"], ["extract"], ["chunk"], ["embed"]]
    assert left(spark, request) == ["commit"] and [there for _, there in log] == [False] * 7
    assert sorted((r["id"], r["n_chunks"], len(r["title"])) for r in rows.collect()) == [(1, 7, 5000), (2, 4, 1), (3, 1, 5), (4, 0, 0), (5, 0, 0)]
    again, log = preparation.run_stages(spark, request, documents(spark), preparation.STAGES)
    assert [there for _, there in log] == [True] * 7 and again.count() == 5


def test_what_an_earlier_run_returned_stays(spark):
    request = uuid.uuid4().hex
    first, _ = preparation.run_stages(spark, request, documents(spark), preparation.STAGES, upto="classify")
    assert left(spark, request) == ["classify"]
    rows, log = preparation.run_stages(spark, request, documents(spark), preparation.STAGES)
    assert [there for _, there in log] == [True] * 3 + [False] * 4 and left(spark, request) == ["classify", "commit"]
    assert first.count() == rows.count() == 5
    early, log = preparation.run_stages(spark, request, documents(spark), preparation.STAGES, upto="parse")  # its rows are gone
    assert log == [("parse", False)] and early.count() == 5


def test_a_title_and_a_text_are_written_once(spark):
    docs = preparation.extracted(preparation.classified(preparation.normalized(preparation.parsed(documents(spark)))))
    cut = preparation.chunked(docs)
    assert cut.agg(F.sum(F.length("title"))).first()[0] == 5000 + 1 + 5 and "Exchange" not in cut._jdf.queryExecution().toString()
    want = preparation.chunks(docs, "id", "text").collect()
    assert sorted((r["id"], r["chunk"], r["start"], r["chunk_text"]) for r in cut.collect() if r["chunk"] is not None) == sorted(map(tuple, want))
    assert sorted(r["id"] for r in cut.collect() if r["chunk"] is None) == [4, 5]
    assert "chunk_text" not in preparation.embedded(cut).columns


def test_shares_of_characters(spark):
    texts = ["", "aB1 \t?", "日本 語\U0001f600x", "Ünïcode\u00a0\x0b\r\n9", "a" * 799 + "-", None]
    got = preparation.embedded(spark.createDataFrame(list(enumerate(texts)), "id int, chunk_text string")).orderBy("id").collect()
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\f\r"]
    for row, text in zip(got, texts):
        counts = text and [sum(c in s for c in text) for s in sets]
        assert row["vector"] == (None if text is None else [round(n / max(1, len(text)), 6) for n in [*counts, len(text) - sum(counts)]] if text else [0.0] * 5)


@pytest.mark.parametrize("name", ["d26_document_pipeline", "d26_upserted_chunks", "d39_resume"])
def test_queries_leave_no_requests(spark, small, name):
    folder = f"{shared_folder(spark)}/requests"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert QUERIES[name](spark, small).count() > 0
    assert set(os.listdir(folder)) <= before
