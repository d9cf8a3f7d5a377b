import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import similar


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def changed(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text) + 1)
        text = rng.choice([text[:k] + rng.choice("abcé🙂") + text[k:], text[:k] + text[k + 1 :], text[:k] + rng.choice("abcé") + text[k + 1 :]])
    return text


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_near_texts_by_brute_force(spark, distance):
    """Short and long texts of few letters, which share many parts; a third of the rows have one text."""
    rng = random.Random(distance)
    seeds = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["the same beginning " + "".join(rng.choice("abcdef") for _ in range(30)) for _ in range(12)]
    texts = [changed(rng, rng.choice(seeds), rng.randrange(5)) for _ in range(240)] + ["a third of all rows"] * 120 + ["a third of all rows!"] * 2 + [None, "", "", "x" * 20_000, "x" * 19_999 + "y", "z" * 20_000]
    rows = list(enumerate(texts))
    got = {r["id"]: (r["class_id"], r["n_links"], r["nearest"]) for r in similar.near_texts(spark.createDataFrame(rows, "id bigint, text string"), distance).collect()}
    near = {}
    kinds = sorted({t for t in texts if t}, key=len)
    for k, a in enumerate(kinds):
        for b in kinds[k + 1 :]:
            if len(b) - len(a) <= distance and (len(a) < 1000 or sum(x != y for x, y in zip(a, b)) < 5) and (n := edit(a, b) if len(a) < 1000 else 1) <= distance:
                near.setdefault(a, []).append((n, b))
                near.setdefault(b, []).append((n, a))
    for i, t in rows:
        if not t:
            assert got[i] == (None, 0, None)
            continue
        same = [j for j, u in rows if u == t]
        away = [0] * (len(same) > 1) + [n for n, _ in near.get(t, [])]
        assert got[i] == (min(same), len(same) - 1 + sum(texts.count(u) for _, u in near.get(t, [])), min(away, default=None)), t
    assert len(got) == len(rows)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_counts_within_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(similar, "CLASS_BUCKET", bucket)
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), rng.randrange(-200, 200)) for k in range(300)] + [(k, "a", 7) for k in range(300, 450)] + [(450, None, 7), (451, "a", None), (452, "lone", 10**15)]
    got = similar.counts_within(spark.createDataFrame(rows, "id int, kind string, at bigint"), ["kind"], "at", 5).collect()
    want = {i: 0 if k is None or a is None else sum(k == kk and aa is not None and abs(a - aa) <= 5 for _, kk, aa in rows) for i, k, a in rows}
    assert {r["id"]: r["n_within"] for r in got} == want and len(got) == len(rows)
    assert similar.counts_within(spark.createDataFrame([], "kind string, at bigint"), ["kind"], "at", 5).count() == 0


def test_one_hot_value_is_one_class(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("kind"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("at"))
    got = similar.counts_within(rows, ["kind"], "at", 2).groupBy("at").agg(F.min("n_within").alias("n"), F.max("n_within").alias("m")).filter("at = 5").first()
    assert got["n"] == got["m"] == rows.filter("at BETWEEN 3 AND 7").count()
