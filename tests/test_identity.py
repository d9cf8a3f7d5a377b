import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import identity


def brute(mentions):
    parent = {}

    def root(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for keys in mentions:
        for k in keys:
            a, b = root(keys[0]), root(k)
            parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in parent}


def frame(spark, mentions):
    return spark.createDataFrame([(m,) for m in mentions], "keys array<string>")


@pytest.mark.parametrize("cuts", [(), (150,), (1, 60, 299)])
def test_batches_give_what_one_gives(spark, cuts):
    """Chains, stars and copies; a third of the mentions are one hot name."""
    rng = random.Random(len(cuts))
    mentions = [[f"k{rng.randrange(140):03}" for _ in range(rng.choice([1, 1, 2, 3]))] for _ in range(150)]
    mentions += [[f"c{n:02}", f"c{n + 1:02}"] for n in range(50)] + [["hot", f"h{n % 7}"] for n in range(100)] + [[]]
    rng.shuffle(mentions)
    ends = [0, *cuts, len(mentions)]
    got = identity.entities([frame(spark, mentions[a:b]) for a, b in zip(ends, ends[1:])]).collect()
    assert {r["key"]: r["entity"] for r in got} == brute(mentions) and len(got) == len(brute(mentions))


def test_a_batch_gives_only_what_it_changes(spark):
    known = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "b"), ("z", "z")], "key string, entity string")
    got = identity.merged(known, frame(spark, [["c", "a"], ["z", "new"], ["z"]]))
    assert sorted(map(tuple, got.collect())) == [("b", "a"), ("c", "a"), ("new", "new"), ("z", "new")]
    assert identity.merged(known, frame(spark, [["a"], ["b", "c"], []])).count() == 0


def test_keys_of_mentions(spark):
    df = spark.createDataFrame([("x", "CITY", "Q1"), (None, "CITY", "Q1"), ("x", None, ""), ("", "CITY", None)], "n string, t string, o string")
    got = [r[0] for r in df.select(identity.identity_keys(F.col("n"), F.col("t"), F.col("o"))).collect()]
    assert got == [["id:Q1", "name:CITY:x"], ["id:Q1"], [], []]
