import random

import numpy as np
import pytest

from quarrylens.llm import minhash


def test_texts_are_not_shuffled(spark, monkeypatch):
    """The sets of what shares a bucket come from a scan of the texts."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts + [t + " more" for t in texts[:40]] + [None, "", " "])] + [(None, texts[0]), (3, "another text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plans, write = [], minhash.written

    def spy(df, name, *rest):
        if name == "minhash-sets":
            plans.append(df._jdf.queryExecution().toString())
        return write(df, name, *rest)

    monkeypatch.setattr(minhash, "written", spy)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).filter("doc_id <> 3").collect()}
    assert got == {k: k - 300 if 300 <= k < 340 else k for k in range(343) if k != 3}
    assert len(plans) == 1 and "Exchange" not in plans[0]


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_every_asked_id_has_its_sets(spark, monkeypatch, most):
    """Also in a bitmap that is nearly full; ids may be any whole numbers of any type."""
    monkeypatch.setattr(minhash, "MOST_BITS", most)
    ids = [-5, 0, 7] + list(range(2**31 - 5000, 2**31 - 1))
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in ids] + [(7, "x y z"), (8, "  "), (None, "a b c")], "doc_id int, text string")
    asked = spark.createDataFrame([(i,) for i in [*ids[::2], 7, 8]], "class_id bigint").distinct()
    rows = minhash.full_sets(docs, 2, asked).collect()
    have = [r["class_id"] for r in rows]
    assert set(ids[::2]) | {7} <= set(have) and have.count(7) == 2 and None not in have and 8 not in have
    assert all(len(np.frombuffer(r["shingles"], np.uint64)) == (3 if len(r["shingles"]) > 16 else 2) for r in rows)
    assert most == 1 << 15 or len(have) < 1.1 * len(ids) / 2
