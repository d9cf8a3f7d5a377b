from collections import defaultdict

from quarrylens.llm import packing


def _leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_last_query_does_not_grow_with_supersteps(spark, monkeypatch):
    """Sequences and plans of all supersteps are read by one scan of either, and give the same places."""
    steps, one = [], packing._superstep
    monkeypatch.setattr(packing, "_superstep", lambda *a: steps.append(1) or one(*a))
    seen = []
    for texts in (["word " * 60] * 20, ["word " * (1 + i * 37 % 127) for i in range(300)]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        steps.clear()
        placed = packing.packed(docs, capacity=128)
        seen.append((len(steps), _leaves(placed)))
        rows, at = placed.collect(), defaultdict(list)
        for r in rows:
            at[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r) for r in packing.pieces(docs, capacity=128).collect())
        for places in at.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
            assert sum(n for _, n in places) <= 128
    assert seen[0][0] < seen[1][0]
    assert seen[0][1] == seen[1][1] <= 6, seen
