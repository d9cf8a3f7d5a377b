import random

import numpy as np
import pytest

from quarrylens.llm import search


def documents(rng, n):
    """Texts of a few very common words and many rarer ones; some are near copies."""
    out = []
    for i in range(n):
        text = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))] + [f"w{int(rng.paretovariate(0.7)) % 4000}" for _ in range(rng.randrange(40))]
        out.append(" ".join(text) if i % 9 or not out else out[rng.randrange(len(out))] + " z")
    return out


def parts(texts):
    ids = {}
    for t in texts:
        for w in t.split():
            ids.setdefault(w, len(ids))
    return [(i, *np.unique(np.array([ids[w] for w in t.split()], np.int64), return_counts=True)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cells, wide", [(1 << 24, 8), (1000, 8), (1, 8), (1 << 24, 10**9), (1 << 24, 0)])
def test_shard_equals_all_scores(monkeypatch, cells, wide):
    """Long lists in the tables, some of them, or none; all queries wide, or none."""
    monkeypatch.setattr(search, "LONG_CELLS", cells)
    monkeypatch.setattr(search, "WIDE", wide)
    docs = parts(documents(random.Random(3), 701))
    batch = search._shard(docs)
    shard = search._Shard({c: batch.column(c)[0].as_py() for c in search._SHARD}, 20.0)
    assert shard.long.shape[1] * len(docs) <= cells or not shard.long.shape[1]
    asked = docs[::20]
    query = np.repeat(np.arange(len(asked)), [len(t) for _, t, _ in asked])
    terms, weights = np.concatenate([t for _, t, _ in asked]), np.concatenate([c / (1 + t) + 0.37 for _, t, c in asked])
    least = np.zeros(len(asked))
    for turn in range(2):  # the second time with thresholds
        got = shard.best(query, terms, weights, least, 10)
        for q in range(len(asked)):
            ask = dict(zip(terms[query == q].tolist(), weights[query == q].tolist()))
            scores = []
            for i, t, c in docs:
                damp = search.K1 * (1 - search.B + search.B * c.sum() / 20.0)
                scores.append((-round(sum(ask.get(w, 0) * n * (search.K1 + 1) / (n + damp) for w, n in zip(t.tolist(), c.tolist())), 6), i))
            want = [(i, -s) for s, i in sorted(scores)[:10] if s < 0]
            assert np.allclose([s for _, s in want], got[q][1], atol=1.1e-6)
            assert len(want) == len(got[q][0]) and {i for i, s in want if s > want[-1][1] + 2e-6} <= set(got[q][0].tolist())


def test_a_task_returns_k_results_a_query(spark, monkeypatch):
    """However many shards it holds: what is merged grows with tasks, not with documents."""
    texts = documents(random.Random(4), 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    seen, write = [], search.written

    def spy(df, name, *rest):
        out = write(df, name, *rest)
        if name == "search-found":
            seen.append((out.selectExpr("sum(length(ids)) / 8 AS n").first()["n"]))
        return out

    monkeypatch.setattr(search, "written", spy)
    found = search.top_k(docs, docs["doc_id"] % 10 == 0, k=3, shard_words=300).collect()
    assert len(found) == 40 * 3 and sum(seen) == 40 * 3
