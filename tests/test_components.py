import random
import time

import pytest

from quarrylens.operators import components, rules


def brute(edges):
    """(graph, node): the least node that it reaches and that reaches it."""
    out, nodes = {}, set()
    for g, s, t in edges:
        out.setdefault((g, s), set()).add((g, t))
        nodes |= {(g, s), (g, t)}

    def reached(n):
        seen, todo = {n}, [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    reach = {n: reached(n) for n in nodes}
    return {n: min(m[1] for m in reach[n] if n in reach[m]) for n in nodes}


def made(seed):
    rng = random.Random(seed)
    edges = []
    for g in ("dense", "sparse", "chain", None):
        n = {"dense": 40, "sparse": 120, "chain": 150}.get(g, 30)
        if g == "chain":  # rings and chains hung on each other
            order = [f"c{k:03}" for k in rng.sample(range(n), n)]
            edges += [(g, a, b) for a, b in zip(order, order[1:]) if rng.random() < 0.97]
            edges += [(g, order[60], order[10]), (g, order[140], order[100])]
        else:
            edges += [(g, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(n * (4 if g == "dense" else 1) + 10)]
    return edges + [("self", "a", "a"), ("self", "a", "b"), ("two", "a", "b"), ("two", "b", "a"), ("two", "a", "b")]


@pytest.mark.parametrize(("seed", "in_task"), [(1, 200_000), (2, 60), (3, 0)])
def test_components_by_brute_force(spark, seed, in_task):
    edges = made(seed)
    df = spark.createDataFrame(edges, "graph string, source string, target string")
    got = components.strong_components(df, edges_in_task=in_task).collect()
    assert {(r["graph"], r["node"]): r["component"] for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_cycles_by_brute_force(spark):
    edges = made(7)
    found = brute(edges)
    sizes = {}
    for (g, _), c in found.items():
        sizes[g, c] = sizes.get((g, c), 0) + 1
    want = {(g, n) for (g, n), c in found.items() if sizes[g, c] > 1} | {(g, s) for g, s, t in edges if s == t}
    got = rules.cycles(spark.createDataFrame(edges, "graph string, source string, target string")).collect()
    assert {(r["graph"], r["node"]) for r in got} == want and len(got) == len(want)


def test_a_large_ring_shrinks(spark):
    """100,000 nodes in a ring, with a chain of 50,000 hung on it, by rounds down to what a task may have."""
    n = 100_000
    ring = spark.range(n).selectExpr("'g' AS graph", "id AS source", f"(id + 1) % {n} AS target")
    chain = spark.range(n, n + 50_000).selectExpr("'g' AS graph", "id AS source", "id + 1 AS target")
    began = time.time()
    rows = components.strong_components(ring.union(chain), edges_in_task=20_000)
    sizes = rows.groupBy("component").count().groupBy("count").count().collect()
    assert {tuple(r) for r in sizes} == {(n, 1), (1, 50_001)}
    assert time.time() - began < 600


def test_no_edges(spark):
    assert rules.cycles(spark.createDataFrame([("g", "a", None)], "graph string, source string, target string")).count() == 0
