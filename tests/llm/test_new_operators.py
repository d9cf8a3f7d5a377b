import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import conversations, negatives, sharding
from quarrylens.llm._spark import written

from . import brute

# 11 sharding


def keyed(spark, docs):
    return written(docs.select("doc_id", sharding.row_key(docs).alias("__key"), sharding.row_size(docs).alias("__size")), "test-rows")


def check_shards(spark, docs, shards=4, grain=16, **more):
    rows = keyed(spark, docs)
    got = sharding.assigned(rows, shards, grain, **more).collect()
    want = brute.shards([(r["__key"], r["__size"]) for r in rows.collect()], shards, grain)
    assert {r["__key"]: r["__shard"] for r in got} == want and len(got) == len(want)
    slots = defaultdict(list)
    for r in got:
        slots[r["__shard"]].append((r["__slot"], r["__key"]))
    for some in slots.values():
        assert [s for s, _ in sorted(some)] == list(range(len(some))) and [k for _, k in sorted(some)] == sorted(k for _, k in some)
    return got


@pytest.mark.parametrize("more", [{}, {"ranges": 5, "per_range": 1}, {"ranges": 300}])
def test_shards_by_brute_force(spark, edge, more):
    """Few draws, so that ranges come out overfull, and more ranges than most shards have rows."""
    check_shards(spark, spark.read.parquet(f"{edge}/documents.parquet"), **more)


def test_hot_group_is_split_and_small_groups_stay_whole(spark):
    rng = random.Random(9)
    texts = ["same text"] * 400 + [f"pair {i // 2} " + "x" * rng.randrange(30) for i in range(800)]
    docs = spark.createDataFrame([(i % 50 if i < 300 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = check_shards(spark, docs, shards=8, grain=8)
    sizes, groups = Counter(), defaultdict(set)
    for r in got:
        sizes[r["__shard"]] += r["__size"]
        groups[r["__key"][:32]].add(r["__shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(t) + 1 for t in texts) * 2
    assert len(groups[hashlib.md5(b"same text").hexdigest()]) > 1 and all(len(g) == 1 for k, g in groups.items() if k != hashlib.md5(b"same text").hexdigest())


def test_overfull_ranges_are_subdivided(spark):
    rows = keyed(spark, spark.createDataFrame([(i, "hot" if i < 700 else str(i)) for i in range(1000)], "doc_id bigint, text string"))
    total = rows.agg(F.sum("__size")).first()[0]
    _, sums = sharding.split(rows, total, 20, per_range=1)
    assert sum(sums.values()) == total and max(sums.values()) <= 2 * total / 20


def test_shard_files_hold_every_row(spark, edge, tmp_path):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(str, back.select(*docs.columns).collect())) == Counter(map(str, docs.collect()))
    for _, rows in back.select("shard", "slot").toPandas().groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))


def test_room_is_level():
    assert sharding.room([0, 0, 10], 20) == [10, 10, 0] and sharding.room([5, 0], 0) == [0, 0] and sharding.room([50, 1, 2], 7) == [0, 4, 3]


# 12 hard negatives


def vectors(n, dims, seed=1, spread=0.2):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread / 2) for c in rng.choice(centers)], rng.randrange(10)) for i in range(n)]


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.hard_negatives(df, label, F.col("vec_id") % 100 == 0).collect()), key=str)


@pytest.mark.parametrize(("block", "pack", "fan"), [(8192, 512, 32), (100, 3, 2)])
def test_negatives_by_brute_force(spark, monkeypatch, block, pack, fan):
    """A third of the rows in one group of copies; in one block and in several, merged in levels."""
    for name, value in (("BLOCK_ROWS", block), ("PACK", pack), ("FAN", fan)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(700, 8)
    rows += [(1000 + i, rows[0][1], 3 if i % 3 else 5) for i in range(350)]
    assert found(spark, rows) == brute.hard_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = vectors(300, 5)
    usable = rows + [(300, [], 1), (301, [], 2), (302, [], 1), (7, rows[0][1], 1), (100, rows[1][1], 4), (100, rows[1][1], 4), (None, rows[100][1], 3), (None, rows[2][1], 8), (400, [0.1, 0.2], 1), (401, [0.1, 0.2], 1), (402, [0.1, 0.1], 2), (500, [50.0] * 5, 1), (501, [49.0] * 5, 1), (502, [30.0] * 5, 2)]
    odd = [(600, None, 1), (700, [1.0, None], 1), (800, [float("nan")] * 5, 2), (900, [float("inf")] + [0.0] * 4, 2), (1000, rows[0][1], None), (1100, [1e30] * 5, 1)]
    got = found(spark, usable + odd)
    assert got == brute.hard_negatives(usable) and {300, 400, 500} <= {r[0] for r in got}


def test_bounds_hold_and_prune(spark):
    import numpy as np

    x = np.floor(256 * np.array([v for _, v, _ in vectors(2000, 16)])).astype(np.int32)
    codes, low, high = negatives.quantised(x)
    every = np.arange(16)
    assert (low[every, codes] <= x).all() and (x <= high[every, codes]).all()
    low, high = low[every, codes], high[every, codes]
    q = x[:20].astype(float)
    middle, reach = q @ ((low + high) / 2).T, np.abs(q) @ ((high - low) / 2).T
    exact = q @ x.T
    assert (np.abs(exact - middle) <= reach + 1e-6).all()
    assert (middle + reach >= np.sort(middle - reach, 1)[:, [-5]]).mean() < 0.15  # few rows need an exact score


# 13 conversation repair


def check_repair(spark, turns):
    """turns: (conv_id, turn, role, text), damaged already."""
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in conversations.repair_report(df, df).collect()}
    plans = conversations.repair_plans(df)
    whole = defaultdict(list)
    for r in conversations.repaired_turns(df, plans).collect():
        whole[r["conv"]].append((r["place"], r["role"], r["text"]))
    by = defaultdict(list)
    for c, t, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        by[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest(), role, text))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows = sorted(rows)
        faults, cost, audit, out = brute.repaired([r[3:] for r in rows])
        initials = [r[3][:1] if r[3][:1] in ("s", "u", "a") else "?" for r in rows]
        numbers = {r[1] for r in rows if r[0]}
        want = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
        assert tuple(got[c])[1:] == want, (c, audit)
        assert [r[1:] for r in sorted(whole["null" if c is None else f"c{c}"])] == list(out)


def made_turns(n, longest, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            role = rng.choice(["system", "tool", "", None, "user"]) if rng.random() < 0.15 else role
            text = rng.choice(["", " \n", None, "ok.", "no end"]) if rng.random() < 0.3 else f"text {rng.randrange(40)}" + rng.choice([".", "! ", "?", ""])
            out.append((c, None if rng.random() < 0.05 else t + (t > 5) * 3, role, text))
    return out


@pytest.mark.parametrize(("piece", "cells"), [(1024, 1 << 19), (4, 64), (1, 8)])
def test_repair_by_brute_force(spark, monkeypatch, piece, cells):
    """Whole conversations, and the same cut into pieces whose costs are chained."""
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "CELLS", cells)
    rows = made_turns(60, 14, piece) + made_turns(1, 2, 5)
    rows += [(1000, t, ("user", "assistant", "user", "tool")[t % 4], f"text {t % 90}.") for t in range(400)]  # two thirds of all rows
    rows += [(None, None, "system", "only."), (None, 3, None, None), (1001, 2**62, "user", "far."), (1001, -(2**62), "user", "far?"), *[(1002, 0, "assistant", "again!")] * 30]
    check_repair(spark, rows)


def test_repair_of_very_long_texts_and_batches(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "é" * 500_000), (1, 2, "user", "\x0b\x0c" * 100_000), (2, 0, "assistant", "?")]
    rows += [(3, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(2_500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        check_repair(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_damage_is_what_the_contract_says(spark):
    import zlib

    rows = [(i // 4, i % 4, ("user", "assistant")[i % 2], f"One. Two! Three? {i}") for i in range(800)] + [(None, 1, None, None), (5, None, "system", "x.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: text.replace(".", "").replace("!", "").replace("?", "")}.get(kind, text)
        if kind:
            want[c, t, "user" if kind == 4 else role, text] += 2 if kind == 3 else 1
    assert Counter(map(tuple, conversations.damaged(df).collect())) == want
