"""Repair of conversation structure: the cheapest edits that make speakers alternate.

The roles of a repaired conversation begin with s (system, at most once), u (user) or nothing,
and go on in pairs of user and assistant.  Four states say how far a prefix is: nothing yet,
after the system's turn, after a user's, after an assistant's.  Every turn is kept, given the
other role or deleted, and empty turns can be inserted before it; the costs are COST.

1.  Turns are put in the order (conversation, turn, hash of role and text) by ranges of that
    order and written without their texts.  A conversation is cut at the borders of ranges and
    after every PIECE turns, so the longest one spreads over tasks too.
2.  In a task, pieces are bucketed by length into tensors of time x pieces x states.  Costs to the
    end are updated for all pieces of a bucket at once, turn by turn from the last, and stored;
    the edits are then traced from the first turn on, again for all pieces at once.
3.  A piece with others after it doesn't know what comes then.  Its costs are a 4 x 4 table
    (from each state to each state); tables of one conversation are chained backwards for the
    costs at every border, then the states in which the cheapest edits cross them forwards.
4.  Texts move once, to be streamed in order of their conversation beside its list of edits.

Among equally cheap edits those are taken whose initials are least in ASCII (D, I, K, R).
The initials fix the roles: inserted and given roles are always the next that is allowed.

Defined results
    null conv_id          one conversation, whose conv_id is null
    null turn             before all others
    null role, null text  one space: no role that could be kept, a blank text
    equal turns           by the MD5 of role and text; equal rows are interchangeable
    repeated rows         duplicates of the first
    very long texts       streamed; hashed by the JVM
    very many turns       pieces in many tasks, the text streamed by one; the list of edits is one string
    empty table           no rows
    other columns         ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

SPACES = " \t\n\x0b\x0c\r"
DROP_COST, INSERT_COST, ROLE_COST, CUT_COST = 4, 3, 3, 3
PIECE = 1024  # turns of a piece at most
CELLS = 1 << 19  # turns of a tensor, about
TURNS = 500_000  # turns of a range, about
FAR = np.int64(1) << 40

START, SYSTEM, USER, ASSISTANT = range(4)  # states
NEXT = np.array([USER, USER, ASSISTANT, USER])  # where an inserted or renamed turn leads from each state
#: where a kept turn leads, by state and initial (s, u, a, any other); -1: it can't be kept
KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
END = np.array([0, 2 * INSERT_COST, INSERT_COST, 0])  # costs of ending in each state


def conversation_key() -> Column:
    """A string for conv_id that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _turns(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(conversation_key().alias("conv"), "turn", role.alias("role"), text.alias("text"))
    return rows.withColumn("tie", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")))


def _order(*more: str) -> list[Column]:
    return [F.col("conv"), *[F.col(c) for c in more], F.col("turn").asc_nulls_first(), F.col("tie")]


def _ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns without texts, twice: conv, turn; and in order with conv, seg, at, initial, fault."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    kind = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    rows = _turns(turns).select("conv", "turn", "tie", _initial(F.col("role")).cast("byte").alias("initial"), kind.cast("byte").alias("fault"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns-rows")
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"), F.col("row").alias("row"))
    first = rows.groupBy("conv", "tie").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("conv", "tie", F.col("first.row").alias("first_row"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("row") != F.col("first_row"), DUPLICATE).otherwise(F.col("fault"))
    rows = rows.join(first, ["conv", "tie"], "left").withColumn("fault", fault.cast("byte"))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TURNS))
    dealt = rows.repartitionByRange(n, *_order(), "row").sortWithinPartitions(*_order(), "row")
    dealt = dealt.select("conv", "turn", F.spark_partition_id().alias("seg"), F.monotonically_increasing_id().alias("at"), "initial", "fault")
    dealt = written(dealt, "turns-ordered")
    return dealt.select("conv", "turn"), dealt.drop("turn")


def _pieces(part: pd.DataFrame) -> pd.DataFrame:
    """Pieces of a range whose turns are in order: conv, k, begin, length, and whether the
    conversation may have other pieces."""
    conv = part["conv"].to_numpy()
    heads = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    sizes = np.diff(np.r_[heads, len(conv)])
    many = -(-sizes // PIECE)
    open_ = many > 1
    open_[[0, -1]] = True  # may go on in the ranges beside
    owner = np.repeat(np.arange(len(heads)), many)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    begin = heads[owner] + k * PIECE
    return pd.DataFrame({"conv": conv[heads][owner], "k": k, "begin": begin, "length": np.minimum(PIECE, heads[owner] + sizes[owner] - begin), "open": open_[owner]})


def _buckets(pieces: pd.DataFrame) -> Iterator[np.ndarray]:
    """Places in ``pieces`` of about the same length, so that a tensor has CELLS turns."""
    width = np.ceil(np.log2(np.maximum(pieces["length"].to_numpy(), 1))).astype(int)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        step = max(1, CELLS >> w)
        for i in range(0, len(some), step):
            yield some[i : i + step]


def _tensor(part: pd.DataFrame, pieces: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """initial and fault as (time, piece), and the lengths."""
    lengths = pieces["length"].to_numpy()
    time = np.arange(lengths.max())[:, None]
    at = np.minimum(pieces["begin"].to_numpy()[None, :] + time, len(part) - 1)
    return part["initial"].to_numpy()[at], part["fault"].to_numpy()[at], lengths


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs with inserts allowed first; states are the last axis."""
    out = cost.copy()
    out[..., USER] = np.minimum(cost[..., USER], cost[..., ASSISTANT] + INSERT_COST)
    out[..., ASSISTANT] = np.minimum(cost[..., ASSISTANT], cost[..., USER] + INSERT_COST)
    for s in (START, SYSTEM):
        out[..., s] = np.minimum(cost[..., s], out[..., USER] + INSERT_COST)
    return out


def _moves(initial: np.ndarray, fault: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of keeping and of renaming the turns of one time, by state; ``after``: costs then.

    initial, fault: (pieces); after: (pieces, ..., 4) with states last.
    """
    shape = (-1,) + (1,) * (after.ndim - 2)
    stays = np.where(fault == TRUNCATED, CUT_COST, np.where(fault == 0, 0, FAR)).reshape(shape)
    keep = np.empty_like(after)
    for s in range(4):
        to = KEEP[s][initial].reshape(shape)
        keep[..., s] = np.where(to < 0, FAR, np.take_along_axis(after, np.maximum(to, 0)[..., None] + np.zeros(after.shape[:-1] + (1,), np.int64), -1)[..., 0] + stays)
    return keep, after[..., NEXT] + ROLE_COST + stays[..., None]


def backward(initial: np.ndarray, fault: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs from before every turn to the end, inserts included: (time + 1, pieces, ..., 4)."""
    steps = len(initial)
    cost = np.empty((steps + 1, *end.shape), np.int64)
    cost[steps] = end
    shape = (-1,) + (1,) * (end.ndim - 1)
    for t in range(steps - 1, -1, -1):
        after = cost[t + 1]
        keep, rename = _moves(initial[t], fault[t], after)
        best = _closed(np.minimum(np.minimum(after + DROP_COST, keep), rename))
        cost[t] = np.where((t < lengths).reshape(shape), best, after)
    return cost


def traced(initial: np.ndarray, fault: np.ndarray, lengths: np.ndarray, cost: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Initials of the cheapest edits, least in ASCII, as bytes (pieces, time + 1, 3) with zeros
    between; and the state after each piece.  Inserts at the end belong to ``last`` pieces."""
    steps, n = initial.shape
    every = np.arange(n)
    edits = np.zeros((n, steps + 1, 3), np.uint8)
    state = state.copy()
    for t in range(steps + 1):
        if t < steps:
            live = t < lengths
            drop = cost[t + 1] + DROP_COST
            keep, rename = _moves(initial[t], fault[t], cost[t + 1])
        else:
            live = last
        for k in range(2):
            now, there = cost[t][every, state], NEXT[state]
            insert = live & (now == cost[t][every, there] + INSERT_COST)
            if t < steps:
                insert &= now != drop[every, state]
            edits[insert, t, k] = ord("I")
            state = np.where(insert, there, state)
        if t < steps:
            now = cost[t][every, state]
            dropped = live & (now == drop[every, state])
            kept = live & ~dropped & (now == keep[every, state])
            renamed = live & ~dropped & ~kept
            for letter, which in (("D", dropped), ("K", kept), ("R", renamed)):
                edits[which, t, 2] = ord(letter)
            state = np.where(kept, KEEP[state, initial[t]], np.where(renamed, NEXT[state], state))
    return edits, state


def _sorted(part: pd.DataFrame) -> pd.DataFrame:
    return part.sort_values("at").reset_index(drop=True)


def _transfers(part: pd.DataFrame) -> pd.DataFrame:
    """Costs from state to state of the pieces that may have others beside them."""
    part = _sorted(part)
    pieces = _pieces(part).query("open").reset_index(drop=True)
    table = np.zeros((len(pieces), 4, 4), np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)  # ends in this state only
    for some in _buckets(pieces):
        initial, fault, lengths = _tensor(part, pieces.iloc[some])
        table[some] = backward(initial, fault, lengths, np.broadcast_to(unit, (len(some), 4, 4)).copy())[0]
    flat = [row.ravel().tolist() for row in np.minimum(table, FAR).transpose(0, 2, 1)]  # from, to
    return pd.DataFrame({"conv": pieces["conv"], "seg": part["seg"].iloc[0], "k": pieces["k"], "table": flat})


def _borders(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of every piece of one conversation."""
    pieces = pieces.sort_values(["seg", "k"])
    ends, cost = [], END
    for table in reversed(pieces["table"].tolist()):
        ends.append(cost.tolist())
        cost = (np.asarray(table).reshape(4, 4) + cost[None, :]).min(1)
    return pd.DataFrame({"conv": pieces["conv"], "seg": pieces["seg"], "k": pieces["k"], "ends": ends[::-1], "last": [False] * (len(ends) - 1) + [True]})


def _crossings(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The state after each piece, for every state before it."""
    part = _sorted(part)
    pieces = _pieces(part).merge(known[["conv", "k", "ends", "last"]], on=["conv", "k"])
    to = np.zeros((len(pieces), 4), np.int32)
    for some in _buckets(pieces):
        chosen = pieces.iloc[some]
        initial, fault, lengths = _tensor(part, chosen)
        cost = backward(initial, fault, lengths, np.array(chosen["ends"].tolist(), np.int64))
        for s in range(4):
            to[some, s] = traced(initial, fault, lengths, cost, np.full(len(some), s), chosen["last"].to_numpy(bool))[1]
    return pd.DataFrame({"conv": pieces["conv"], "seg": part["seg"].iloc[0] if len(part) else 0, "k": pieces["k"], "ends": pieces["ends"], "last": pieces["last"], "after": to.tolist()})


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state before every piece of one conversation."""
    pieces = pieces.sort_values(["seg", "k"])
    state, before = START, []
    for after in pieces["after"]:
        before.append(state)
        state = after[state]
    return pieces[["conv", "seg", "k", "ends", "last"]].assign(state=before)


def _edited(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Edits and counts of every piece of a range."""
    part = _sorted(part)
    pieces = _pieces(part).merge(known[["conv", "k", "ends", "last", "state"]], on=["conv", "k"], how="left")
    alone = pieces["state"].isna().to_numpy()
    state = pieces["state"].fillna(START).to_numpy(int)
    last = np.where(alone, True, pieces["last"]).astype(bool)
    ends = np.array([END if a else x for a, x in zip(alone, pieces["ends"])], np.int64).reshape(-1, 4)
    initials, faults = part["initial"].to_numpy(), part["fault"].to_numpy()
    legal = np.isin(initials[:-1] * 4 + initials[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
    audit, cost = [""] * len(pieces), np.zeros(len(pieces), np.int64)
    for some in _buckets(pieces):
        initial, fault, lengths = _tensor(part, pieces.iloc[some])
        costs = backward(initial, fault, lengths, ends[some])
        edits, after = traced(initial, fault, lengths, costs, state[some], last[some])
        cost[some] = costs[0][np.arange(len(some)), state[some]] - np.where(last[some], 0, ends[some][np.arange(len(some)), after])
        for place, row in zip(some, edits.reshape(len(some), -1)):
            audit[place] = row[row > 0].tobytes().decode()
    begin, stop = pieces["begin"].to_numpy(), (pieces["begin"] + pieces["length"]).to_numpy()
    count = lambda hits: (total := np.r_[0, np.cumsum(hits)])[stop] - total[begin]
    total = np.r_[0, np.cumsum(~legal)]
    return pd.DataFrame({
        "conv": pieces["conv"], "seg": part["seg"].iloc[0] if len(part) else 0, "k": pieces["k"], "audit": audit, "cost": cost,
        "blank": count(faults == BLANK), "duplicate": count(faults == DUPLICATE), "truncated": count(faults == TRUNCATED),
        "illegal": total[stop - 1] - total[begin], "first": initials[begin], "final": initials[stop - 1],
    })


def repair_plans(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text): conv, gaps, blank,
    duplicate, truncated, illegal, cost, and audit, the initials of its edits in order."""
    rows, ordered = _ordered(turns)
    tables = written(ordered.groupBy("seg").applyInPandas(_transfers, "conv string, seg int, k bigint, table array<bigint>"), "turns-tables")
    borders = written(tables.groupBy("conv").applyInPandas(_borders, "conv string, seg int, k bigint, ends array<bigint>, last boolean"), "turns-borders")
    by_range = lambda known, f, kind: ordered.groupBy("seg").cogroup(known.groupBy("seg")).applyInPandas(f, kind)
    crossings = written(by_range(borders, _crossings, "conv string, seg int, k bigint, ends array<bigint>, last boolean, after array<int>"), "turns-crossings")
    entries = written(crossings.groupBy("conv").applyInPandas(_entries, "conv string, seg int, k bigint, ends array<bigint>, last boolean, state int"), "turns-entries")
    counts = ", ".join(f"{c} bigint" for c in ("cost", "blank", "duplicate", "truncated", "illegal"))
    edited = written(by_range(entries, _edited, f"conv string, seg int, k bigint, audit string, {counts}, first int, final int"), "turns-edited")

    parts = F.array_sort(F.collect_list(F.struct("seg", "k", "first", "final", "audit")))
    plans = edited.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], parts.alias("parts"))
    pair = lambda x, i: F.get("parts", i - 1)["final"] * 4 + x["first"]
    across = F.size(F.filter("parts", lambda x, i: (i > 0) & ~pair(x, i).isin(1, 6, 9)))
    plans = plans.withColumn("illegal", F.col("illegal") + across).withColumn("audit", F.array_join(F.transform("parts", lambda x: x["audit"]), "")).drop("parts")
    wide = lambda c: F.col(c).cast("decimal(22,0)")
    span = rows.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("*").alias("n"))
    gaps = span.select("conv", F.least(wide("high") - wide("low") + 1 - wide("n"), F.lit(2**63 - 1).cast("decimal(22,0)")).cast("long").alias("gaps"))
    plans = plans.join(gaps, "conv", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    return written(plans.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "turns-plans")


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired turns from turns in order, each conversation's behind a row with its edits."""
    conv, audit, p, place, follows, role_at = None, "", 0, 0, "user", {"user": "assistant", "assistant": "user"}

    def inserted(out: list) -> None:
        nonlocal p, place, follows
        while p < len(audit) and audit[p] == "I":
            out.append((conv, place, follows, ""))
            p, place, follows = p + 1, place + 1, role_at[follows]

    for batch in batches:
        out: list[tuple[str, int, str, str]] = []
        for key, is_turn, role, text in zip(batch["conv"], batch["is_turn"], batch["role"], batch["text"]):
            if not is_turn:
                inserted(out)  # what the one before ends with
                conv, audit, p, place, follows = key, text, 0, 0, "user"
                continue
            inserted(out)
            if audit[p] == "K":
                out.append((conv, place, role, text))
                place, follows = place + 1, "user" if role[0] in "sa" else "assistant"
            elif audit[p] == "R":
                out.append((conv, place, follows, text))
                place, follows = place + 1, role_at[follows]
            p += 1
        yield pd.DataFrame(out, columns=["conv", "place", "role", "text"])
    out = []
    inserted(out)
    yield pd.DataFrame(out, columns=["conv", "place", "role", "text"])


def _dealt(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Every conversation's edits (is_turn 0) and then its turns, in order, in one partition."""
    heads = plans.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("tie"), F.lit(0).alias("is_turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = _turns(turns).select("conv", F.col("turn").cast("long"), "tie", F.lit(1).alias("is_turn"), "role", "text")
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions(*_order("is_turn"))


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv (see ``conversation_key``), place from 0, role, text."""
    return _dealt(turns, plans).mapInPandas(_replayed, "conv string, place bigint, role string, text string")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, digest = None, hashlib.sha256()
    for batch in _replayed(batches):
        out = []
        for conv, role, text in zip(batch["conv"], batch["role"], batch["text"]):
            if conv != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def repaired_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation that has turns, as lines ``role:text``."""
    return _dealt(turns, plans).mapInPandas(_hashed, "conv string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with one row in five damaged, as its number tells: dropped, emptied, without
    its sentence ends, repeated, or given to the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(turns: DataFrame, original: DataFrame) -> DataFrame:
    """What the repair of ``turns`` finds and does, for every conv_id of ``original``."""
    plans = repair_plans(turns)
    every = original.select("conv_id", conversation_key().alias("conv")).distinct()
    out = every.join(plans, "conv", "left").join(repaired_digests(turns, plans), "conv", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
