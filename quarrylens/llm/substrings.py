"""Repeated passages: fixed-block anchors, rolling probes, exact extension.

A window is ``window`` consecutive words of one document.  A word is removed if a window that
covers it has a word sequence that also starts anywhere else in the table.

1.  Documents are put in chunks of a few megabytes and written as a table bucketed by chunk, so
    that later passes meet their chunk without moving the text again.
2.  Anchors: the blocks at positions 0, b, 2b, ... of each document, b = (window + 1) / 2, are
    the index; every window of a document holds at least one whole block.  Every rolling run of
    b words of every document probes it.  Both are hashed; a chunk sends each distinct hash
    once, packed by hash range, with two flags (it is an anchor; it occurs more than once
    here).  A range of hashes is one task's work; it answers with a bit for each hash it was
    sent: the content is an anchor and occurs elsewhere too.
3.  Extension: hits grow from the block to the window, left and right, and only windows around a
    hit go on.  What they extend to is exchanged as two independent hashes, 128 bits, by ranges
    of the first; the answer says whether the same sequence starts anywhere else.  Runs of
    repeated windows are the maximal exact repeats.
4.  Each chunk applies the answers to its documents.

What is exchanged is a few bytes a word at most, and a very frequent passage is sent once by
each chunk.  No pairs are made, and nothing passes through the driver but counts.  Texts of a
passage are never brought together to be compared word by word (a passage may stand in a third
of all documents); among 10**13 windows the chance of any two different ones sharing their 128
bits is below one in a million million.

Defined results
    null or empty text     no words, nothing removed, the hash of the empty string
    shorter than a window  nothing removed
    repeated rows          repeats of each other: all their windows are removed
    ties                   there are none: every occurrence of a repeat is removed
    very long text         a chunk of its own, which one task holds with about 100 bytes a word
    null doc_id            kept, like any other value
    empty table            no rows
    other columns          ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bucketed, text_bytes, text_column, written
from ._words import hashed_texts, window_hashes

WINDOW = 35
CHUNK_BYTES = 4 << 20
BUCKET_HASHES = 1 << 22  # hashes that one task of an exchange takes, about
SALT, SALT_2 = 0x2545F491, 0x6C62272E


def _chunked(docs: DataFrame, n_bytes: int) -> DataFrame:
    """doc_id and text in order (chunk, nth), as a table bucketed by chunk."""
    rows = docs.select("doc_id", text_column(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, used, nth = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            chunks = []
            for size in pc.binary_length(batch.column(1)).to_pylist():
                if used and used + size > CHUNK_BYTES:
                    chunk, used = chunk + 1, 0
                used += size
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(np.arange(nth, nth + len(batch)), pa.int64()), batch.column(0), batch.column(1)], ["chunk", "nth", "doc_id", "text"])
            nth += len(batch)

    return bucketed(rows.mapInArrow(number, f"chunk bigint, nth bigint, doc_id {kind}, text string"), "chunk", "passages", n_bytes)


class _Runs:
    """Rolling runs of one chunk's documents and what the exchange is told about them."""

    def __init__(self, texts: pa.Array):
        words, counts = [], []
        for _, hashes, offsets in hashed_texts(texts):
            words.append(hashes)
            counts.append(np.diff(offsets))
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ends = np.cumsum(self.counts)
        self.left = np.repeat(ends, self.counts) - np.arange(len(self.words))  # words to the document's end
        self.within = np.repeat(self.counts, self.counts) - self.left  # place in the document

    def starts(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.left >= size)

    def distinct(self, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the runs at ``starts``, each run's index there, counts."""
        hashes = window_hashes(self.words, size, SALT + size)
        return np.unique(hashes[starts], return_inverse=True, return_counts=True)

    def distinct_wide(self, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same in two hashes: first and second of each distinct pair, index, counts."""
        one, two = (window_hashes(self.words, size, salt + size)[starts] for salt in (SALT, SALT_2))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)]
        index = np.empty(len(one), np.int64)
        index[order] = np.cumsum(new) - 1
        return one[new], two[new], index, np.bincount(index, minlength=int(new.sum()))


def _ranges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the hash ranges in sorted ``values``; buckets is a power of two."""
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - buckets.bit_length() + 1)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def _parcels(chunk: int, values: np.ndarray, more: np.ndarray, flag: np.ndarray, buckets: int, second: np.ndarray | None = None) -> list[tuple]:
    at = _ranges(values, buckets)
    if second is None:  # four bytes, below the range's own bits
        body = ((values << np.uint64(buckets.bit_length() - 1)) >> np.uint64(32)).astype("<u4")
    else:
        body = np.column_stack([values, second]).astype("<u8")
    return [(k, chunk, body[a:b].tobytes(), np.packbits(more[a:b]).tobytes(), np.packbits(flag[a:b]).tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]


def _answer(step: int):
    """The work of one hash range: which of the hashes sent by each chunk are hits."""

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(x, "<u4") if step == 1 else np.frombuffer(x, "<u8").reshape(-1, 2) for x in part["hashes"]]
        bits = lambda column: [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(part[column], values)]
        flat, more, flag = np.concatenate(values), np.concatenate(bits("more")), np.concatenate(bits("flag"))
        order = np.argsort(flat, kind="stable") if step == 1 else np.lexsort((flat[:, 1], flat[:, 0]))
        change = flat[order][1:] != flat[order][:-1]
        first = np.concatenate([[True], change if step == 1 else change.any(axis=1)])
        group = np.empty(len(flat), np.int64)
        group[order] = np.cumsum(first) - 1
        often = np.bincount(group, 1 + more) >= 2
        wanted = np.bincount(group, flag) > 0
        hit = (often & wanted)[group]
        borders = np.cumsum([len(v) for v in values])[:-1]
        return pd.DataFrame({"chunk": part["chunk"], "step": step, "bucket": part["bucket"], "hits": [np.packbits(x).tobytes() for x in np.split(hit, borders)]})

    return answer


_ANSWER = "chunk bigint, step int, bucket int, hits binary"
_PARCEL = "bucket int, chunk bigint, hashes binary, more binary, flag binary"


def _hits(answers: pd.DataFrame, step: int, values: np.ndarray, buckets: int) -> np.ndarray:
    """The exchange's answer for each of the sorted distinct hashes that were sent."""
    at, out = _ranges(values, buckets), np.zeros(len(values), bool)
    mine = answers[answers["step"] == step]
    for k, x in zip(mine["bucket"], mine["hits"]):
        out[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=int(at[k + 1] - at[k]))
    return out


def _candidates(runs: _Runs, answers: pd.DataFrame, block: int, window: int, buckets: int) -> np.ndarray:
    """Starts of the windows that hold a rolling run which was hit."""
    starts = runs.starts(block)
    values, index, _ = runs.distinct(block, starts)
    hit = np.zeros(len(runs.words) + 1, np.int64)
    hit[starts + 1] = _hits(answers, 1, values, buckets)[index]
    total = np.cumsum(hit)
    at = runs.starts(window)
    return at[total[at + window - block + 1] > total[at]]


def repeated_passages(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the spans of words that repeat, and the kept text.

    ``spans`` are [first word, end) pairs of maximal repeats; kept words are joined by one space.
    """
    block = (window + 1) // 2
    total = text_bytes(docs)
    table = _chunked(docs, total)
    buckets = 64
    while buckets * BUCKET_HASHES * 6 < total and buckets < 1 << 31:  # about six characters a word
        buckets *= 2
    kind = table.schema["doc_id"].dataType.simpleString()

    def probe(part: pd.DataFrame) -> pd.DataFrame:
        runs = _Runs(pa.array(part["text"], pa.large_string()))
        starts = runs.starts(block)
        values, index, counts = runs.distinct(block, starts)
        anchor = np.zeros(len(values), bool)
        anchor[index[runs.within[starts] % block == 0]] = True
        return pd.DataFrame(_parcels(int(part["chunk"].iloc[0]), values, counts > 1, anchor, buckets), columns=["bucket", "chunk", "hashes", "more", "flag"])

    ordered = lambda part: part.sort_values("nth", kind="stable")
    first = table.groupBy("chunk").applyInPandas(lambda part: probe(ordered(part)), _PARCEL)
    first = written(first.groupBy("bucket").applyInPandas(_answer(1), _ANSWER), "passages-anchors")

    def extend(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if len(part) == 0:
            return pd.DataFrame([], columns=["bucket", "chunk", "hashes", "more", "flag"])
        runs = _Runs(pa.array(ordered(part)["text"], pa.large_string()))
        values, second, _, counts = runs.distinct_wide(window, _candidates(runs, answers, block, window, buckets))
        return pd.DataFrame(_parcels(int(part["chunk"].iloc[0]), values, counts > 1, np.ones(len(values), bool), buckets, second), columns=["bucket", "chunk", "hashes", "more", "flag"])

    second = table.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInPandas(extend, _PARCEL)
    second = written(second.groupBy("bucket").applyInPandas(_answer(2), _ANSWER), "passages-windows")

    def remove(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        part = ordered(part)
        texts = pa.array(part["text"], pa.large_string())
        runs = _Runs(texts)
        starts = _candidates(runs, answers, block, window, buckets)
        values, _, index, _ = runs.distinct_wide(window, starts)
        starts = starts[_hits(answers, 2, values, buckets)[index]]
        change = np.zeros(len(runs.words) + 1, np.int64)
        change[starts] += 1  # starts are distinct
        change[starts + window] -= 1
        gone = np.cumsum(change)[:-1] > 0
        out, at = [], 0
        for doc_id, text, count in zip(part["doc_id"], part["text"], runs.counts):
            cut = gone[at : at + count]
            words = text.encode().split()
            n = int(cut.sum())
            if n:
                words = [w for w, x in zip(words, cut) if not x]
            kept = b" ".join(words)
            row = [doc_id, int(count), n, hashlib.sha256(kept).hexdigest()]
            if with_text:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                row += [edges.reshape(-1, 2).tolist(), kept.decode()]
            out.append(row)
            at += count
        return pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["spans", "kept_text"] * with_text)]
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", spans array<array<bigint>>, kept_text string" * with_text
    return table.groupBy("chunk").cogroup(first.union(second).groupBy("chunk")).applyInPandas(remove, schema)
