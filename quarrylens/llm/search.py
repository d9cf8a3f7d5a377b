"""Exact top-k search by BM25: an inverted index for each shard, block-max WAND, exact merge.

1.  A task turns the documents it reads into shards of some millions of words.  A shard holds
    inverted lists over documents in order of length, so that blocks of documents have tight
    maxima.  Shards are written once.
2.  Global statistics: documents, mean length, and each term's document frequency, summed over
    all shards.
3.  Queries (whole texts) get their terms' global weights and are put in blocks of a bounded
    number of terms; one block at a time is sent to all shards.
4.  A shard takes a batch of the block's queries at once.  The short lists of a query's terms are
    read, and give every document in them a partial score.
5.  Block-max WAND: the long lists are not read, but bounded by their maxima in each block of
    documents.  Blocks whose partial scores and bounds together don't reach the query's threshold
    are passed over.  If many blocks are left, their documents are bounded too, by a product in
    single precision, whose best blocks set the threshold.  A document is a pivot if its bound
    reaches the threshold; only pivots are scored in full, in double precision.
6.  A task keeps the best k of all its shards, which raise the thresholds; what the tasks return,
    packed by parts of the queries, merges to the exact best k of all.

Work is queries times documents by nature: a long query shares words with most documents, and its
tenth score is no more than the bounds of half of them.

Scores count to six decimals; equal scores are ranked by doc_id.  Words are lower-cased A-Z runs
of ``[^\\x20\\x09-\\x0D]+``; a word that a query repeats weighs as often as it stands there.

Defined results
    null or empty text     never found; as a query it has no results
    no word in common      not a result, so a query may have fewer than k
    very long text         one document of a shard that may be all its own; as a query, all its terms
    ties                   equal scores by doc_id; of repeated rows as many as fit
    repeated rows          each is a document (tied), and each is a query of its own
    null doc_id            found, ranked after equal scores; never a query
    empty table            no rows
    other columns          ignored.  doc_id is a whole number
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import text_column, written
from ._words import hashed_texts

K = 10
K1, B = 1.2, 0.75
SHARD_WORDS = 4_000_000
BLOCK_DOCS = 16
LONG_LISTS = 8  # a list is long if it has more than this part of the shard's documents
LONG_CELLS = 1 << 24  # of a table of the long lists by document
WIDE = 8  # a query is wide in a shard if more than this part of the blocks can hold results
BATCH_CELLS = 1 << 18  # partial scores that are kept at once
PART_BYTES = 64 << 20  # of results that one task merges
QUERY_TERMS = 2_000_000  # of a block of queries, 16 bytes each
DECIMALS = 6
_NO_ID = -(1 << 63)  # stands for a null doc_id inside a shard


def _terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(words.view(np.int64), return_counts=True)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(id, terms, counts) of each text that has words."""
    for batch in batches:
        ids = batch.column(0).fill_null(_NO_ID).to_numpy()
        for row, words, offsets in hashed_texts(batch.column(1), lower=True):
            for k in range(len(offsets) - 1):
                if offsets[k + 1] > offsets[k]:
                    yield int(ids[row + k]), *_terms(words[offsets[k] : offsets[k + 1]])


_SHARD = ["ids", "lengths", "vocabulary", "frequencies", "docs", "counts"]
_TYPES = {"ids": np.int64, "lengths": np.int32, "vocabulary": np.int64, "frequencies": np.int32, "docs": np.int32, "counts": np.int32}


def _shard(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lengths = np.array([c.sum() for _, _, c in docs])
    by_length = np.argsort(lengths, kind="stable")
    docs = [docs[k] for k in by_length]
    flat = np.concatenate([t for _, t, _ in docs])
    of = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for _, t, _ in docs])
    order = np.argsort(flat, kind="stable")  # lists by term, documents in order
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    parts = {
        "ids": np.array([i for i, _, _ in docs]),
        "lengths": lengths[by_length],
        "vocabulary": flat[first],
        "frequencies": np.diff(np.append(first, len(flat))),
        "docs": of[order],
        "counts": np.concatenate([c for _, _, c in docs])[order],
    }
    columns = [pa.array([len(docs)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array([parts[c].astype(_TYPES[c]).tobytes()], pa.binary()) for c in _SHARD]], ["n_docs", "n_words", *_SHARD])


def indexed(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each shard of ``docs`` (doc_id bigint, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, words = [], 0
        for doc in _documents(batches):
            have.append(doc)
            words += int(doc[2].sum())
            if words >= shard_words:
                yield _shard(have)
                have, words = [], 0
        if have:
            yield _shard(have)

    schema = "n_docs bigint, n_words bigint, " + ", ".join(f"{c} binary" for c in _SHARD)
    return written(docs.select(F.col("doc_id").cast("bigint"), text_column(docs).alias("text")).mapInArrow(build, schema), "search-shards", "zstd")


def document_frequencies(index: DataFrame) -> DataFrame:
    """term and df over all shards."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, f in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v.as_py(), np.int64)), pa.array(np.frombuffer(f.as_py(), np.int32).astype(np.int64))], ["term", "df"])

    return index.select("vocabulary", "frequencies").mapInArrow(each, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _first(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each query, in order, with their ranks."""
    order = np.lexsort((np.where(ids == _NO_ID, (1 << 63) - 1, ids), -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))[: len(query)]
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) + 1
    best = rank <= k
    return query[best], ids[best], scores[best], rank[best]


class _Shard:
    """A shard as arrays: inverted lists with weights, and for the long ones block maxima and
    tables of counts and of weights in single precision by document."""

    def __init__(self, row: dict, mean_length: float):
        part = {c: np.frombuffer(row[c], _TYPES[c]) for c in _SHARD}
        self.ids, self.vocabulary, self.docs = part["ids"], part["vocabulary"], part["docs"].astype(np.intp)
        n = len(self.ids)
        self.damp = K1 * (1 - B + B * part["lengths"] / mean_length)
        self.weight = part["counts"] * (K1 + 1) / (part["counts"] + self.damp[self.docs])
        self.at = np.concatenate([[0], np.cumsum(part["frequencies"])])
        long = np.flatnonzero(part["frequencies"] * LONG_LISTS > n)
        if len(long) * n > LONG_CELLS:  # the longest that the tables have room for
            long = np.sort(long[np.argsort(-part["frequencies"][long], kind="stable")[: LONG_CELLS // n]])
        self.column = np.full(len(self.vocabulary), -1, np.int64)
        self.column[long] = np.arange(len(long))
        self.n_blocks = -(-n // BLOCK_DOCS)
        self.counts = np.zeros((n, len(long)), np.int32)
        self.long = np.zeros((self.n_blocks * BLOCK_DOCS, len(long)), np.float32)
        for k, t in enumerate(long):
            span = slice(self.at[t], self.at[t + 1])
            self.counts[self.docs[span], k] = part["counts"][span]
            self.long[self.docs[span], k] = self.weight[span]
        self.most = self.long.reshape(self.n_blocks, BLOCK_DOCS, -1).max(1)
        self.error = 1 + (len(long) + 4) * 2.0**-23  # sums in single precision are less than this factor off

    def _full(self, docs: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """What the long lists add to the scores of some documents, in double precision."""
        terms = np.flatnonzero(ask)
        counts = self.counts[np.ix_(docs, terms)]
        return (counts * (K1 + 1) / (counts + self.damp[docs, None])) @ ask[terms]

    def best(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best ``k`` for each query 0, 1, ... of the batch; none below
        ``least``, the thresholds so far, which are raised."""
        n, many = len(self.ids), len(least)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        here = self.vocabulary[at] == terms
        query, at, weights = query[here], at[here], weights[here]
        column = self.column[at]
        # short lists are read
        short = column < 0
        start, size, factor = self.at[at[short]], self.at[at[short] + 1] - self.at[at[short]], weights[short]
        ends = np.searchsorted(query[short], np.arange(many), "right")
        filled = np.concatenate([[0], np.cumsum(size)])
        numbers = np.arange(np.diff(filled[ends], prepend=0).max(initial=0))
        partial = np.zeros((many, self.n_blocks * BLOCK_DOCS))
        for q in range(many):
            a, b = ends[q - 1] if q else 0, ends[q]
            which = np.repeat(start[a:b] - filled[a:b] + filled[a], size[a:b])
            which += numbers[: len(which)]
            value = self.weight.take(which)
            value *= np.repeat(factor[a:b], size[a:b])
            partial[q] = np.bincount(self.docs.take(which), value, partial.shape[1])
        # long lists are bounded by block
        ask = np.zeros((many, self.long.shape[1]))
        ask[query[~short], column[~short]] = weights[~short]
        narrow = ask.astype(np.float32)
        most = partial.reshape(many, self.n_blocks, BLOCK_DOCS).max(2) + (narrow @ self.most.T) * self.error
        slack = 10.0**-DECIMALS
        border = np.maximum(least - slack, slack / 10)
        # where many blocks are left, their documents are bounded in single precision, and so are the blocks
        wide = np.flatnonzero((most >= border[:, None]).sum(1) * WIDE > self.n_blocks)
        bound = dict(zip(wide.tolist(), partial[wide] + (narrow[wide] @ self.long.T) * self.error))
        for q, scores in bound.items():
            most[q] = scores.reshape(self.n_blocks, BLOCK_DOCS).max(1)
            if self.n_blocks >= k:  # k documents of different blocks
                sure = np.partition(most[q], self.n_blocks - k)[self.n_blocks - k] / self.error**2
                least[q] = max(least[q], sure)
        border = np.maximum(least - slack, slack / 10)
        out = []
        for q in range(many):
            pivots = (np.flatnonzero(most[q] >= border[q])[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
            pivots = pivots[pivots < n]
            if q in bound:
                pivots = pivots[bound[q][pivots] >= border[q]]
            scores = np.round(partial[q, pivots] + self._full(pivots, ask[q]), DECIMALS)
            found = scores >= border[q]
            docs, scores = pivots[found], scores[found]
            _, ids, scores, _ = _first(np.zeros(len(docs), np.int64), self.ids[docs], scores, k)
            if len(scores) == k:
                least[q] = max(least[q], scores[-1] - slack)
            out.append((ids, scores))
        return out


def top_k(docs: DataFrame, is_query: Column, k: int = K, shard_words: int = SHARD_WORDS) -> DataFrame:
    """query_id, rank, doc_id and score: the best ``k`` documents for each row of ``is_query``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column(docs).alias("text"))
    asked = rows.filter(is_query & F.col("doc_id").isNotNull())
    index = indexed(rows, shard_words)
    n_docs, n_words, n_shards = index.agg(F.sum("n_docs"), F.sum("n_words"), F.count("*")).first()
    n_docs, mean = n_docs or 0, (n_words or 0) / max(n_docs or 0, 1)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (i, terms, counts) in enumerate(_documents(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([n]), pa.array([terms], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], ["query_id", "nth", "terms", "counts"])

    queries = asked.mapInArrow(words_of, "query_id bigint, nth bigint, terms array<bigint>, counts array<bigint>")
    queries = written(queries.withColumn("query", F.monotonically_increasing_id()), "search-queries")
    n_blocks = -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS)
    terms = queries.select("query", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("query", F.col("x.terms").alias("term"), F.col("x.counts").alias("count"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(document_frequencies(index), "term").select("query", "term", (F.col("count") * idf).alias("weight"), F.pmod(F.xxhash64("query"), F.lit(max(n_blocks, 1))).alias("block"))

    def together(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["query", "term"])
        query, ends = np.unique(part["query"].to_numpy(), return_index=True)
        packed = [query.astype(np.int64), np.append(ends[1:], len(part)).astype(np.int64), part["term"].to_numpy(np.int64), part["weight"].to_numpy(np.float64)]
        return pd.DataFrame([[part["block"].iloc[0], *(x.tobytes() for x in packed)]], columns=["block", "queries", "ends", "terms", "weights"])

    # a block has about QUERY_TERMS terms (more if a single query has)
    blocks = written(weighted.groupBy("block").applyInPandas(together, "block bigint, queries binary, ends binary, terms binary, weights binary"), "search-blocks")
    found = None
    for number in range(n_blocks):
        block = blocks.filter(F.col("block") == number).first()
        if block is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast({c: bytes(block[c]) for c in ("queries", "ends", "terms", "weights")})

        # what all shards find for a part of the block's queries is merged by one task
        parts = max(1, -(-n_shards * (len(block["queries"]) // 8) * k * 24 // PART_BYTES))

        def search(batches: Iterator[pa.RecordBatch], sent=sent, number=number, parts=parts) -> Iterator[pa.RecordBatch]:
            own = sent.value
            query, ends = np.frombuffer(own["queries"], np.int64), np.frombuffer(own["ends"], np.int64)
            term, weight = np.frombuffer(own["terms"], np.int64), np.frombuffer(own["weights"], np.float64)
            least = np.zeros(len(query))  # kept from shard to shard, as are the best so far
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                for n in range(len(batch)):
                    shard = _Shard({c: batch.column(c)[n].as_py() for c in _SHARD}, mean)
                    width, out = max(1, BATCH_CELLS // len(shard.ids)), [best]
                    for a in range(0, len(query), width):
                        b = min(a + width, len(query))
                        span = slice(ends[a - 1] if a else 0, ends[b - 1])
                        of = np.repeat(np.arange(b - a), np.diff(ends[a:b], prepend=span.start))
                        for q, (ids, scores) in zip(query[a:b], shard.best(of, term[span], weight[span], least[a:b], k)):
                            out.append((np.full(len(ids), q), ids, scores))
                    *best, rank = _first(*(np.concatenate(x) for x in zip(*out)), k)
                    last = np.searchsorted(query, best[0][rank == k])
                    least[last] = np.maximum(least[last], best[2][rank == k] - 10.0**-DECIMALS)
            if len(best[0]):
                part = np.searchsorted(query, best[0]) % parts
                packed = [[x[part == k].tobytes() for k in range(parts)] for x in best]
                yield pa.RecordBatch.from_arrays([pa.array([number] * parts, pa.int32()), pa.array(range(parts), pa.int32()), *[pa.array(x, pa.binary()) for x in packed]], ["block", "part", "queries", "ids", "scores"])

        part = written(index.select(*_SHARD).mapInArrow(search, "block int, part int, queries binary, ids binary, scores binary"), "search-found")
        found = part if found is None else found.union(part)
    if found is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("doc_id"), F.lit(0.0).alias("score")).filter(F.lit(False))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        found = (np.concatenate([np.frombuffer(x, kind) for x in part[c]]) for c, kind in (("queries", np.int64), ("ids", np.int64), ("scores", np.float64)))
        query, ids, scores, rank = _first(*found, k)
        return pd.DataFrame({"query": query, "rank": rank, "doc_id": pd.array(ids, "Int64"), "score": scores}).assign(doc_id=lambda x: x["doc_id"].mask(x["doc_id"] == _NO_ID))

    best = found.groupBy("block", "part").applyInPandas(merge, "query bigint, rank int, doc_id bigint, score double")
    return best.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score")
