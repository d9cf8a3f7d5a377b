"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

Random indexing gives every word a sparse random index vector (a few entries of +1 and -1,
chosen by the word's hash).  A word's context vector sums the index vectors of its neighbours
over the whole corpus.  Words share CONTEXTS hashed places, so the table of context vectors has
one size whatever the corpus; its entries are sums of whole numbers, the same in any order.

A document pools the context vectors of its words.  So that words without a past say something
too, it also pools the index vectors of its words as themselves, by their last characters, by
their shape (classes of the first and last characters, length), and by neighbouring shapes.

A network of two layers (numpy) reads the pooled vector and a few plain measures of the same
words, and gives a logit.  On rows set aside from training, a temperature is fitted that makes
the probabilities match the labels.

Training sees a bounded sample of labelled rows (``sample``, chosen by hash of doc_id) and runs in
one task, which gets that sample's pooled vectors and nothing else; the driver only passes its
weights on.  Every document is scored, whole.  lang, source and doc_id are never inputs.

Defined results
    null or empty text     scored like any text, by the measures of no words
    very long text         pooled a piece of about a megabyte after the other, with the neighbours
                           across borders: the same sums as in one piece, up to rounding.  Pieces
                           end between words, so a longer word makes a longer piece
    labels                 null quality and ids without a document are ignored; an id labelled
                           more than once takes each label
    no usable labels       score 0.5 for every row
    one label only         the score tends to that label
    repeated rows          each is scored; null doc_id is kept, not held out, never trained on
    empty table            no rows
    other columns          ignored
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import text_column
from ._words import hash_spans, hashed_texts, mix, pieces, text_bytes, word_spans

DIMENSIONS = 128  # of each pooled vector
CONTEXTS = 4096  # places of the table of context vectors
CONTEXT_DIMENSIONS = 64
ENTRIES = 4  # non-zero entries of an index vector
SAMPLE = 8_000
HIDDEN = 48
EPOCHS = 40
FOLDS = 5
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20
SLICE_ROWS = 512

# The character classes of a word's shape.
_CLASS = np.full(256, 5, np.uint8)  # bytes of other letters
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 8 + _k


def _index(hashes: np.ndarray, docs: np.ndarray, n: int, salt: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of index vectors by document: n rows of DIMENSIONS."""
    out = np.zeros(n * DIMENSIONS)
    h = mix(hashes ^ np.uint64(salt))
    for _ in range(ENTRIES):
        place = docs * DIMENSIONS + (h & np.uint64(DIMENSIONS - 1)).astype(np.int64)
        sign = ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out += np.bincount(place, sign if weight is None else sign * weight, minlength=n * DIMENSIONS)
        h >>= np.uint64(13)
    return out.reshape(n, DIMENSIONS)


def neighbour_sums(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each place of the table, the sum of the index vectors of its words' neighbours."""
    size = CONTEXTS * CONTEXT_DIMENSIONS
    out = np.zeros(size)
    near = np.flatnonzero(docs[1:] == docs[:-1]) if len(docs) else np.zeros(0, np.int64)
    place = (words & np.uint64(CONTEXTS - 1)).astype(np.int64) * CONTEXT_DIMENSIONS
    h = mix(words ^ np.uint64(0x55))
    for _ in range(ENTRIES):
        entry = (h & np.uint64(CONTEXT_DIMENSIONS - 1)).astype(np.int64)
        sign = ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out += np.bincount(place[near] + entry[near + 1], sign[near + 1], minlength=size)
        out += np.bincount(place[near + 1] + entry[near], sign[near], minlength=size)
        h = mix(h)
    return out


def context_vectors(docs: DataFrame) -> DataFrame:
    """One row, ``table``: unit context vectors over all of ``docs``, CONTEXTS rows at any corpus size."""
    names = [f"d{k}" for k in range(CONTEXT_DIMENSIONS)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS * CONTEXT_DIMENSIONS)
        for batch in batches:
            for _, words, offsets in hashed_texts(batch.column(0)):
                total += neighbour_sums(words, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
        table = total.reshape(CONTEXTS, CONTEXT_DIMENSIONS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CONTEXTS, dtype=np.int32)), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(CONTEXT_DIMENSIONS)]], ["place", *names])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CONTEXTS, CONTEXT_DIMENSIONS))
        for batch in batches:
            table[batch.column(0).to_numpy()] = np.column_stack([batch.column(k + 1).to_numpy() for k in range(CONTEXT_DIMENSIONS)])
        yield pa.RecordBatch.from_arrays([pa.array([_unit(table).astype(np.float32).tobytes()], pa.binary())], ["contexts"])

    parts = docs.select(text_column(docs).alias("text")).mapInArrow(sums, "place int, " + ", ".join(f"{n} bigint" for n in names))
    rows = parts.groupBy("place").agg(*[F.sum(n).alias(n) for n in names])  # at most CONTEXTS rows
    return rows.repartition(1).mapInArrow(together, "contexts binary")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def summed(data: np.ndarray, offsets: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Sums over the texts at ``offsets`` of a byte buffer, one row each; those of a text's pieces add up."""
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    docs = np.searchsorted(offsets, starts, side="right") - 1
    words = hash_spans(data, starts, ends)
    length = ends - starts
    tails = hash_spans(data, np.maximum(starts, ends - 3), ends)
    # shapes: the first byte's class and that of the last bytes, with runs taken together
    kinds = _CLASS[data]
    shape = np.zeros(len(starts), np.uint64)
    if len(starts):
        for back in (1, 2, 3):
            at = np.maximum(ends - back, starts)
            shape = shape * np.uint64(64) + kinds[at].astype(np.uint64) + np.uint64(1)
        shape = shape * np.uint64(64) + kinds[starts].astype(np.uint64)
        shape = shape * np.uint64(8) + np.minimum(length // 3, 7).astype(np.uint64)
    near = np.flatnonzero(docs[1:] == docs[:-1]) if len(docs) else np.zeros(0, np.int64)
    pair = mix(shape[near] * np.uint64(0x9E3779B97F4A7C15) ^ shape[near + 1]) if len(near) else np.zeros(0, np.uint64)
    same = np.bincount(docs[near], (words[near] == words[near + 1]).astype(np.float64), minlength=n)
    sums = [_index(words, docs, n, 0x11), _index(tails, docs, n, 0x22), _index(shape, docs, n, 0x33), _index(pair, docs[near], n, 0x44)]
    places = np.bincount(docs * CONTEXTS + (words & np.uint64(CONTEXTS - 1)).astype(np.int64), minlength=n * CONTEXTS).reshape(n, CONTEXTS)
    sums.append(places.astype(np.float32) @ contexts)
    bytes_where = lambda where: np.bincount(np.searchsorted(offsets, np.flatnonzero(where), side="right") - 1, minlength=n)
    plain = [np.bincount(docs, minlength=n), np.diff(offsets), np.bincount(docs, length.astype(np.float64), minlength=n), same, bytes_where(data == 10), bytes_where(kinds >= 8), *[bytes_where(kinds == k) for k in (0, 1, 2, 5)]]
    return np.column_stack([*sums, *plain]).astype(np.float64)


def long_text_sums(data: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """``summed`` of one text, a piece after the other.

    Pieces end between words.  All sums are over words, bytes or neighbours, so only the pair of
    words on either side of a border is missing, and is added: what both have beyond each alone.
    """
    one = lambda x: summed(x, np.array([0, len(x)]), contexts)
    total, before = 0, None
    for a, b in pieces(data, SLICE_BYTES):
        piece = data[a:b]
        total = total + one(piece)
        starts, ends = word_spans(piece, np.array([0, len(piece)]))
        if len(starts):
            first = piece[starts[0] : ends[0]]
            if before is not None:
                total += one(np.concatenate([before, first])) - one(before) - one(first)
            before = np.append(piece[starts[-1] : ends[-1]], np.uint8(32))
    return total


def features(total: np.ndarray) -> np.ndarray:
    """Features from the sums of whole texts: pooled vectors, their directions, plain measures."""
    *sums, plain = np.split(total, np.cumsum([DIMENSIONS] * 4 + [CONTEXT_DIMENSIONS]), axis=1)
    count, size, letters, same, breaks, marks = plain[:, :6].T
    own, per_byte = np.maximum(count, 1)[:, None], np.maximum(size, 1)
    # the pooled vector's length against the count says how varied the words are
    spread = [np.linalg.norm(x, axis=1, keepdims=True) / own for x in sums]
    measures = np.column_stack([np.log1p(count), np.log1p(size), letters / own[:, 0], same / own[:, 0], breaks / own[:, 0], marks / per_byte, plain[:, 6:] / per_byte[:, None]])
    return np.hstack([*[x / own for x in sums], *[_unit(x) for x in sums], *spread, measures]).astype(np.float32)


def feature_rows(column: pa.Array, contexts: np.ndarray) -> Iterator[np.ndarray]:
    """Features of a text column, in order, about a megabyte of text at a time."""
    data, offs = text_bytes(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        last = min(max(int(np.searchsorted(offs, offs[row] + SLICE_BYTES, side="right")) - 1, row + 1), rows, row + SLICE_ROWS)
        part = data[offs[row] : offs[last]]
        if last == row + 1 and len(part) > SLICE_BYTES:
            total = long_text_sums(part, contexts)
        else:
            total = summed(part, offs[row : last + 1] - offs[row], contexts)
        yield features(total)
        row = last


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Two layers: tanh units, then one logit; trained with Adam, averaged over seeds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seeds: int = 2):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        aside = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
        z = self._scaled(x[~aside])
        self.layers = [self._fit(z, y[~aside], hidden, epochs, seed) for seed in range(seeds)]
        del z
        self.temperature = 1.0
        if aside.any() and len(set(y[aside])) == 2:
            logits = self.logits(x[aside])
            grid = np.exp(np.linspace(np.log(0.3), np.log(6), 60))
            loss = [-np.mean(np.log(np.clip(np.where(y[aside] > 0, p, 1 - p), 1e-9, 1))) for p in (_sigmoid(logits / t) for t in grid)]
            self.temperature = float(grid[int(np.argmin(loss))])

    def weights(self) -> bytes:
        """What scoring needs, as bytes."""
        out = io.BytesIO()
        np.savez(out, self.mean, self.scale, np.array(self.temperature), *[p for layers in self.layers for p in layers])
        return out.getvalue()

    @classmethod
    def of(cls, weights: bytes) -> Network:
        have = list(np.load(io.BytesIO(weights)).values())
        self = cls.__new__(cls)
        self.mean, self.scale, self.temperature = have[0], have[1], float(have[2])
        self.layers = [have[k : k + 4] for k in range(3, len(have), 4)]
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        z /= self.scale
        return np.clip(z, -5, 5, out=z)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int) -> list[np.ndarray]:
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
        p = [q.astype(np.float32) for q in p]
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for epoch in range(epochs):
            rate = 2e-3 * (1 - epoch / epochs) + 1e-5
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                k = order[at : at + 128]
                a = x[k] * (rng.random(x[k].shape) > 0.2)  # dropout on inputs
                h = np.tanh(a @ p[0] + p[1])
                d = (_sigmoid(h @ p[2] + p[3]) - y[k, None]) / len(k)
                dh = (d @ p[2].T) * (1 - h * h)
                step += 1
                for j, g in enumerate((a.T @ dh + 2e-4 * p[0], dh.sum(0), h.T @ d + 2e-4 * p[2], d.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] = p[j] - (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return p

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = self._scaled(x)
        return np.mean([(np.tanh(z @ p[0] + p[1]) @ p[2] + p[3])[:, 0] for p in self.layers], axis=0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature).astype(np.float64)


def held_out_rows(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network | None, np.ndarray]:
    """A network fitted on at most ``sample`` labelled rows that aren't held out, and the context vectors."""
    table = np.frombuffer(bytes(context_vectors(docs).first()["contexts"]), np.float32)  # CONTEXTS rows, a megabyte
    contexts = table.reshape(CONTEXTS, CONTEXT_DIMENSIONS)
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1)")
    marks = marks.filter(~held_out_rows(F.col("id")))
    rows = marks.select("id", "label", F.xxhash64(F.col("id").cast("string")).alias("nth")).orderBy("nth", "id", "label").limit(sample)
    known = docs.select(F.col("doc_id").alias("id"), text_column(docs).alias("text")).join(F.broadcast(rows), "id")  # at most `sample` rows

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(feature_rows(batch.column(0), contexts))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for part in found for x in part], pa.binary()), batch.column(1), batch.column(2)], ["x", "label", "nth"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(0).to_pylist())]
        got.sort()
        y = np.array([label for _, label, _ in got], np.float32)
        if len(got):
            x = np.empty((len(got), len(got[0][2]) // 4), np.float32)
            for k in range(len(got)):
                x[k], got[k] = np.frombuffer(got[k][2], np.float32), None  # rows go as they are copied
            yield pa.RecordBatch.from_arrays([pa.array([Network(x, y).weights()], pa.binary())], ["weights"])

    # the sample's rows meet in one task: `sample` rows of some 5 kB (more only if an id is labelled or held more than once)
    seen = known.select("text", "label", "nth").mapInArrow(featured, "x binary, label int, nth bigint")
    weights = seen.repartition(1).mapInArrow(fit, "weights binary").first()
    return (Network.of(bytes(weights["weights"])) if weights else None), contexts


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    network, contexts = trained(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [network.probabilities(x) if network else np.full(len(x), 0.5) for x in feature_rows(batch.column(1), contexts)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", text_column(docs).alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out_rows(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, all columns unchanged."""
    network, contexts = trained(docs, labels, sample)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [network.probabilities(x) if network else np.full(len(x), 0.5) for x in feature_rows(batch.column("text"), contexts)]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold)) if scores else batch

    return docs.mapInArrow(keep, docs.schema)
