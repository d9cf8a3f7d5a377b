"""Vectorised word hashing for batches of texts.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, the same
words that the pattern ``[^\\x20\\x09-\\x0D]+`` finds.  A text column arrives as an Arrow string
array; its value buffer is hashed in place, a slice of about a megabyte at a time, without
making a Python object of any word.

A word's hash mixes its bytes eight at a time; windows of words are hashed from halves over word
hashes.  Equal word sequences have equal hashes wherever they stand, and no step is linear, so
that regular texts can't be made to collide (sums of powers modulo 2**64 would).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LONG_WORD = 64  # bytes; longer words are hashed one by one

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; no word crosses a position in ``bounds``."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = before[-1] = True
    before[1:-1] = space[:-1]
    after = np.empty(len(data), dtype=bool)
    after[:-1], after[-1] = space[1:], True
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before[:-1])
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``: eight bytes at a time are mixed into it."""
    left = ends - starts
    out = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not len(out):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))  # the eight bytes from each place
    out = mix(out ^ (lanes[starts] & _MASK[np.minimum(left, 8)]))
    some = np.flatnonzero(left > 8)
    for k in range(8, LONG_WORD, 8):
        if not len(some):
            break
        out[some] = mix(out[some] ^ (lanes[starts[some] + k] & _MASK[np.minimum(left[some] - k, 8)]))
        some = some[left[some] > k + 8]
    for k in some:  # few words are so long
        out[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]].data, digest_size=8).digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = a * factor
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (len(words) - size + 1 of them).

    Runs of 1, 2, 4, ... words are hashed from the two halves, and a window from the runs that
    make it up.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    factor = mix(np.array([salt], np.uint64))[0] | np.uint64(1)
    step = 1 << 16  # a slice at a time, so that it stays in the processor's cache
    for at in range(0, n, step):
        level = words[at : at + step + size - 1]
        m, span, covered, whole = len(level) - size + 1, 1, 0, None
        while True:
            if size & span:
                piece = level[covered : covered + m]
                whole = piece if whole is None else _joined(whole, piece, factor)
                covered += span
            if 2 * span > size:
                break
            level = _joined(level[:-span], level[span:], factor)
            span *= 2
        out[at : at + m] = mix(whole + np.uint64(salt))
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and offsets of a string array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(data: np.ndarray, size: int, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Borders of pieces of about ``size`` bytes that end between words; at ``most`` bytes, if
    given, even inside one."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + size)
        while stop < len(data) and (most is None or stop - at < most):
            gaps = np.flatnonzero(_SPACE[data[max(at, stop - size) : stop]])
            if len(gaps):
                stop = max(at, stop - size) + int(gaps[-1]) + 1
                break
            stop = min(len(data), stop + size)
        yield at, stop
        at = stop


def hashed_texts(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: (first row, word hashes, offsets of each text's words).

    A slice holds whole texts, at least one; ``lower`` folds A-Z only.
    """
    data, offs = text_bytes(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        last = int(np.searchsorted(offs, offs[row] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, row + 1), rows)
        part, local = data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        hashes, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, stop in pieces(part, 2 * SLICE_BYTES):
            piece = part[at:stop]
            starts, ends = word_spans(piece, local - at)
            hashes.append(hash_spans(_LOWER[piece] if lower else piece, starts, ends))
            firsts.append(starts + at)
        words, where = np.concatenate(hashes), np.concatenate(firsts)
        yield row, words, np.searchsorted(where, local, side="left")
        row = last
