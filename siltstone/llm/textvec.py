"""Vectorised words and shingles of a batch of texts, in numpy.

A batch's texts lie one after the other in one byte buffer. Words are the maximal runs of bytes that a
256-entry table maps to non-zero; a word's hash is a sum of random 64-bit values, one per byte, times the
powers of an odd base, modulo 2^64, then mixed. The table also folds case. Work goes through the buffer in
stretches of about ``STRETCH`` bytes that end between words, so memory stays bounded for long texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
U = np.uint64
_random = np.random.default_rng(20240101)
_BYTES = _random.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = int(_random.integers(1, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)
_STEPS = _random.integers(1, 2**64 - 1, 64, dtype=np.uint64) | U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of the white space that separates words: space and \\x09-\\x0D.
SPACES = bytes([32, *range(9, 14)])
#: Separators for words of letters and digits: every ASCII byte that is neither.
SYMBOLS = bytes(b for b in range(128) if not chr(b).isalnum())


def table(separators: bytes, fold: bool = True) -> np.ndarray:
    """Byte -> its value in a hash, 0 for separators; ``fold`` maps A-Z to a-z."""
    values = _BYTES.copy()
    if fold:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return _powers[size]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (one more than rows); null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(texts) else raw[:0], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int = 0, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of whole rows with at most ``limit`` bytes of text (a longer text stands alone)."""
    _, offsets = buffer_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def over_slices(texts: pa.Array, f: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``f`` of a string column, computed part by part."""
    parts = [f(b.column(0)) for b in slices(pa.RecordBatch.from_arrays([texts], names=["t"]))]
    return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)


@dataclass
class Words:
    start: np.ndarray  # byte offset in the buffer
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word, one more than rows

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(raw: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> Words:
    """Words of every row. A word never crosses rows."""
    inside = values != 0
    starts, ends, hashes = [], [], []
    cuts = offsets[1:-1]
    at, n = 0, len(raw)
    while at < n:
        stop = min(n, at + STRETCH)
        while stop < n:
            gaps = np.flatnonzero(~inside[raw[max(at, stop - 4096) : stop]])
            if len(gaps):
                stop = max(at, stop - 4096) + int(gaps[-1]) + 1
                break
            stop = min(n, stop + 4096)
        part = raw[at:stop]
        v = values[part]
        on = np.zeros(len(part) + 2, bool)
        on[1:-1] = v != 0
        begin = on[1:] & ~on[:-1]
        close = on[:-1] & ~on[1:]
        # rows that touch without a separator: a cut closes one word and begins the next
        own = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, stop, "left")] - at
        if len(own):
            split = own[on[own] & on[own + 1]]
            begin[split] = True
            close[split] = True
        s, e = np.flatnonzero(begin), np.flatnonzero(close)
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        v *= up[: len(part)]
        np.cumsum(v, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, offsets, "left"))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values (as many as there are values, less n - 1)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] * _STEPS[0]
    for k in range(1, n):
        out += hashes[k : k + m] * _STEPS[k]
    return mix(out)


def shingles(w: Words, n: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-word shingles of every row, in order; a row of fewer words is one shingle."""
    count = np.diff(w.first)
    every = combine(w.hash, n)
    made = np.maximum(count - n + 1, 0)
    row = np.repeat(np.arange(len(count)), made)
    place = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(w.first[:-1], made)
    out = every[place]
    if whole_short:
        short = np.flatnonzero((count > 0) & (count < n))
        extra = np.array([int(combine(w.hash[w.first[r] : w.first[r + 1]], int(count[r]))[0]) for r in short], dtype=np.uint64)
        out, row = np.concatenate([out, extra]), np.concatenate([row, short])
    return out, row


def distinct(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (value, row) pairs, sorted by row, then value."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], row[keep]
