"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A word is a maximal run of ASCII letters, digits and bytes of multi-byte characters.
Case is folded for ASCII and the Latin-1 letters; other scripts keep their case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
SLICE = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * SLICE:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: numpy's hash table is several times slower on arrays of this size."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a longer text is alone in its part."""
    _, offsets = buffers(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        c = out[at]
        out[at[(c >= 0x80) & (c <= 0x9E) & (c != 0x97)]] += 32
    return out


class Words:
    """Words of a run of texts: hash, first and past-last byte of each; first[i]:first[i+1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        n = len(data)
        w = _WORD[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        folded = lower(data) if fold else data
        total = np.zeros(n + 1, U)
        np.cumsum((folded.astype(U) + U(1)) * _powers(_BASE, n), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _powers(_INV, n + 1)[self.start])

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @classmethod
    def of(cls, column: pa.Array, fold: bool = True) -> "Words":
        return cls(*buffers(column), fold)


def hash_word(word: str) -> int:
    return int(Words.of(pa.array([word])).hash[0])
