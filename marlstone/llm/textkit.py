"""Array helpers that run inside Spark tasks: words, rolling hashes and window minima.

A "word" is a maximal run of bytes other than 0x20 and 0x09-0x0D; every helper
works on the UTF-8 bytes of a slice of rows, never across rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow: dict[str, np.ndarray] = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["b"]) < n:
        for key, base in (("b", _BASE), ("i", _INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["b"][:n], _pow["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Spans:
    """Hashes of arbitrary ranges of one sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = values
        self.inv = _powers(n + 1)[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(max(n, 1))[0][:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """One hash for each range; with `first` as if each range began with that value."""
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        if first is not None:
            h += first - self.values[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, k: int) -> np.ndarray:
        """Hashes of all stretches of k values, as hash() gives them, read in order."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.inv[: len(h)]
        h += np.uint64(k * 0xD6E8FEB86659FD93 & _MASK)
        return mix(h)

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n values from a on and those from b on have one hash; n is one number, so that nothing need be spread."""
        return (self.sums[a + n] - self.sums[a]) * self.inv[a] == (self.sums[b + n] - self.sums[b]) * self.inv[b]


class Slice:
    """Some rows' texts as one byte array; off[i]:off[i+1] are row i's bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.rows = data, off, first, len(off) - 1

    def words(self, fold: bool = False) -> None:
        """Sets start, end, row, word_off and h: one entry for each word, in text order."""
        d, n = self.data, len(self.data)
        w = np.zeros(n + 2, bool)
        w[1:-1] = IS_WORD[d]
        begin = w[1:-1] & ~w[:-2]
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = w[1:-1][inner]
        end = w[1:-1] & ~w[2:]
        end[inner - 1] = w[1:-1][inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.word_off = np.searchsorted(self.start, self.off)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.word_off))
        self.h = Spans(_BYTE[LOWER[d] if fold else d]).hash(self.start, self.end)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After words(): each word's number, and the distinct words as offsets into their bytes, one after another."""
        ends = np.append(0, np.cumsum(self.end - self.start)).astype(np.int64)
        packed = np.ascontiguousarray(self.data[IS_WORD[self.data]])
        coded = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
        own = coded.dictionary
        off = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1) if len(own) else np.zeros(1, np.int64)
        data = np.frombuffer(own.buffers()[2], np.uint8) if len(own) else np.zeros(0, np.uint8)
        return np.asarray(coded.indices).astype(np.int64), off, data

    def bytes_hash(self) -> Spans:
        return Spans(_BYTE[self.data])

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[Slice]:
    """Cuts a string column into slices of about `most` bytes, whole rows each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_binary())
    n = len(a)
    if not n:
        return
    lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(a), 0), dtype=np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64, n + 1, a.offset * 8)
    raw = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        own = lens[i:j]
        cuts = np.zeros(j - i + 1, np.int64)
        np.cumsum(own, out=cuts[1:])
        data = raw[off[i] : off[j]] if cuts[-1] == off[j] - off[i] else np.concatenate([raw[off[k] : off[k] + lens[k]] for k in range(i, j)] or [raw[:0]])
        yield Slice(data, cuts, i)
        i = j


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """For each i the index of the least of h[i:i+w], the leftmost of equal ones."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(n)
    m = -(-len(h) // w) * w
    pad = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(h)] = h
    block = pad.reshape(-1, w)
    # leftmost minimum from each position to its block's end, and from the block's start
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(block, axis=1).ravel()
    new = np.append(True, left[1:] != left[:-1])
    new[::w] = True
    first = np.flatnonzero(new)  # where the running minimum was first reached
    at_left = np.repeat(first, np.diff(first, append=m))
    hit = np.flatnonzero(pad == right)  # a block's last position is always one
    at_right = np.repeat(hit, np.diff(hit, prepend=-1))
    b = slice(w - 1, n + w - 1)
    return np.where(right[:n] <= left[b], at_right[:n], at_left[b])


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of first[i], first[i]+1, ... (count[i] of them)."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(first, count)
