"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a maximal run of bytes from a class. Each word gets a 64-bit hash
from prefix sums of a polynomial in an odd base, which has an inverse modulo
2**64, so that a word's hash doesn't depend on where it stands. Some long words
collide in any such polynomial; ``firm`` hashes words of over ``LONG`` bytes by
a cryptographic function instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20
LONG = 32

#: Everything but white space; and letters, digits and bytes of longer characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        out = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * CHUNK:
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all of them."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j at a time, of about ``size`` bytes, with their bytes and offsets; a row is never divided."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """start, end: byte places of the words; first: n + 1 bounds of each row's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        start, end = inside.copy(), inside.copy()
        if len(data):
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edge = offsets[:-1][offsets[:-1] < len(data)]
            start[edge] = inside[edge]
            edge = offsets[1:][offsets[1:] > 0] - 1
            end[edge] = inside[edge]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self, lower: bool = True) -> np.ndarray:
        self.sums(lower)
        return self.spans(self.start, self.end)

    def sums(self, lower: bool) -> None:
        data = LOWER[self.data] if lower else self.data
        up, self.down = powers(len(data))
        self.upto = np.empty(len(data) + 1, np.uint64)
        self.upto[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.upto[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any spans of bytes, once ``hashes`` was called."""
        return mix((self.upto[end] - self.upto[start]) * self.down[start])

    def firm(self) -> np.ndarray:
        """``hashes``, lower-cased, where long words have the hash of their bytes by BLAKE2."""
        h = self.hashes()
        long = np.flatnonzero(self.end - self.start > LONG)
        if len(long):
            raw = LOWER[self.data].tobytes()
            digest = lambda a, b: hashlib.blake2b(raw[a:b], digest_size=8).digest()
            h[long] = np.frombuffer(b"".join(map(digest, self.start[long].tolist(), self.end[long].tolist())), np.uint64)
        return h

    def pairs(self, gap: int = 1) -> np.ndarray:
        """The places of words that have a word ``gap`` further on in the same row."""
        ok = np.ones(max(0, len(self.start) - gap), bool)
        for back in range(gap):
            last = self.first[1:] - 1 - back
            ok[last[(last >= 0) & (last < len(ok))]] = False
        return np.flatnonzero(ok)
