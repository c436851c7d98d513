"""Vectorised text kernels on Arrow string buffers, shared by the operators.

Texts are handled as UTF-8 bytes in runs of at most ``CHUNK`` bytes (one longer
text makes a run of its own), so memory is bounded by that and the longest text.
A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def splitmix(seed: int, n: int) -> np.ndarray:
    """n uint64 values from a seed, the same everywhere."""
    out = []
    x = seed & _MASK
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_BYTE = splitmix(7, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]

#: Words are runs of anything but the six ASCII white-space characters.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words are runs of digits, letters and anything outside ASCII; use with lower=True.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n, by doubling."""
    if len(_powers[0]) <= n:
        for k, base in ((0, _P), (1, _P_INV)):
            t = np.ones(1, dtype=U)
            while len(t) <= n:
                t = np.concatenate([t, t * U(pow(base, len(t), 1 << 64))])
            _powers[k] = t
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of texts: first is the index of each text's first word (one
    more entry than texts); start and end are byte places in data; hash is 64-bit."""

    data: np.ndarray
    base: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of the texts between offsets, with hashes of their (lower-cased A-Z) bytes."""
    n = len(data)
    texts = len(offsets) - 1
    if not n:
        none = np.empty(0, dtype=np.int64)
        return Words(data, offsets, np.zeros(texts + 1, dtype=np.int64), none, none, none.astype(U))
    inside = table[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, dtype=U)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=sums[1:])
    return Words(data, offsets, np.searchsorted(start, offsets), start, end, mix((sums[end] - sums[start]) * down[start]))


def word_runs(column: pa.Array, table: np.ndarray = SPACED, lower: bool = True, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(row from, row to, Words) over a string column."""
    data, offsets = bytes_of(column)
    for i, j in runs(offsets, limit):
        yield i, j, split_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, lower)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words inside a text, and the n+1 index of each text's first.

    A text of fewer words, but not none, has one: all its words.
    """
    h, first, counts = words.hash, words.first, words.counts()
    total = np.zeros(len(h), dtype=U)
    factors = splitmix(size * 1009 + 5, size)
    lengths = splitmix(size * 31 + 11, size + 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(h) >= size:
        m = len(h) - size + 1
        for k in range(size):
            total[:m] += h[k : k + m] * (factors[k] | U(1))
    per = np.maximum(counts - size + 1, 0)
    keep = np.ones(len(h), dtype=bool)
    # the last size-1 words of a text begin no window of it
    for k in range(1, size):
        at = first[1:] - k
        keep[at[at >= first[:-1]]] = False
    for i in short:
        a, b = first[i], first[i + 1]
        total[a] = np.append(h[a:b] * (factors[: b - a] | U(1)), lengths[b - a]).sum(dtype=U)
        keep[a] = True
        per[i] = 1
    return mix(total[keep]), np.concatenate([[0], np.cumsum(per)]).astype(np.int64)


def per_text(values: np.ndarray, first: np.ndarray, reduce: np.ufunc, empty) -> np.ndarray:
    """reduce over each text's values; empty where a text has none."""
    out = np.full(len(first) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = reduce.reduceat(values, first[:-1][some])
    return out


def crc_of_ids(column: pa.Array) -> list[int | None]:
    """crc32 of each id as decimal text."""
    import zlib

    return [None if x is None else zlib.crc32(str(x).encode()) for x in column.to_pylist()]
