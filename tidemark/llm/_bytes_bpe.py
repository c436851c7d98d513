"""Ids of many texts by a byte-level BPE tokenizer, each distinct piece of text encoded once.

The tokenizer's own splitting (contractions, letters, digits, other signs, white space)
is done on whole batches with numpy; the pieces it gives are encoded by the tokenizer
itself the first time they come up and looked up after that. Texts that hold one of the
tokenizer's added tokens go to it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import regex

from ._text import _BYTE, U, _power_tables, bytes_of, mix, runs

_LETTER, _NUMBER, _SPACE = 1, 2, 3
_classes: list[np.ndarray] = []
#: Contractions that are pieces of their own (fixed values of the byte-level scheme).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _class_table() -> np.ndarray:
    """Class of every code point."""
    if not _classes:
        points = np.delete(np.arange(0x110000, dtype=np.uint32), np.s_[0xD800:0xE000])
        every = points.astype("<u4").tobytes().decode("utf-32-le")
        table = np.zeros(0x110000, dtype=np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
            for m in regex.finditer(f"{pattern}+", every):
                table[points[m.start() : m.end()]] = kind
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where pieces begin in code points of texts that begin at first[:-1]."""
    n = len(points)
    kind = _class_table()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[first] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # white space before something else gives its last character to it, if that is a blank, or else to a piece of its own
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) + 1
    start[after - 1] = True
    joined = after[points[after - 1] == 0x20]
    start[joined] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER) & ~edge[1:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
        for suffix in CONTRACTIONS:
            on = np.ones(len(quote), dtype=bool)
            for k, c in enumerate(suffix):
                on &= (padded[quote + 1 + k] == ord(c)) & ~edge[np.minimum(quote + 1 + k, n)]
            at = quote[on]
            start[at + 1] = False
            stop = at + 1 + len(suffix)
            start[stop[stop < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes string columns with the tokenizer in a file."""

    #: Distinct pieces held at most; more, and the store begins anew.
    HELD = 400_000
    #: Bytes of texts split at once (tables of powers double beyond a power of two), pieces encoded at once:
    #: both only bound memory.
    RUN, PIECES = (1 << 18) - 2, 2_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        # hashes in order, and the place in the store of each
        self.known, self.slot = np.empty(0, dtype=U), np.empty(0, dtype=np.int32)
        self.at, self.ids = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _slots(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in the store of each piece of data."""
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[begin]) * down[begin])
        distinct, one, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.HELD:
            self._clear()
        place = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == distinct[inside]
        found = np.empty(len(distinct), dtype=np.int64)
        found[old] = self.slot[place[old]]
        new = np.flatnonzero(~old)
        if len(new):
            raw = data.tobytes()
            sizes, ids = [], []
            for k in range(0, len(new), self.PIECES):
                some = one[new[k : k + self.PIECES]]
                texts = [raw[a:b].decode() for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
                encoded = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in encoded], dtype=np.int64))
                ids.append(np.array([i for x in encoded for i in x], dtype=np.uint32))
            found[new] = len(self.known) + np.arange(len(new))
            self.slot = np.insert(self.slot, place[new], found[new])
            self.known = np.insert(self.known, place[new], distinct[new])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
            self.ids = np.concatenate([self.ids, *ids])
        return found[of]

    def encode(self, column) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; null is empty."""
        data, offsets = bytes_of(column)
        for i, j in runs(offsets, self.RUN):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                yield from (np.empty(0, dtype=np.uint32) for _ in range(i, j))
                continue
            raw = part.tobytes()
            head = np.flatnonzero((part & 0xC0) != 0x80)
            points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
            pieces = piece_starts(points, np.searchsorted(head, own))
            begin = head[pieces]
            slots = self._slots(part, begin, np.append(begin[1:], len(part)))
            sizes = (self.at[1:] - self.at[:-1])[slots]
            ends = np.cumsum(sizes)
            ids = self.ids[np.arange(ends[-1]) + np.repeat(self.at[slots] - (ends - sizes), sizes)]
            bounds = np.concatenate([[0], ends])[np.searchsorted(begin, own)]
            special = any(x in raw for x in self.added)
            for k in range(j - i):
                text = raw[own[k] : own[k + 1]] if special else b""
                yield self._whole(text.decode()) if special and any(x in text for x in self.added) else ids[bounds[k] : bounds[k + 1]]
