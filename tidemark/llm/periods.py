"""Runs of repeated words: all maximal stretches with a period, found by a harmonic grid.

A run of period p and at least 2 * p words holds two neighbours jp and (j + 1)p of the
grid of multiples of p. From each such pair the run's ends are how far the text agrees
with itself forward and backward: longest common extensions, looked up as range minima
over the neighbours' common prefixes in the suffix arrays of the words and of the
reversed words. The grids of all periods together have about n * ln(n) pairs.

Texts are put behind each other, up to ``WORDS`` words at once (one longer text makes a
batch of its own), with separators that equal nothing: one pair of suffix arrays serves
many texts, and memory is bounded by WORDS and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import batches
from ._text import bytes_of, runs, split_words

#: A run has at least so many words and so many times its period.
MIN_WORDS, MIN_POWER = 6, 4
#: Words that share suffix arrays; pairs of the grid that are looked up at once.
WORDS, PAIRS = 1 << 17, 1 << 19


class Extensions:
    """Longest common extensions between places of a sequence of numbers from 0."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        # ranks of all stretches of 1, 2, 4, ... members, until no two are alike
        levels, rank, step = [], ids.astype(np.int32), 1
        while True:
            levels.append(rank)
            key = rank.astype(np.int64) * (n + 1)
            key[: n - step] += rank[step:].astype(np.int64) + 1
            order = np.argsort(key)
            key = key[order]
            new = np.empty(n, dtype=np.int32)
            new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.int32)
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.rank = rank
        # common prefixes of neighbours: the longest stretches that agree, from long to short
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n, dtype=np.int32)
        for k in range(len(levels) - 1, -1, -1):
            own = levels[k]
            inside = np.flatnonzero(b < n) if n > 1 else np.empty(0, dtype=np.int64)
            inside = inside[a[inside] < n]
            same = inside[own[a[inside]] == own[b[inside]]]
            a[same] += 1 << k
            b[same] += 1 << k
            common[same] += 1 << k
        # least[k][r]: the least of 2 ** k of them from r on
        self.least = [common]
        while 2 << len(self.least) - 1 <= n:
            last, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many members agree from a and from b on; a and b are different places."""
        lo, hi = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        out = np.empty(len(a), dtype=np.int32)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            on = np.flatnonzero(level == k)
            out[on] = np.minimum(self.least[k][lo[on]], self.least[k][hi[on] - (1 << k)])
        return out


def _grid(first: np.ndarray, size: np.ndarray, power: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): the pairs (place, place + period) of all texts' grids, at most about PAIRS at once."""
    periods = np.where(size >= least, np.maximum(size // power, 1), 0)
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (size[text] - 1) // period if len(text) else text
    ends = np.cumsum(pairs)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        own = pairs[i:j]
        p = np.repeat(period[i:j], own)
        yield np.repeat(first[text[i:j]], own) + p * (np.arange(len(p)) - np.repeat(np.cumsum(own) - own, own)), p
        i = j


def maximal_runs(ids: np.ndarray, first: np.ndarray, size: np.ndarray, least: int = MIN_WORDS, power: int = MIN_POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period.

    ids: texts behind each other, each with a number before and behind it that equals no other;
    text k has the size[k] places from first[k] on. power is at least 2.
    """
    forward = backward = None
    found = []
    for at, p in _grid(first, size, power, least):
        same = np.flatnonzero(ids[at] == ids[at + p])  # else both extensions are of length 0
        if not len(same):
            continue
        if forward is None:
            forward, backward = Extensions(ids), Extensions(ids[::-1])
        at, p = at[same], p[same]
        end = at + p + forward.of(at, at + p)
        last = len(ids) - 1
        start = at + 1 - backward.of(last - at, last - at - p)
        on = end - start >= np.maximum(least, power * p)
        found.append(np.unique(np.stack([start[on], end[on], p[on]]), axis=1))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    start, end, p = np.unique(np.concatenate(found, axis=1), axis=1)
    # a run is also found by multiples of its smallest period, which comes first
    once = np.ones(len(start), dtype=bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[once], end[once], p[once]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _batch(data: np.ndarray, offsets: np.ndarray, least: int, power: int) -> Iterator[tuple[int, list, str | None]]:
    """(n_words, runs, text without repeats) of each text; the text is None if nothing goes."""
    words = split_words(data, offsets, lower=False)
    length = words.end - words.start
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[words.start] = 1
    inside[words.end] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    cuts = np.concatenate([[0], np.cumsum(length)])
    column = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    code, kinds = column.indices.to_numpy(zero_copy_only=False), len(column.dictionary)
    # separators stand before and behind each text
    texts = len(offsets) - 1
    size = words.counts()
    ids = np.empty(len(code) + texts + 1, dtype=np.int64)
    place = words.first[:-1] + np.arange(1, texts + 1)
    edge = np.concatenate([[0], place + size])
    ids[edge] = kinds + np.arange(texts + 1)
    own = np.ones(len(ids), dtype=bool)
    own[edge] = False
    ids[own] = code
    start, end, period = maximal_runs(ids, place, size, least, power)
    owner = np.searchsorted(place, start, "right") - 1
    by = np.searchsorted(owner, np.arange(texts + 1))
    gone = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1]) == 0
    for t in range(texts):
        a, b = by[t], by[t + 1]
        if a == b:
            yield int(size[t]), [], None
            continue
        found = [{"start": int(x), "length": int(y), "period": int(p)} for x, y, p in zip(start[a:b] - place[t], end[a:b] - start[a:b], period[a:b], strict=True)]
        stay = np.flatnonzero(kept[place[t] : place[t] + size[t]]) + words.first[t]
        yield int(size[t]), found, b" ".join([words.word(i) for i in stay]).decode()


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS, power: int = MIN_POWER) -> DataFrame:
    """doc (a struct of the row of docs), n_words, runs, collapsed.

    runs: start (word number), length and period, in words, of every run, by start, then
    period: at least ``least`` words and ``power`` periods, with the smallest period, and not
    to be extended. collapsed: the words that no run contains after its first period, joined
    by one space; null if there is no run, as nothing goes. Words are told apart exactly.

    Null, empty and blank texts have no words and no runs. Each row is judged alone, so ids
    may be null or repeat; docs may have any further columns. A text is held whole.
    """
    if power < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = bytes_of(batch.column(1))
            # words have over five bytes with the space, on average
            for i, j in runs(offsets, 6 * WORDS):
                n_words, found, collapsed = zip(*_batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least, power), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.string())], names=["doc", "n_words", "runs", "collapsed"])

    schema = rows.select("doc", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:long,length:long,period:long>>").alias("runs"), F.lit(None).cast("string").alias("collapsed")).schema
    return batches(rows, run, schema)


def collapsed(docs: DataFrame, least: int = MIN_WORDS, power: int = MIN_POWER) -> DataFrame:
    """docs with repeats of runs taken out of texts; texts without runs stay as they are."""
    found = repeated_runs(docs, least, power)
    return found.select(*[(F.coalesce("collapsed", "doc.text") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
