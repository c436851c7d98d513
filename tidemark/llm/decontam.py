"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are runs of 13 words of a benchmark item (all words of a shorter item).
Those of one length share a matcher: a shift table by blocks of two words tells how
far the search may jump; where it may not, the block's bucket gives the test strings
that end so, those whose first block agrees are compared with the text word by word.
Many places of many texts are searched at once, each with a cursor of its own.

Matchers are arrays, made once on the driver and broadcast; a benchmark of more than
BENCHMARK_BYTES is searched in parts, each with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import batches
from ._text import ALNUM, U, Words, bytes_of, mix, split_words, word_runs

WINDOW = 13
#: Bytes of benchmark texts in one matcher, whose arrays take some 12 times as much; more are searched in parts, one after another.
BENCHMARK_BYTES = 8 << 20
#: Places that one cursor walks over.
SEGMENT = 256
TABLE_BITS = 18


class Matcher:
    """Test strings of one length: the words from places[k] on of the benchmark's words, in items[cuts[k]:cuts[k + 1]]."""

    def __init__(self, words: Words, places: np.ndarray, size: int, items: np.ndarray, cuts: np.ndarray):
        self.words, self.places, self.size, self.items, self.cuts = words, places, size, items, cuts
        self.block = min(2, size)
        self.shift = np.full(1 << TABLE_BITS, size - self.block + 1, dtype=np.int64)
        for end in range(self.block - 1, size):
            np.minimum.at(self.shift, self._slot(self._block(end)), size - 1 - end)
        suffix = self._block(size - 1)
        order = np.argsort(suffix, kind="stable")
        self.order, self.suffix, self.prefix = order, suffix[order], self._block(self.block - 1)[order]

    def _block(self, end: int) -> np.ndarray:
        """Hash of each test string's block that ends at its word end."""
        h = self.words.hash[self.places + end]
        return mix(h if self.block == 1 else h + self.words.hash[self.places + end - 1] * U(0x9E3779B97F4A7C15))

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> U(64 - TABLE_BITS)).astype(np.int64)

    def find(self, words: Words) -> Iterator[tuple[int, int]]:
        """(place of the first word, string) of every occurrence in a run of texts."""
        low, high = words.first[:-1] + self.size - 1, words.first[1:]
        per = np.maximum(-(-(high - low) // SEGMENT), 0)
        text = np.repeat(np.arange(len(per)), per)
        if not len(text):
            return
        start = low[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))
        stop = np.minimum(start + SEGMENT, high[text])
        h, at, seen, blocks = words.hash, start, [], []
        while len(at):
            block = mix(h[at] if self.block == 1 else h[at] + h[at - 1] * U(0x9E3779B97F4A7C15))
            step = self.shift[self._slot(block)]
            stay = step == 0
            seen.append(at[stay])
            blocks.append(block[stay])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at, block = np.concatenate(seen), np.concatenate(blocks)
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        some = hi > lo
        at, lo, n = at[some] - self.size + 1, lo[some], (hi - lo)[some]
        head = mix(h[at] if self.block == 1 else h[at + 1] + h[at] * U(0x9E3779B97F4A7C15))
        for k in range(int(n.max(initial=0))):  # the k-th test string of each bucket
            on = n > k
            at, lo, n, head = at[on], lo[on], n[on], head[on]
            for i in np.flatnonzero(self.prefix[lo + k] == head):
                string = int(self.order[lo[i] + k])
                if all(words.word(at[i] + j).lower() == self.words.word(self.places[string] + j).lower() for j in range(self.size)):
                    yield int(at[i]), string


def matchers(ids: list, texts: list, window: int = WINDOW) -> list[Matcher]:
    """A matcher for each length of test strings of items, a few at most have fewer words than a window.

    ids[k], by which items are listed, may be None: such an item isn't.
    """
    words = split_words(*bytes_of(pa.array(texts, pa.string())), ALNUM)
    counts, found = words.counts(), []
    for size in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        own = np.flatnonzero(np.minimum(counts, window) == size)
        per = counts[own] - size + 1
        item = np.repeat(own, per)
        place = words.first[:-1][item] + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        # equal strings are one: by two hashes of all their words
        one, two = np.zeros(len(place), dtype=U), np.zeros(len(place), dtype=U)
        for k in range(size):
            h = words.hash[place + k]
            one, two = mix(one * U(31) + h), mix((two ^ h) * U(0x9E3779B97F4A7C15) + U(k))
        order = np.lexsort((item, two, one))
        one, two, item, place = one[order], two[order], item[order], place[order]
        head = np.ones(len(place), dtype=bool)
        head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        of = np.cumsum(head) - 1
        named = np.array([ids[i] is not None for i in item], dtype=bool) & np.concatenate([[True], (of[1:] != of[:-1]) | (item[1:] != item[:-1])])
        cuts = np.searchsorted(of[named], np.arange(of[-1] + 2))
        found.append(Matcher(words, place[head], size, item[named], cuts))
    return found


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc (a struct of the row of docs), n_words, hits, items.

    hits: the places of words (from, to; to excluded) inside an occurrence of a test
    string, in order and apart; items: ids, as strings, of benchmark items of which one
    occurs. A null, empty or wordless text has no words, hits and items; such an item
    has no test string. An item without id hits words, but isn't listed. Rows of docs,
    repeated ones too, are each judged alone; docs may have any further columns.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").alias("item"), "text").where("text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BENCHMARK_BYTES))
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<from:int,to:int>>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    schema = out.schema
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        items = part.collect()
        ids = [r["item"] for r in items]
        shared = spark.sparkContext.broadcast((ids, matchers(ids, [r["text"] for r in items], window)))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, found = shared.value  # kept by Spark for a worker's later tasks
            for batch in it:
                before_hits, before_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                n_words, hits, items = [], [], []
                for i, j, words in word_runs(batch.column(1), ALNUM):
                    covered = np.zeros(len(words.hash) + 1, dtype=np.int32)
                    ids: dict[int, set] = {}
                    for m in found:
                        for at, string in m.find(words):
                            covered[at] += 1
                            covered[at + m.size] -= 1
                            ids.setdefault(int(np.searchsorted(words.first, at, "right")) - 1, set()).update(str(names[x]) for x in m.items[m.cuts[string] : m.cuts[string + 1]])
                    inside = np.cumsum(covered) > 0
                    for t in range(j - i):
                        a, b = int(words.first[t]), int(words.first[t + 1])
                        old = before_hits[i + t]
                        n_words.append(b - a)
                        if t not in ids and not old:
                            hits.append([])
                            items.append([])
                            continue
                        mine = inside[a:b].copy()
                        for x in old or ():
                            mine[x["from"] : x["to"]] = True
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                        hits.append([{"from": int(x), "to": int(y)} for x, y in edges.reshape(-1, 2)])
                        items.append(sorted(ids.get(t, set()) | set(before_items[i + t] or ())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(items, pa.list_(pa.string()))], names=["doc", "text", "n_words", "hits", "items"])

        out = batches(out, run, schema)
    return out.select("doc", "n_words", "hits", "items")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """occurrences() with n_hit (words hit) and contaminated: hit, and at least one word of share."""
    found = occurrences(docs, benchmark, window)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    return judged(docs, benchmark).where("not contaminated").select("doc.*")
