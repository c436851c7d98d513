"""Substring dedup by sliding spans of sentences.

A sentence ends at a line's end or at a word that ends with . ! or ?. It is cut further
where, in any WINDOW words of it, the least hash is: by these words alone, wherever the
sentence begins. A span is a run of pieces, slid from piece to piece: as many as make
MIN_WORDS words (two at least), or fewer if they are SENTENCES whole sentences. Longer
runs that repeat are covered by such ones. Any run of 50 words that two texts share,
begun and ended anywhere, has a whole span in common. Equal spans are found over all
texts by 128-bit hashes; what a span covers is removed, but for the span's first
occurrence, by doc_id, text and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import batches, bounded, lean, table
from ._text import U, Words, _power_tables, bytes_of, mix, runs, split_words, word_runs

SENTENCES, MIN_WORDS, WINDOW = 3, 20, 8
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x2E, 0x21, 0x3F]] = True


def sentence_starts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each piece, whether a sentence begins there, and the n+1 index of each text's first piece."""
    n = len(words.start)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=bool), np.zeros(len(words.first), dtype=np.int64)
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    last = np.ones(n, dtype=bool)  # whether a word ends its sentence
    last[:-1] = _STOP[words.data[words.end[:-1] - 1]] | (lines[words.start[1:]] > lines[words.end[:-1]])
    ends = words.first[1:][np.diff(words.first) > 0] - 1
    last[ends] = True
    whole = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    # windows inside a sentence, each with the last place of its least hash
    stop = np.repeat(np.append(whole[1:], n), np.diff(np.append(whole, n)))
    inside = np.flatnonzero(np.arange(n) + WINDOW <= stop)
    at = inside
    if len(inside):
        least = words.hash[inside]
        for k in range(1, WINDOW):
            h = words.hash[inside + k]
            at = np.where(h <= least, inside + k, at)
            least = np.minimum(h, least)
    begins = np.union1d(whole, at)
    return begins, np.isin(begins, whole, assume_unique=True), np.searchsorted(begins, words.first)


def text_spans(words: Words) -> tuple[np.ndarray, ...]:
    """(text, first piece, last piece, hash, another hash) of every span, pieces by their number in the text."""
    begins, whole, first = sentence_starts(words)
    m = len(begins)
    if not m:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    ends = np.concatenate([begins[1:], [len(words.start)]])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a = np.arange(m)
    b = np.maximum(np.searchsorted(ends, begins + MIN_WORDS), a + 1)
    # from a sentence's begin: up to the piece before the third next one's, if that is nearer
    far = len(words.start) + MIN_WORDS
    heads = np.concatenate([np.flatnonzero(whole), [m], np.full(SENTENCES - 1, far)])
    b[whole] = np.minimum(b[whole], heads[SENTENCES:] - 1)
    on = (b < first[1:][text]) & (b > a)
    # a text's end also closes a span, reckoned backward from there
    tail = first[1:][np.diff(first) > 0] - 1
    back = np.minimum(np.searchsorted(begins, ends[tail] - MIN_WORDS, "right") - 1, tail - 1)
    good = back >= first[:-1][text[tail]]
    a, b = np.concatenate([a[on], back[good]]), np.concatenate([b[on], tail[good]])
    up, down = _power_tables(len(words.hash) + 1)
    found = []
    for h in (words.hash, mix(words.hash ^ U(0x5851F42D4C957F2D))):
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(h * up[: len(h)])])
        found.append(mix((sums[ends[b]] - sums[begins[a]]) * down[begins[a]]))
    text = text[a]
    return text, a - first[text], b - first[text], *found


#: A span's first piece, the number of pieces after it (under MIN_WORDS) and whether it is known as repeated, in one number.
_SIZE_BITS = 8


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): ranges of pieces (a, b; b included) in spans that aren't the first of their kind."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "h1 long, h2 long, doc_id long, text_hash long, place long"
    names = [x.split()[0] for x in schema.split(", ")]

    def first_of(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is the first of a run of equal pairs, and where its first is."""
        head = np.ones(len(h1), dtype=bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return head, np.flatnonzero(head)[np.cumsum(head) - 1]

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for i, _, words in word_runs(batch.column(1), lower=False):
                text, a, b, h1, h2 = text_spans(words)
                place = (a << _SIZE_BITS | b - a) << 1
                found.append((h1.view(np.int64), h2.view(np.int64), batch.column(0).to_numpy()[text + i], batch.column(2).to_numpy()[text + i], place))
            if not found:
                continue
            h1, h2, doc, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((place, row, doc, h2, h1))
            h1, h2, doc, row, place = (x[order] for x in (h1, h2, doc, row, place))
            head, at = first_of(h1, h2)
            # the same place once more: a repeated row
            once = head | (doc != doc[at]) | (row != row[at]) | (place != place[at])
            yield pa.RecordBatch.from_arrays([pa.array(v[once]) for v in (h1, h2, doc, row, place | ~head)], names=names)

    def far(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in it:
            h1, h2, doc, row, place = (c.to_numpy() for c in batch.columns)
            keep = place & 1 == 1
            on = np.flatnonzero(~keep)
            if len(on):
                own = np.stack([h1[on], h2[on], doc[on], row[on], place[on]])
                _, at = first_of(own[0], own[1])
                of = own[2:, at]
                if last is not None:
                    of = np.where((own[0] == last[0]) & (own[1] == last[1]), last[2:, None], of)
                keep[on] = (own[2:] != of).any(axis=0)
                last = np.concatenate([own[:2, -1], of[:, -1]])
            a = place >> _SIZE_BITS + 1
            b = a + (place >> 1 & (1 << _SIZE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "text_hash", "a", "b"]).filter(pa.array(keep))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = batches(rows, near, schema)
    # spans already known as repeated need no key and go anywhere
    dealt = spans.repartition(parts, F.when(F.col("place") % 2 == 1, F.xxhash64("doc_id", "place")).otherwise(F.col("h1"))).sortWithinPartitions(*names)
    found = dealt.mapInArrow(lean(far), "doc_id long, text_hash long, a int, b int")
    whole = F.array_sort(F.collect_list(F.struct("a", "b")))
    return found.distinct().groupBy("doc_id", "text_hash").agg(whole.alias("spans")).select("doc_id", "text_hash", F.aggregate("spans", F.array().cast("array<struct<a:int,b:int>>"), _joined).alias("spans"))


def _joined(done: Column, x: Column) -> Column:
    """done with one more range, joined to the last one if they touch."""
    last = F.try_element_at(done, F.lit(-1))
    longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
    return F.when(last["b"] + 1 >= x["a"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc (a struct of the row of docs), text (what is left), n_sentences, n_removed, removed.

    n_sentences and n_removed count pieces of sentences; removed has the words' ranges of
    removed ones as spans of bytes (start, end) of the old text. Null texts stay null and
    empty ones empty. Rows with a null doc_id neither lose nor give sentences. Rows that
    repeat a doc_id and text count as one document, those that repeat a doc_id with another
    text are documents of their own. Texts of a single piece, and of under MIN_WORDS words and
    SENTENCES sentences, have no span.
    """
    spans = table(repeated(docs))
    spans = bounded(spans.select(F.col("doc_id").alias("key"), "text_hash", "spans"), 64, F.size("spans") * 32)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "text", F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("text_hash"))
    rows = rows.join(spans, ["key", "text_hash"], "left").select("doc", "text", "spans")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = bytes_of(batch.column(1))
            null = batch.column(1).is_null().to_pylist()
            known = batch.column(2)
            texts, counts, gone, removed = [], [], [], []
            for i, j in runs(offsets):
                words = split_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False)
                begins, _, first = sentence_starts(words)
                for t in range(j - i):
                    a, b = offsets[i + t], offsets[i + t + 1]
                    text, n = data[a:b].tobytes(), int(first[t + 1] - first[t])
                    cut = np.zeros(n, dtype=bool)
                    for x in known[i + t].as_py() or ():
                        cut[x["a"] : x["b"] + 1] = True
                    ranges = []
                    if cut.any():
                        starts = np.append(words.start[begins[first[t] : first[t + 1]]] - (a - offsets[i]), b - a)
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))).reshape(-1, 2)
                        ranges = [(int(starts[x]), int(starts[y])) for x, y in edges]
                        parts, done = [], 0
                        for x, y in ranges:
                            parts.append(text[done:x])
                            done = y
                        text = b"".join([*parts, text[done:]])
                    texts.append(None if null[i + t] else text.decode())
                    counts.append(n)
                    gone.append(int(cut.sum()))
                    removed.append([{"start": x, "end": y} for x, y in ranges])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc", "text", "n_sentences", "n_removed", "removed"],
            )

    zero = F.lit(0).cast("long")
    schema = rows.select("doc", "text", zero.alias("n_sentences"), zero.alias("n_removed"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("removed")).schema
    return batches(rows, run, schema)
