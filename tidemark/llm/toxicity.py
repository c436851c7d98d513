"""Toxicity by FTRL-proximal logistic regression over hashed words.

Features of a text, each present or not: words, pairs of neighbours and pairs with one
word between, hashed to 2**BITS places. Each place has a learning rate of its own; L1
keeps most weights at zero, so that the rest can be broadcast.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import batches, crc32_of, lean
from ._text import ALNUM, U, Words, mix, word_runs

BITS = 20
#: At most so many labelled rows are learned from: those with the smallest hashes of their ids.
LEARNED_ROWS = 16_384
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 3.0, 0.0, 4


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of a run of texts, and the text of each."""
    h = words.hash
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    found, owner = [h], [text]
    for gap, seed in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            found.append((h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] * U(0xC2B2AE3D27D4EB4F) + U(seed))[same])
            owner.append(text[gap:][same])
    return (mix(np.concatenate(found)) >> U(64 - BITS)).astype(np.int64), np.concatenate(owner)


class Kept:
    """(places, label) of batches of (doc_id, label, x), any number of times, with one batch in memory.

    They stand in a file without a name in the task's local folder, which goes with it.
    """

    def __init__(self, it: Iterator[pa.RecordBatch]):
        self.file, self.rows, writer = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None), 0, None
        for batch in it:
            writer = writer or pa.ipc.new_stream(self.file, batch.schema)
            writer.write_batch(batch)
            self.rows += batch.num_rows
        if writer:
            writer.close()

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        self.file.seek(0)
        for batch in pa.ipc.open_stream(self.file) if self.rows else ():
            for y, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                yield np.frombuffer(x.as_buffer(), dtype=np.int32), y


def learn(rows: Iterable[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, their weights, and the bias, from (places, 0 or 1) rows, gone through in each epoch."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    for _ in range(EPOCHS):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            b = -bz / ((BETA + bn**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - s * w
            n[x] = nx + g * g
            s = ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA
            bz, bn = bz + g - s * b, bn + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return at, w[at], -bz / ((BETA + bn**0.5) / ALPHA)


def model(docs: DataFrame, labels: DataFrame, rows: int = LEARNED_ROWS) -> list[tuple[int, float]]:
    """(place, weight) of a model of labels.toxic; the bias has place -1; empty without labelled rows.

    Rows with remainder 0 of crc32(doc_id as text) by 5 are held out. A doc_id with
    several labels counts as toxic if one says so; null ids and labels are no labels.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(F.pmod(crc32_of(F.col("doc_id")), F.lit(5)) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, words in word_runs(batch.column(1), ALNUM):
                x, text = features(words)
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(1, j - i))
                found = [np.unique(v).astype(np.int32).tobytes() for v in np.split(x[order], cuts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(2).slice(i, j - i), pa.array(found, pa.binary())], names=["doc_id", "label", "x"])

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(it)
        if kept.rows:
            at, w, b = learn(kept)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([b, *w.tolist()], pa.float64())], names=["at", "w"])

    one = batches(sample, places, "doc_id long, label int, x binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "x")
    return [tuple(r) for r in one.mapInArrow(lean(fit), "at long, w double").collect()]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc (a struct of the row of docs), score: from 0 to 1, higher: likelier toxic.

    Null and empty texts get the bias alone; without labelled rows all scores are 0.
    Each row is judged alone, by its text only; docs may have any further columns.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model(docs, labels))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = np.zeros(1 << BITS), None
        for at, w in weights.value:
            if at < 0:
                bias = w
            else:
                table[at] = w
        for batch in it:
            out = np.zeros(batch.num_rows)
            for i, j, words in word_runs(batch.column(1), ALNUM):
                if bias is None:
                    continue
                x, text = features(words)
                some = table[x] != 0
                pairs = np.unique(text[some] << BITS | x[some])
                sums = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], j - i) if len(pairs) else np.zeros(j - i)
                out[i:j] = 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc", "score"])

    return batches(rows, run, rows.select("doc", F.lit(0.0).alias("score")).schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with their columns."""
    return scored(docs, labels).where("score < 0.5").select("doc.*")
