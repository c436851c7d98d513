"""Scoring by a model that is loaded once for each worker, in batches of fixed size.

A model is anything that turns a matrix of floats (a row for each example) into one
number or several for each row. Workers keep it from task to task, under its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Examples that a model gets at once.
BATCH = 256
_LOADED: dict[str, Callable] = {}

Model = Callable[[np.ndarray], np.ndarray]


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The model of that name, loaded by the first that asks in this process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def blocks(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of exactly size, but for the last."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in it:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - have)
            held.append(part)
            at, have = at + part.num_rows, have + part.num_rows
            if have == size:
                yield _joined(held)
                held, have = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(k) for p in parts]) for k in range(parts[0].num_columns)], names=parts[0].schema.names)


def scored(rows: DataFrame, name: str, load: Callable[[], Model], column: str = "embedding", out: str = "score", batch: int = BATCH, width: int | None = None) -> DataFrame:
    """rows with out, the model's number for the vector in column.

    Vectors that are null, have a null or non-finite component, or not width components (if
    width is given, else not as many as the first good one of their batch) get null.
    load makes the model; it and name go to the workers, the model itself doesn't.
    """
    kept = [c for c in rows.columns if c != out]
    own = rows.select(F.struct(*[rows[c] for c in kept]).alias("row"), F.col(column).cast("array<double>").alias("x"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(name, load)
        for b in blocks(it, batch):
            vectors = [None if v is None or None in v else np.array(v, dtype=np.float64) for v in b.column(1).to_pylist()]
            size = width or next((len(v) for v in vectors if v is not None and np.isfinite(v).all()), 0)
            good = [k for k, v in enumerate(vectors) if v is not None and len(v) == size and np.isfinite(v).all()]
            found: list[float | None] = [None] * len(vectors)
            if good:
                for k, y in zip(good, np.asarray(model(np.stack([vectors[k] for k in good])), dtype=np.float64).tolist(), strict=True):
                    found[k] = y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["row", out])

    schema = own.select("row", F.lit(None).cast("double").alias(out)).schema
    found = own.mapInArrow(run, schema)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], out)


def linear(weights: list[float], bias: float) -> Callable[[], Model]:
    """The load function of a logistic model: probabilities of its positive class."""

    def load() -> Model:
        w = np.array(weights)
        # row by row sums, the same whatever the batch
        return lambda x: 1 / (1 + np.exp(-(np.array([float((r * w).sum()) for r in x]) + bias)))

    return load
