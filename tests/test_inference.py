"""Batches of a model against one row at a time; the ranked branch of the main query."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import inference


def test_blocks():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(0, 9) for _ in range(6)]
        rows = list(range(sum(sizes)))
        cuts = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        got = list(inference.blocks((pa.RecordBatch.from_arrays([pa.array(rows[a:b], pa.int64())], names=["x"]) for a, b in zip(cuts, cuts[1:], strict=False)), 4))
        assert [x for b in got for x in b.column(0).to_pylist()] == rows and all(b.num_rows == 4 for b in got[:-1])


def test_scored(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(300)] + [None, [], [1.0], [None] * 5, [math.nan] * 5, [math.inf] * 5]
    weights = [0.5, -1.0, 0.25, 2.0, 0.0]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, score string").repartition(3)
    found = inference.scored(df, "five", inference.linear(weights, 0.5), batch=7, width=5)
    assert found.columns == ["vec_id", "embedding", "score"]
    for r in found.collect():
        v = vectors[r.vec_id]
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(v, weights, strict=True)) + 0.5))) if r.vec_id < 300 else None
        assert r.score is None if want is None else math.isclose(r.score, want, rel_tol=1e-12)


def test_loaded_once(spark, tmp_path):
    """A worker loads a model once, whatever the number of its batches and tasks."""
    marks = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{marks}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda x: x[:, 0]

    import os

    df = spark.range(4000).select("id", F.array(F.col("id").cast("double")).alias("embedding")).repartition(8)
    for _ in range(2):
        assert inference.scored(df, f"counted-{marks}", load, batch=10, width=1).where("score = id").count() == 4000
    pids = [x.split("-")[0] for x in os.listdir(marks)]
    assert pids and len(pids) == len(set(pids))


def test_saved_classifier(spark):
    """A logistic regression of Spark's, by its weights, gives the same probabilities."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tidemark.operators.models import embedding_model

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, v.tolist(), int(v[0] + 0.3 * v[1] > 0)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    model, f1 = embedding_model(df, df)
    fit = model.stages[-1]
    own = {r.vec_id: r.p for r in model.transform(df.withColumn("features", array_to_vector("embedding"))).select("vec_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = inference.scored(df, f"fit-{fit.uid}", inference.linear(fit.coefficients.toArray().tolist(), fit.intercept), width=4)
    assert f1 > 0.9 and all(math.isclose(r.score, own[r.vec_id], rel_tol=1e-9, abs_tol=1e-12) for r in got.collect())


def test_ranked_branch(spark):
    """Pages of known versions teach a ranker; the main query then takes what it ranks first."""
    from tidemark.operators import ranker
    from tidemark.plans import extract, fixture, training

    pages = fixture.pages(spark, "/root/testdata/sf0.001")
    rows = training.ranking_rows(pages, F.col("stored"))
    assert {r.fold for r in rows.select("fold").distinct().collect()} == {"train", "val", "test"} and rows.groupBy("page_id").agg(F.count_if(F.col("label") == 2).alias("n")).where("n = 0").count() == 0
    model = ranker.trained(rows, [c for c in training.features.RANK_COLUMNS], rounds=4, least=5, patience=4)
    assert model.trees
    found = {r.page_id: r for r in extract.extract(pages, rank=training.scoring(model)).collect()}
    assert len(found) == pages.count()
    best = {}
    for r in sorted(ranker.ranked(model, rows).collect(), key=lambda r: (r.page_id, -r.score)):
        best.setdefault(r.page_id, r)
    hits = [r.label == 2 for r in best.values()]
    assert sum(hits) > 0.6 * len(hits)
    assert sum(r.source == "model" for r in found.values()) > 50
