"""The page ranker against the plain definitions of its gradients, splits and scores."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import ranker as R


def _gradients(labels, scores):
    """Pair by pair."""
    n = len(labels)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    place = {i: k for k, i in enumerate(order)}
    gain = [(0, 1, 3)[x] for x in labels]
    best = sum(x / math.log2(k + 2) for k, x in enumerate(sorted(gain, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i, j in itertools.permutations(range(n), 2):
        if labels[i] > labels[j]:
            worth = abs((gain[i] - gain[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / best
            rho = 1 / (1 + math.exp(scores[i] - scores[j]))
            g[i], g[j] = g[i] - worth * rho, g[j] + worth * rho
            h[i], h[j] = h[i] + worth * rho * (1 - rho), h[j] + worth * rho * (1 - rho)
    return g, h


def test_gradients():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        labels, scores = [rng.choice([0, 0, 1, 2]) for _ in range(n)], [rng.choice([0.0, 0.5, -1.0, rng.random()]) for _ in range(n)]
        g, h = R.gradients(np.array(labels), np.array(scores))
        assert np.allclose(g, _gradients(labels, scores)[0]) and np.allclose(h, _gradients(labels, scores)[1])
        assert abs(g.sum()) < 1e-12 and (h >= 0).all()


def test_splits():
    """Every cut of every feature tried."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        bins, g, h = rng.integers(0, 5, (40, 3)), rng.normal(size=40), rng.random(40)
        sums = np.zeros((1, 3, 5, 3))
        for f in range(3):
            np.add.at(sums[0, f], bins[:, f], np.stack([g, h, np.ones(40)], axis=1))
        tries = []
        for f, cut in itertools.product(range(3), range(5)):
            left = bins[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= 8:
                tries.append((g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1), f, cut))
        gain, f, cut = R.best_splits(sums, 8, 1.0)[0]
        best = max(tries)
        assert math.isclose(gain, best[0]) and any(math.isclose(t[0], gain) and t[1:] == (f, cut) for t in tries)


def _pages(n):
    """The right candidate has a high x or, of equal ones, a low y; z tells nothing."""
    rng, rows = random.Random(7), []
    for page in range(n):
        own = [(rng.randint(0, 3), rng.randint(0, 4), rng.random()) for _ in range(rng.randint(2, 7))]
        best = max(range(len(own)), key=lambda i: (own[i][0], -own[i][1], -i))
        rows += [(page, f"{i}.0", 2 if i == best else int(own[i][0] == own[best][0]), ("train", "train", "val", "test")[page % 4], *map(float, own[i])) for i in range(len(own))]
    return rows


def test_training(spark, tmp_path):
    rows = _pages(240)
    df = spark.createDataFrame(rows, "page_id long, version string, label int, fold string, x double, y double, z double")
    model = R.trained(df.repartition(5), ["x", "y", "z"], rounds=25, depth=3, rate=0.3, least=5, patience=15)
    assert model.trees and len(model.trees) == max(range(len(model.history)), key=lambda k: (model.history[k], -k)) + 1
    # however rows are dealt, the same trees
    again = R.trained(df.orderBy(F.rand(3)).repartition(2), ["x", "y", "z"], rounds=3, depth=3, rate=0.3, least=5)
    assert again.history == model.history[:3] and again.trees == model.trees[: len(again.trees)]
    # the first tree's root by hand
    train = {}
    for p, v, label, fold, *x in rows:
        if fold == "train":
            train.setdefault(p, []).append((v, label, x))
    g, h, xs = [], [], []
    for own in train.values():
        own.sort()
        a, b = _gradients([r[1] for r in own], [0.0] * len(own)) if any(r[1] for r in own) else ([0.0] * len(own),) * 2
        g, h, xs = g + a, h + b, xs + [r[2] for r in own]
    g, h, xs = np.array(g), np.array(h), np.array(xs)
    gain = lambda left: g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    tries = [(gain(xs[:, f] <= e), f, k) for f in range(3) for k, e in enumerate(model.edges[f]) if min((xs[:, f] <= e).sum(), (xs[:, f] > e).sum()) >= 5]
    assert max(tries)[1:] == (model.trees[0].feature[0], model.trees[0].bin[0])
    # scores row by row, hits on pages that were not seen, and the saved model
    found = R.ranked(model, df).collect()
    for r in found:
        want, bins = 0.0, [sum(e < v for e in edges) for v, edges in zip((r.x, r.y, r.z), model.edges, strict=True)]
        for t in model.trees:
            k = 0
            while t.feature[k] >= 0:
                k = 2 * k + 1 + (bins[t.feature[k]] > t.bin[k])
            want += t.value[k]
        assert math.isclose(r.score, want, abs_tol=1e-12)
    best = {}
    for r in sorted(found, key=lambda r: (r.page_id, -r.score, r.version)):
        best.setdefault(r.page_id, r)
    tested = [r for r in best.values() if r.fold == "test"]
    assert sum(r.label == 2 for r in tested) > 0.85 * len(tested)
    model.save(spark, f"{tmp_path}/ranker")
    assert R.Ranker.load(spark, f"{tmp_path}/ranker") == model


def test_odd_rows(spark):
    schema = "page_id long, version string, label int, fold string, x double"
    assert R.trained(spark.createDataFrame([], schema), ["x"]).trees == []
    same = [(p, f"{i}", 0, "train", None) for p in range(30) for i in range(3)]
    model = R.trained(spark.createDataFrame(same, schema), ["x"], rounds=3)
    assert model.trees == [] and {r.score for r in R.ranked(model, spark.createDataFrame(same, schema)).collect()} == {0.0}
    some = [(p, f"{i}", 2 * (i == 0), "train", float(-i) if i < 2 else None) for p in range(30) for i in range(3)]
    model = R.trained(spark.createDataFrame(some, schema), ["x"], rounds=3)
    assert len(model.trees) == 3 and len({r.score for r in R.ranked(model, spark.createDataFrame(some, schema)).collect()}) == 2


def test_kinds_of_pages(spark):
    """Pages alike are one row of their number's weight, and training ends where no round can be better."""
    one = [("1.0", 0, 0.0), ("2.0", 2, 1.0), ("3.0", 0, None)]
    rows = [(p, v, label, ("train", "val", "test")[p % 3], x) for p in range(90) for v, label, x in one]
    df = spark.createDataFrame(rows, "page_id long, version string, label int, fold string, x double")
    kinds = R.by_page(df, R.Ranker(["x"], [[0.0]])).collect()
    assert sorted((r.fold, r.weight) for r in kinds) == [("train", 30), ("val", 30)] and all(list(r.labels) == [0, 2, 0] for r in kinds)
    model = R.trained(df, ["x"], rounds=30)
    assert model.history == [(30, 1.0)] and len(model.trees) == 1
