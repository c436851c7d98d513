"""A page ranker: boosted trees on LambdaRank gradients, grown on histograms.

Candidates of a page are ranked against each other. For each pair of different labels the
gradient is the share of NDCG that exchanging the two would change, weighed by how wrongly
they stand (Burges, "From RankNet to LambdaRank to LambdaMART", 2010). A tree is grown
level by level: each task bins its pages' rows, works out their gradients under the trees
so far and adds up, for each open node, feature and bin, gradients, curvatures and rows;
Spark adds up the tasks' sums, and the driver, which never sees a row, picks the splits.
What it gets is bounded by nodes x features x bins.

Gradients are rounded to whole multiples of 2 ** -UNIT, so that sums, and with them the
model, are the same however the rows are dealt. Scores of the trees so far are kept in a
table every KEPT trees; newer ones are applied on the way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import written

#: Gains of labels 0, 1 and 2.
GAINS = np.array([0.0, 1.0, 3.0])
UNIT = 24
KEPT = 8


@dataclass
class Tree:
    """Node k has children 2k + 1 and 2k + 2; a row goes left if its feature's bin is at most bin[k]. feature -1: a leaf of this value."""

    feature: list[int]
    bin: list[int]
    value: list[float]

    def of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        node, feature, cut = np.zeros(len(bins), dtype=np.int64), np.array(self.feature), np.array(self.bin)
        while True:
            on = np.flatnonzero(feature[node] >= 0)
            if not len(on):
                return node
            at = node[on]
            node[on] = 2 * at + 1 + (bins[on, feature[at]] > cut[at])


@dataclass
class Ranker:
    """columns: names of features; edges: the upper ends of each one's bins but the last; trees, in order; history: (hits, ndcg) on the validation pages after each tree."""

    columns: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    history: list[tuple[int, float]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers of rows of feature values; missing values are in the first bin."""
        out = np.zeros(x.shape, dtype=np.int16)
        for k, own in enumerate(self.edges):
            out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(np.array(own), x[:, k], "left"))
        return out

    def score(self, bins: np.ndarray, begin: int = 0) -> np.ndarray:
        """The sum of trees from begin on."""
        total = np.zeros(len(bins))
        for t in self.trees[begin:]:
            total += np.array(t.value)[t.of(bins)]
        return total

    def save(self, spark: SparkSession, path: str) -> None:
        """As rows: a header and one for each tree."""
        head = json.dumps({"columns": self.columns, "edges": self.edges, "history": self.history})
        rows = [(-1, head)] + [(k, json.dumps({"feature": t.feature, "bin": t.bin, "value": t.value})) for k, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ranker:
        rows = [json.loads(r["body"]) for r in spark.read.parquet(path).orderBy("tree").collect()]
        return Ranker(rows[0]["columns"], rows[0]["edges"], [Tree(**r) for r in rows[1:]], [tuple(h) for h in rows[0]["history"]])


def discount(n: int) -> np.ndarray:
    return 1 / np.log2(np.arange(n) + 2.0)


def gradients(labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of each candidate of one page, for a loss to be made small.

    Candidates stand by falling score, equal ones as they come. Labels are 0, 1 or 2.
    """
    n = len(labels)
    g, h = np.zeros(n), np.zeros(n)
    gain = GAINS[labels]
    best = float((np.sort(gain)[::-1] * discount(n)).sum())
    if best <= 0:
        return g, h
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(-scores, kind="stable")] = np.arange(n)
    at = discount(n)[place]
    for i in np.flatnonzero(labels > 0):  # few, in any page
        j = np.flatnonzero(labels < labels[i])
        worth = np.abs((gain[i] - gain[j]) * (at[i] - at[j])) / best
        wrong = 1 / (1 + np.exp(np.clip(scores[i] - scores[j], -500, 500)))
        pull, bend = worth * wrong, worth * wrong * (1 - wrong)
        g[i] -= pull.sum()
        g[j] += pull
        h[i] += bend.sum()
        h[j] += bend
    return g, h


def ndcg(labels: np.ndarray, scores: np.ndarray, k: int = 5) -> float:
    """Of the first k; 1 for a page of nothing but zeros."""
    gain, n = GAINS[labels], min(k, len(labels))
    best = float((np.sort(gain)[::-1][:n] * discount(n)).sum())
    got = float((gain[np.argsort(-scores, kind="stable")][:n] * discount(n)).sum())
    return got / best if best > 0 else 1.0


def best_splits(sums: np.ndarray, least: int, reg: float) -> list[tuple[float, int, int]]:
    """(gain, feature, bin) for each node of sums (nodes x features x bins x (g, h, n)); feature -1 where nothing is gained.

    Both sides have at least so many rows. Of equal gains the first feature, then bin.
    """
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + reg)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[..., 2] < least) | (right[..., 2] < least)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    found = flat[np.arange(len(flat)), at]
    return [(float(v), *divmod(int(k), gain.shape[2])) if v > 1e-9 else (0.0, -1, 0) for v, k in zip(found, at, strict=True)]


def edges_of(rows: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """The ends of bins: all values of a column that has few, else quantiles, each once."""
    # one row for each value: a plan of all columns side by side is larger than Spark can compile
    values = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("k", "x")) if columns else None
    found = {r["k"]: r for r in values.groupBy("k").agg(F.percentile_approx("x", [k / bins for k in range(1, bins)], 10_000).alias("ends"), F.approx_count_distinct("x", 0.02).alias("n")).collect()} if columns else {}
    few = [k for k, r in found.items() if r["n"] <= bins * 0.9]
    all_ = {r["k"]: r["all"] for r in values.where(F.col("k").isin(few)).groupBy("k").agg(F.collect_set("x").alias("all")).collect()} if few else {}
    out = []
    for k in range(len(columns)):
        # the largest is no edge
        own = sorted(x for x in all_[k] if x == x)[:-1] if k in all_ else sorted(set(x for x in (found[k]["ends"] if k in found else None) or [] if x == x))
        out.append([float(x) for x in own])
    return out


def by_page(rows: DataFrame, ranker: Ranker) -> DataFrame:
    """A table of fold, labels, bins (a row for each candidate, as bytes), score and weight: a row for each kind of page, candidates by version.

    Pages of the same labels and bins teach the same: they are one row, of the weight of their number.
    Those of the fold test teach nothing and aren't there.
    """
    values = F.array(*[F.col(c).cast("double") for c in ranker.columns])
    pages = rows.where("fold in ('train', 'val')").select("page_id", "fold", F.struct("version", F.col("label").cast("int").alias("label"), values.alias("x")).alias("one")).groupBy("page_id").agg(F.first("fold").alias("fold"), F.array_sort(F.collect_list("one")).alias("own"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            labels, bins = [], []
            for own in batch.column(2).to_pylist():
                x = np.array([[np.nan if v is None else v for v in r["x"]] for r in own], dtype=np.float64)
                labels.append([r["label"] for r in own])
                bins.append(ranker.bins(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(labels, pa.list_(pa.int32())), pa.array(bins, pa.binary())], names=["fold", "labels", "bins"])

    kinds = pages.mapInArrow(run, "fold string, labels array<int>, bins binary").groupBy("fold", "labels", "bins").agg(F.count("*").alias("weight"))
    return written(kinds.select("fold", "labels", "bins", F.transform("labels", lambda _: F.lit(0.0)).alias("score"), "weight"))


def _pages(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(fold, labels, bins, score, weight) of each kind of page; columns fold, labels, bins, score, weight."""
    for batch in it:
        for k in range(batch.num_rows):
            labels = batch.column(1)[k].values.to_numpy().astype(np.int64)
            bins = np.frombuffer(batch.column(2)[k].as_buffer(), dtype=np.int16).reshape(len(labels), width)
            yield batch.column(0)[k].as_py(), labels, bins, batch.column(3)[k].values.to_numpy(), batch.column(4)[k].as_py()


def _histograms(pages: DataFrame, ranker: Ranker, tree: Tree, nodes: list[int], begin: int, size: int) -> np.ndarray:
    """Sums of (gradient, curvature, rows) for the given nodes of a tree that is being grown, features and bins, over the training pages."""
    width, slot = len(ranker.columns), {node: k for k, node in enumerate(nodes)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), width, size, 3), dtype=np.int64)
        lookup = np.full(len(tree.feature), -1)
        lookup[list(slot)] = list(slot.values())
        for _, labels, bins, score, weight in _pages(it, width):
            g, h = gradients(labels, score + ranker.score(bins, begin))
            at = lookup[tree.of(bins)]
            on = np.flatnonzero(at >= 0)
            sums = weight * np.stack([np.rint(g * 2**UNIT), np.rint(h * 2**UNIT), np.ones(len(g))], axis=1).astype(np.int64)[on]
            np.add.at(total, (at[on][:, None], np.arange(width), bins[on]), sums[:, None, :])
        some = np.flatnonzero(total.any(axis=3).reshape(-1))
        flat = total.reshape(-1, 3)[some]
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(flat[:, k]) for k in range(3)]], names=["place", "g", "h", "n"])

    found = pages.where("fold = 'train'").mapInArrow(run, "place long, g long, h long, n long")
    rows = found.groupBy("place").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    out = np.zeros((len(nodes) * width * size, 3))
    if rows.num_rows:
        out[rows["place"].to_numpy()] = np.stack([rows["g"].to_numpy() / 2**UNIT, rows["h"].to_numpy() / 2**UNIT, rows["n"].to_numpy()], axis=1)
    return out.reshape(len(nodes), width, size, 3)


def _grown(pages: DataFrame, ranker: Ranker, begin: int, size: int, depth: int, rate: float, least: int, reg: float) -> Tree:
    """The next tree, one pass over the pages for each level."""
    room = 2 ** (depth + 1) - 1
    tree, open_ = Tree([-1] * room, [0] * room, [0.0] * room), [0]
    value = lambda own: float(-rate * own[0] / (own[1] + reg))
    for _ in range(depth):
        sums, after = _histograms(pages, ranker, tree, open_, begin, size), []
        for node, (_, f, cut), own in zip(open_, best_splits(sums, least, reg), sums, strict=True):
            if f < 0:
                continue
            tree.feature[node], tree.bin[node] = f, cut
            # what the children hold is known already
            left = own[f, : cut + 1].sum(axis=0)
            tree.value[2 * node + 1], tree.value[2 * node + 2] = value(left), value(own[f].sum(axis=0) - left)
            after += [2 * node + 1, 2 * node + 2]
        open_ = after
        if not open_:
            break
    return tree


def _measured(pages: DataFrame, ranker: Ranker, begin: int) -> tuple[tuple[int, float], bool]:
    """((hits, mean NDCG of the first five), whether neither can be higher) on the validation pages; a hit has a best candidate of label 2."""
    width = len(ranker.columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits, total = 0, 0, 0
        for _, labels, bins, score, weight in _pages(it, width):
            s = score + ranker.score(bins, begin)
            n, hits, total = n + weight, hits + weight * int(labels[np.argmax(s)] == 2), total + weight * round(ndcg(labels, s) * 2**UNIT)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([hits]), pa.array([total])], names=["n", "hits", "total"])

    r = pages.where("fold = 'val'").mapInArrow(run, "n long, hits long, total long").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("total").alias("total")).first()
    if not r["n"]:
        return (0, 0.0), False
    return (int(r["hits"]), r["total"] / 2**UNIT / r["n"]), r["hits"] == r["n"] and r["total"] == r["n"] * 2**UNIT


def _advanced(pages: DataFrame, ranker: Ranker, begin: int) -> DataFrame:
    """The table of pages with scores of all trees so far."""
    width = len(ranker.columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            score = [(s + ranker.score(bins, begin)).tolist() for _, _, bins, s, _ in _pages([batch], width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.list_(pa.float64())), batch.column(4)], names=batch.schema.names)

    return written(pages.mapInArrow(run, pages.schema))


def trained(rows: DataFrame, columns: list[str], rounds: int = 500, depth: int = 5, rate: float = 0.1, least: int = 20, reg: float = 1.0, bins: int = 64, patience: int = 20) -> Ranker:
    """A ranker from rows of page_id, version, label (0, 1, 2), fold (train, val, other) and columns.

    It has the trees up to the best round by hits on the validation pages, then by NDCG;
    training ends when that was patience rounds ago, when no later round could be better (all
    pages hit, at an NDCG of 1), or when a tree finds no split. Without
    validation pages all rounds are made. Missing values are smallest. A page's candidates are
    held together; pages of one label teach nothing. No training rows give no trees.
    """
    ranker = Ranker(list(columns), edges_of(rows.where("fold = 'train'"), list(columns), bins))
    size = max([len(e) for e in ranker.edges], default=0) + 1
    pages, begin = by_page(rows, ranker), 0
    best, validated = 0, pages.where("fold = 'val'").limit(1).count() > 0
    for _ in range(rounds):
        tree = _grown(pages, ranker, begin, size, depth, rate, least, reg)
        if tree.feature[0] < 0:
            break
        ranker.trees.append(tree)
        if validated:
            now, perfect = _measured(pages, ranker, begin)
            ranker.history.append(now)
            best = best if ranker.history[-1] <= (ranker.history[best - 1] if best else (-1, -1.0)) else len(ranker.trees)
            if perfect or len(ranker.trees) - best >= patience:
                break
        if len(ranker.trees) - begin >= KEPT:
            pages, begin = _advanced(pages, ranker, begin), len(ranker.trees)
    if validated:
        ranker.trees = ranker.trees[:best]
    return ranker


def ranked(ranker: Ranker, rows: DataFrame) -> DataFrame:
    """rows with score, the sum of the trees; rows need the ranker's columns."""
    values = F.array(*[F.col(c).cast("double") for c in ranker.columns])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(ranker.columns))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.score(ranker.bins(x)))], names=["row", "score"])

    kept = [c for c in rows.columns if c != "score"]
    own = rows.select(F.struct(*[rows[c] for c in kept]).alias("row"), values.alias("x"))
    found = own.mapInArrow(run, own.select("row", F.lit(0.0).alias("score")).schema)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "score")
