"""One interface to all learners: fit on a table, score any table, score a matrix.

A fitted learner holds a few arrays bounded by its parameters (neighbours: the folder of their
index), so a task scores its rows without a model service, and importance and grids treat all
learners alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import log, pi

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators import bayes, boosting, kernel_machine, learners, neighbour_index
from chronotext.operators.boosting import scored, vector


@dataclass
class NaiveBayes:
    """Classes x features: means and variances; and the classes' log shares."""

    features: list[str]
    mean: np.ndarray
    var: np.ndarray
    log_prior: np.ndarray

    @staticmethod
    def fit(train: DataFrame, features: list[str], y: str = "y") -> NaiveBayes:
        rows = bayes.gnb_fit(bayes.feature_moments(train, features, y)).collect()  # classes times features
        classes = max((r["y"] for r in rows), default=-1) + 1
        mean, var = np.zeros((classes, len(features))), np.ones((classes, len(features)))
        prior = np.full(classes, -np.inf)
        for r in rows:
            mean[r["y"], r["pos"]], var[r["y"], r["pos"]], prior[r["y"]] = r["mean"], r["var"], log(r["prior"])
        return NaiveBayes(features, mean, var, prior)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        constant = self.log_prior - 0.5 * np.log(2 * pi * self.var).sum(axis=1)
        joint = constant - 0.5 * (((x[:, None, :] - self.mean) ** 2) / self.var).sum(axis=2)
        return boosting.softmax(joint)


@dataclass
class Forest:
    """A fitted Spark forest as arrays: trees x nodes, the leaves' class shares beside them."""

    features: list[str]
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray  # trees x nodes x classes

    @staticmethod
    def of(model: RandomForestClassificationModel, features: list[str]) -> Forest:
        trees = [_nodes(t._java_obj.rootNode(), model.numClasses) for t in model.trees]  # trees times nodes, by parameter
        most = max(len(t) for t in trees)
        shape = (len(trees), most)
        feature, cut = np.full(shape, -1), np.zeros(shape)
        left, right = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        shares = np.zeros((*shape, model.numClasses))
        for t, nodes in enumerate(trees):
            for i, (f, c, lo, hi, stats) in enumerate(nodes):
                feature[t, i], cut[t, i], left[t, i], right[t, i], shares[t, i] = f, c, lo, hi, stats
        total = shares.sum(axis=2, keepdims=True)
        return Forest(features, feature, cut, left, right, shares / np.where(total > 0, total, 1.0))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out, row = np.zeros((len(x), self.shares.shape[2])), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[row, np.maximum(f, 0)] <= self.cut[t, node]
                node = np.where(inner, np.where(low, self.left[t, node], self.right[t, node]), node)
            out += self.shares[t, node]
        return out / out.sum(axis=1, keepdims=True)


def _nodes(root, classes: int) -> list[tuple]:
    """(feature or -1, cut, left, right, class weights) of a tree's nodes, the root first."""
    out, waiting = [], [(root, None, None)]
    while waiting:
        node, parent, side = waiting.pop()
        at = len(out)
        if parent is not None:
            out[parent][side] = at
        stats = list(node.impurityStats().stats())
        if node.subtreeDepth() == 0:
            out.append([-1, 0.0, 0, 0, stats])
        else:
            split = node.split()
            out.append([split.featureIndex(), split.threshold(), 0, 0, stats])
            waiting += [(node.leftChild(), at, 2), (node.rightChild(), at, 3)]
    return [tuple(n) for n in out]


@dataclass
class Neighbours:
    """A stored index of the training rows and their classes."""

    features: list[str]
    index: neighbour_index.CellIndex
    labels: str  # folder of (id, y)
    classes: int
    k: int
    probabilities = None

    @staticmethod
    def fit(train: DataFrame, features: list[str], k: int = 5, id_col: str = "file_name") -> Neighbours:
        points = _numbered(train, id_col).select("id", vector(features).alias("vec"))
        return Neighbours(features, neighbour_index.CellIndex.fit(points, k), "", 0, k).with_labels(train, id_col)

    def with_labels(self, train: DataFrame, id_col: str = "file_name") -> Neighbours:
        """The same index of the same rows with the classes that their `y` has now."""
        from chronotext.session import staging_path

        path = staging_path(train.sparkSession, "neighbour_labels")
        _numbered(train, id_col).select("id", F.col("y").cast("int").alias("y")).write.parquet(path)
        classes = train.agg(F.max("y")).first()[0] or 0
        return replace(self, labels=path, classes=int(classes) + 1)

    def nearest(self, rows: DataFrame, id_col: str = "file_name") -> DataFrame:
        """(qid, rank, id, dist), whatever the classes are."""
        asked = _numbered(rows, id_col).select(F.col("id").alias("qid"), vector(self.features).alias("vec"))
        return self.index.search(asked, self.k)

    def score(self, rows: DataFrame, keep: list[str], id_col: str = "file_name", found: DataFrame | None = None) -> DataFrame:
        """`found` are the rows' neighbours, where they are known."""
        found = self.nearest(rows, id_col) if found is None else found
        voted = neighbour_index.vote(found, rows.sparkSession.read.parquet(self.labels), self.classes)
        return _numbered(rows, id_col).select(F.col("id").alias("qid"), *keep).join(voted, "qid").select(*keep, "probs", "y_hat")


def _numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """The rows with a number of their own each, from the hash of the id."""
    return rows.withColumn("id", F.xxhash64(F.col(id_col)))


@dataclass
class SparkForest:
    """A forest as Spark fits and scores it; `arrays` where a task has to score it."""

    features: list[str]
    model: PipelineModel
    probabilities = None

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        return learners.score(self.model, rows, keep)

    def arrays(self) -> Forest:
        return Forest.of(self.model.stages[-1], self.features)


def _forest(train, features, seed, trees: int = 20, depth: int = 8):
    return SparkForest(features, learners.random_forest(features, trees, depth, seed).fit(learners.with_weights(train, "y")))


def _boosting(train, features, seed, **options):
    """Draws nothing; the seed is there for the grid."""
    return boosting.fit(learners.with_weights(train, "y"), features, **options)


# Each takes (training rows with `y` and `file_name`, features, seed, options).
FIT: dict[str, Callable] = {
    "random_forest": _forest,
    "boosting": _boosting,
    "kernel_svm": lambda train, features, seed, **o: kernel_machine.fit(train, features, seed=seed, **o),
    "gnb": lambda train, features, seed: NaiveBayes.fit(train, features),
    "knn": lambda train, features, seed, **o: Neighbours.fit(train, features, **o),
}


def fit(name: str, train: DataFrame, features: list[str], seed: int = 42, **options):
    return FIT[name](train, features, seed, **options)


def score(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, probs, y_hat) by any fitted learner."""
    if model.probabilities is None:
        return model.score(rows, keep)
    return scored(rows, model.features, keep, model.probabilities)
