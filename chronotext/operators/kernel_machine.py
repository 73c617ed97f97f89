"""A kernel classifier with probabilities: random Fourier features, a squared hinge, and
calibration on folds that a machine has not seen.

Standardised features are mapped to sqrt(2 / D) cos(w x + b). Directions w and phases b are drawn
from hashes of (seed, place), so SQL can compute the same map. The inner product of two maps
approximates the Gaussian kernel of width `gamma` (by default 1 / features, as the features have
variance one).

One machine a class is fitted for all rows, and one a class for all rows but each fold, together:
a Newton step is one pass in which every task sums, for each machine, the products of the mapped
rows inside its margin; each machine's equations are solved in one task, and the driver gets its
weights. A machine's values on the fold it did not see fit a sigmoid for its class, by which the
whole-table machine's values become probabilities; they are scaled to sum to one. Work and memory
of a task depend on D, classes and folds, not on rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import cos, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators.boosting import matrix, scored, vector
from chronotext.operators.ordering import hash_key, hash_number
from chronotext.session import staging_path

TWO_32 = 2.0**32


def uniform_pair(seed: int, place: str) -> tuple[float, float]:
    """Two numbers in (0, 1] and [0, 1) from the hash of (seed, place)."""
    h = hashlib.md5(f"{seed}:{place}".encode()).hexdigest()
    return (int(h[:8], 16) + 1) / TWO_32, int(h[8:16], 16) / TWO_32


def directions(seed: int, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(size x width standard normal draws, size phases)."""
    w = np.empty((size, width))
    for j in range(size):
        for i in range(width):
            u, v = uniform_pair(seed, f"{j}/{i}")
            w[j, i] = sqrt(-2.0 * log(u)) * cos(2.0 * pi * v)
    return w, np.array([2.0 * pi * uniform_pair(seed, f"b{j}")[1] for j in range(size)])


@dataclass
class FourierMap:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    gamma: float

    @staticmethod
    def fit(train: DataFrame, features: list[str], size: int, seed: int, gamma: float | None = None) -> FourierMap:
        """Mean and spread of the training rows (two numbers a feature) and the draws."""
        columns = [F.col(f"`{f}`").cast("double") for f in features]
        found = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        mean = np.array([found[f"m{i}"] or 0.0 for i in range(len(features))])
        spread = np.array([found[f"s{i}"] or 0.0 for i in range(len(features))])
        w, b = directions(seed, size, len(features))
        return FourierMap(mean, np.where(spread > 0, spread, 1.0), w, b, gamma or 1.0 / len(features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows x size; a missing value counts as the mean."""
        z = (np.where(np.isnan(x), self.mean, x) - self.mean) / self.scale
        return sqrt(2.0 / len(self.b)) * np.cos(sqrt(2.0 * self.gamma) * (z @ self.w.T) + self.b)


@dataclass
class KernelMachine:
    features: list[str]
    map: FourierMap
    weights: np.ndarray  # classes x (size + 1)
    slope: np.ndarray
    shift: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        z = self.map(x)
        return z @ self.weights[:, :-1].T + self.weights[:, -1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = 1.0 / (1.0 + np.exp(np.clip(self.slope * self.values(x) + self.shift, -500, 500)))
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def _with_one(z: np.ndarray) -> np.ndarray:
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def newton_pass(stored: DataFrame, fourier: FourierMap, width: int, classes: int, folds: int, weights: np.ndarray, cost: float):
    """For each machine (fold + 1, class): its loss at the given weights and the solution of the
    equations of the rows now inside its margin."""
    size = len(fourier.b) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, v, loss = np.zeros((folds + 1, classes, size, size)), np.zeros((folds + 1, classes, size)), np.zeros((folds + 1, classes))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _with_one(fourier(matrix(batch.column("x"), width)))
            y, fold = (batch.column(c).to_numpy() for c in ("y", "fold"))
            for m in range(folds + 1):
                own = np.flatnonzero(fold != m - 1)
                t = np.where(y[own][:, None] == np.arange(classes), 1.0, -1.0)
                gap = 1.0 - t * (z[own] @ weights[m].T)
                for k in range(classes):
                    inside = own[gap[:, k] > 0]
                    loss[m, k] += (gap[:, k][gap[:, k] > 0] ** 2).sum()
                    s[m, k] += z[inside].T @ z[inside]
                    v[m, k] += np.where(y[inside] == k, 1.0, -1.0) @ z[inside]
        keys = [(m, k) for m in range(folds + 1) for k in range(classes)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()),
             pa.array([np.concatenate([s[a].ravel(), v[a], [loss[a]]]).tobytes() for a in keys], pa.binary())], names=["m", "k", "sums"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for m, k, data in zip(*(batch.column(c).to_pylist() for c in ("m", "k", "sums"))):
                own = np.frombuffer(data)
                held[m, k] = held[m, k] + own if (m, k) in held else own
        rows = []
        for (m, k), own in held.items():
            s, v = own[: size * size].reshape(size, size), own[size * size: -1]
            ridge = np.eye(size)
            ridge[-1, -1] = 1e-6  # the constant is hardly held back
            rows.append({"m": m, "k": k, "loss": float(own[-1]), "w": np.linalg.solve(ridge + 2 * cost * s, 2 * cost * v).tolist()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("m", pa.int32()), ("k", pa.int32()), ("loss", pa.float64()), ("w", pa.list_(pa.float64()))]))

    sums = stored.mapInArrow(add, "m int, k int, sums binary").repartition("m", "k")
    loss, new = np.zeros(weights.shape[:2]), np.zeros_like(weights)
    for r in sums.mapInArrow(solve, "m int, k int, loss double, w array<double>").collect():  # one row a machine
        loss[r["m"], r["k"]], new[r["m"], r["k"]] = r["loss"], r["w"]
    return loss, new


def newton(step, weights: np.ndarray, cost: float, passes: int) -> np.ndarray:
    """Newton steps for all machines at once, halved where the objective has risen."""
    def objective(loss, w):
        return 0.5 * (w[..., :-1] ** 2).sum(axis=-1) + cost * loss

    loss, new = step(weights)
    value = objective(loss, weights)
    for _ in range(passes):
        loss, after = step(new)
        now = objective(loss, new)
        better = now <= value
        done = np.abs(value - now) <= 1e-6 * np.maximum(np.abs(value), 1.0)
        weights = np.where(better[..., None], new, weights)
        following = np.where(better[..., None], after, 0.5 * (weights + new))
        value = np.minimum(value, now)
        if done.all():
            break
        new = following
    return weights


def calibrate(stored: DataFrame, fourier: FourierMap, width: int, weights: np.ndarray, passes: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Sigmoids 1 / (1 + exp(slope f + shift)), one a class, fitted to the values of each fold's unseen
    rows, with targets held back from 0 and 1 by the class counts."""
    classes = weights.shape[1]
    counts = {r["y"]: r["n"] for r in stored.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    total = sum(counts.values())
    positive = np.array([counts.get(k, 0) for k in range(classes)], dtype=float)
    high, low = (positive + 1) / (positive + 2), 1.0 / (total - positive + 2)
    slope, shift = np.full(classes, -1.0), np.log((total - positive + 1) / (positive + 1))

    def sums(slope: np.ndarray, shift: np.ndarray):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((5, classes))
            for batch in batches:
                if not batch.num_rows:
                    continue
                z = _with_one(fourier(matrix(batch.column("x"), width)))
                y, fold = (batch.column(c).to_numpy() for c in ("y", "fold"))
                f = np.einsum("nd,nkd->nk", z, weights[fold + 1])
                a = np.clip(slope * f + shift, -500, 500)
                t = np.where(y[:, None] == np.arange(classes), high, low)
                p = 1.0 / (1.0 + np.exp(a))
                d, h = t - p, p * (1 - p)
                out += np.array([part.sum(axis=0) for part in (f * d, d, h * f * f, h * f, h)])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(classes), 5), pa.int32()), pa.array(np.repeat(np.arange(5), classes), pa.int32()),
                                              pa.array(out.ravel())], names=["k", "i", "s"])

        found = np.zeros((5, classes))
        for r in stored.mapInArrow(add, "k int, i int, s double").groupBy("k", "i").agg(F.sum("s").alias("s")).collect():
            found[r["i"], r["k"]] = r["s"]
        return found

    for _ in range(passes):
        ga, gb, haa, hab, hbb = sums(slope, shift)
        ridge = 1e-6 * (haa + hbb) + 1e-12
        haa, hbb = haa + ridge, hbb + ridge
        det = haa * hbb - hab**2
        step = np.array([-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det])
        step *= np.minimum(1.0, 2.0 / np.maximum(np.sqrt((step**2).sum(axis=0)), 1e-300))  # no further than the curve holds
        slope, shift = slope + step[0], shift + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return slope, shift


def fit(train: DataFrame, features: list[str], y: str = "y", id_col: str = "file_name", size: int = 128, cost: float = 1.0,
        gamma: float | None = None, folds: int = 3, passes: int = 8, seed: int = 42) -> KernelMachine:
    """Fit on rows with classes 0.. in `y`; `id_col` deals them to the folds."""
    spark, width = train.sparkSession, len(features)
    fourier = FourierMap.fit(train, features, size, seed, gamma)
    fold = (hash_number(hash_key(seed, F.concat(F.lit("fold/"), F.col(id_col).cast("string")))) % folds).cast("int")
    path = staging_path(spark, "kernel_rows")
    train.select(F.col(y).cast("int").alias("y"), F.coalesce(fold, F.lit(0)).alias("fold"), vector(features).alias("x")).write.parquet(path)
    stored = spark.read.parquet(path)
    classes = (stored.agg(F.max("y")).first()[0] or 0) + 1
    start = np.zeros((folds + 1, classes, size + 1))
    weights = newton(lambda w: newton_pass(stored, fourier, width, classes, folds, w, cost), start, cost, passes)
    slope, shift = calibrate(stored, fourier, width, weights)
    return KernelMachine(features, fourier, weights[0], slope, shift)


def score(model: KernelMachine, rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, probs, y_hat)."""
    return scored(rows, model.features, keep, model.probabilities)
