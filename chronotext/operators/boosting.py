"""Boosted trees for several classes at once, from distributed histograms.

Features are cut into bins once. A round grows one tree for each class, level by level, on the
gradients of the softmax loss: a level is one pass over the rows for all classes, in which every
task sums gradients, curvatures and counts into (class, node, feature, bin) cells. A node's cells
are summed and its best cut chosen in one task, so the driver gets one short row a node. Gradients
are whole multiples of a small step, so their sums do not depend on how rows are partitioned.

The stored rows carry the margins of all rounds before the last `every` at most; later trees
are added on the fly. A model is a few arrays bounded by rounds, classes and depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.session import staging_path

STEP = 2.0**-20  # gradients are multiples of it
ACCURACY = 10_000


def vector(features: list[str]):
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of equal lengths; nulls are not a number."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class BoostedTrees:
    """Trees by round: `feature` and `cut` (classes x nodes), `leaf` (classes x leaves)."""

    features: list[str]
    classes: int
    depth: int
    edges: list[np.ndarray]
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Rows x features: how many edges lie below a value; a missing value is in the first bin."""
        out = np.zeros(x.shape, dtype=np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, np.nan_to_num(x[:, f], nan=-np.inf), side="left")
        return out

    def nodes(self, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """Rows x classes: the node each row reaches after `depth` cuts, numbered level by level."""
        node = np.zeros((len(bins), self.classes), dtype=np.int64)
        at, row = np.arange(self.classes)[None, :], np.arange(len(bins))[:, None]
        for _ in range(depth):
            f = feature[at, node]
            node = 2 * node + 1 + ((bins[row, np.maximum(f, 0)] > cut[at, node]) & (f >= 0))
        return node

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for feature, cut, leaf in self.rounds[first:]:
            out += leaf[np.arange(self.classes)[None, :], self.nodes(bins, feature, cut, self.depth) - (2**self.depth - 1)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(self.bins(x)))


def best_cut(cells: np.ndarray, l2: float, min_rows: int) -> tuple:
    """(feature, cut, sums left, sums right, gain) of one node's (feature, bin, 3) cells."""
    left = np.cumsum(cells, axis=1)[:, :-1]
    whole = cells[0].sum(axis=0)
    right = whole - left
    ok = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows)

    def value(s):
        return s[..., 0] ** 2 / (s[..., 1] + l2)

    gain = np.where(ok, value(left) + value(right) - value(whole), -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[f, b] > 1e-12:
        return -1, 0, whole, np.zeros(3), 0.0
    return int(f), int(b), left[f, b], right[f, b], float(gain[f, b])


def bin_edges(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 rising cuts of each feature, near its quantiles."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = train.agg(*[
        F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, ACCURACY).alias(f"q{i}") for i, f in enumerate(features)
    ]).first()
    return [np.unique(np.array(found[f"q{i}"] or [], dtype=float)) for i in range(len(features))]


def fit(train: DataFrame, features: list[str], y: str = "y", weight: str | None = "weight", rounds: int = 100, depth: int = 3,
        rate: float = 0.1, bins: int = 64, l2: float = 1.0, min_rows: int = 20, every: int = 10) -> BoostedTrees:
    """Fit on rows with classes 0.. in `y` and a weight each."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    spark = train.sparkSession
    rows = train.select(F.col(y).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), vector(features).alias("x"))
    classes = (rows.agg(F.max("y")).first()[0] or 0) + 1
    model = BoostedTrees(features, classes, depth, bin_edges(train, features, bins))
    width = len(features)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = model.bins(matrix(batch.column("x"), width))
            none = np.zeros((batch.num_rows, classes)).tobytes()
            yield stored_batch(batch.column("y"), batch.column("w"), cut, none)

    def stored_batch(ys, ws, cut: np.ndarray, margins: bytes):
        n = len(ys)
        fixed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                 for size, data in ((width, np.ascontiguousarray(cut).tobytes()), (8 * classes, margins))]
        return pa.RecordBatch.from_arrays([ys, ws, *fixed], names=["y", "w", "bins", "margins"])

    def unpacked(batch: pa.RecordBatch, first: int):
        n = batch.num_rows
        cut, held = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t).reshape(n, -1) for c, t in (("bins", np.uint8), ("margins", float)))
        return cut, held + model.margins(cut, first)

    fields = "y int, w double, bins binary, margins binary"
    path = staging_path(spark, "binned")
    rows.mapInArrow(to_bins, fields).write.parquet(path)
    stored, first = spark.read.parquet(path), 0
    nodes = 2**depth - 1
    for done in range(rounds):
        if done - first >= every:
            since = first

            def move_on(batches):
                for batch in batches:
                    cut, margins = unpacked(batch, since)
                    yield stored_batch(batch.column("y"), batch.column("w"), cut, margins.tobytes())

            path = staging_path(spark, "binned")
            stored.mapInArrow(move_on, fields).write.parquet(path)
            stored, first = spark.read.parquet(path), done
        feature, cut = np.full((classes, nodes), -1), np.zeros((classes, nodes), dtype=np.int64)
        leaf = np.zeros((classes, 2**depth))
        for level in range(depth):
            found = level_cuts(stored, model, (feature, cut), level, bins, l2, min_rows, unpacked, first)
            for r in found:
                k, node = r["k"], r["node"] + 2**level - 1
                feature[k, node], cut[k, node] = r["feature"], r["cut"]
                if level == depth - 1:
                    for side, g, h in ((0, r["gl"], r["hl"]), (1, r["gr"], r["hr"])):
                        leaf[k, 2 * r["node"] + side] = -rate * g / (h + l2)
        model.rounds.append((feature, cut, leaf))
    return model


def level_cuts(stored: DataFrame, model: BoostedTrees, tree: tuple, level: int, bins: int, l2: float, min_rows: int, unpacked, first: int):
    """The best cut of every node of a level, for all classes: classes x nodes rows."""
    classes, width, count = model.classes, len(model.features), 2**level
    feature, cut = tree

    def sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((classes, width, count * bins, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            own, margins = unpacked(batch, first)
            y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
            p = softmax(margins)
            g, h = p.copy(), p * (1 - p) * w[:, None]
            g[np.arange(len(y)), y] -= 1.0
            g, h = np.rint(g * w[:, None] / STEP), np.rint(h / STEP)
            node = model.nodes(own, feature, cut, level) - (count - 1)
            for k in range(classes):
                for f in range(width):
                    at = node[:, k] * bins + own[:, f]
                    for i, values in enumerate((g[:, k], h[:, k], None)):
                        cells[k, f, :, i] += np.bincount(at, values, minlength=count * bins)
        blocks = cells.reshape(classes, width, count, bins, 3).transpose(0, 2, 1, 3, 4)
        keys = [(k, n) for k in range(classes) for n in range(count) if blocks[k, n, 0, :, 2].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([n for _, n in keys], pa.int32()),
             pa.array([np.ascontiguousarray(blocks[k, n]).tobytes() for k, n in keys], pa.binary())], names=["k", "node", "cells"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, n, data in zip(*(batch.column(c).to_pylist() for c in ("k", "node", "cells"))):
                own = np.frombuffer(data)
                held[k, n] = held[k, n] + own if (k, n) in held else own
        rows = []
        for (k, n), own in held.items():
            cells = own.reshape(width, bins, 3) * np.array([STEP, STEP, 1.0])
            f, b, left, right, _ = best_cut(cells, l2, min_rows)
            rows.append({"k": k, "node": n, "feature": f, "cut": b, "gl": float(left[0]), "hl": float(left[1]),
                         "gr": float(right[0]), "hr": float(right[1])})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [(c, pa.int32()) for c in ("k", "node", "feature", "cut")] + [(c, pa.float64()) for c in ("gl", "hl", "gr", "hr")]))

    cells = stored.mapInArrow(sum_cells, "k int, node int, cells binary").repartition("k", "node")
    return cells.mapInArrow(choose, "k int, node int, feature int, cut int, gl double, hl double, gr double, hr double").collect()


def scored(rows: DataFrame, features: list[str], keep: list[str], probabilities) -> DataFrame:
    """(keep, probs, y_hat) by a function from a matrix to class probabilities; ties go to the smaller class."""
    names = [f"c{i}" for i in range(len(keep))]
    asked = rows.select(*(F.col(k).alias(c) for k, c in zip(keep, names)), vector(features).alias("x"))
    kinds = "".join(f"{c} {asked.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(matrix(batch.column("x"), len(features))) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(list(p), pa.list_(pa.float64())),
                 pa.array(p.argmax(axis=1) if len(p) else [], pa.int32())], names=[*names, "probs", "y_hat"])

    return asked.mapInArrow(run, f"{kinds}probs array<double>, y_hat int").toDF(*keep, "probs", "y_hat")


def score(model: BoostedTrees, rows: DataFrame, keep: list[str]) -> DataFrame:
    return scored(rows, model.features, keep, model.probabilities)
