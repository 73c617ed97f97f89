"""Grids of fits that can be stopped and taken up again.

A cell is one fit: learner, feature subset, time scale, seed and the learner's options. Cells run as
concurrent Spark jobs over one stored table. A cell's predictions are written to its own
folder, then a marker beside it; a marker is a whole file of its own job, so it is there only when
the predictions are. A run reads the markers first and fits only what has none, overwriting
what a killed run has left behind. Cells are known by the hash of their parameters and
of the table's state, so one folder may serve many grids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import asdict, dataclass, field
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators import classifiers
from chronotext.operators.prepare import class_index, label_encode
from chronotext.session import materialize


@dataclass(frozen=True)
class Cell:
    learner: str
    subset: str
    scale: str
    seed: int
    options: tuple = field(default=())  # sorted (name, value) pairs

    def key(self, state: str) -> str:
        return hashlib.md5(json.dumps([asdict(self), state], sort_keys=True).encode()).hexdigest()


def cells(learners: dict[str, dict], subsets: Iterable[str], scales: Iterable[str], seeds: Iterable[int]) -> list[Cell]:
    """All combinations; `learners` names each learner with its options."""
    return [Cell(name, subset, scale, seed, tuple(sorted(options.items())))
            for scale in scales for subset in subsets for name, options in learners.items() for seed in seeds]


def finished(spark: SparkSession, folder: str) -> set[str]:
    """Keys of the cells with a marker."""
    spark.createDataFrame([("",)], "key string").coalesce(1).write.mode("overwrite").json(f"{folder}/done/start")  # the folder exists
    rows = spark.read.schema("key string").json(f"{folder}/done/*").filter("key <> ''").collect()  # one short row a cell
    return {r["key"] for r in rows}


def run(spark: SparkSession, folder: str, wanted: list[Cell], fit_cell: Callable[[Cell], DataFrame], state: str = "",
        workers: int = 4) -> DataFrame:
    """The predictions of all wanted cells with the cell's parameters, fitted where not there yet. A cell
    that fails does not stop the others; the failures are raised together at the end."""
    keys = {c.key(state): c for c in wanted}
    done = finished(spark, folder)
    left = [k for k in keys if k not in done]

    def one(key: str) -> None:
        cell = keys[key]
        out = fit_cell(cell).select(
            F.lit(cell.subset).alias("feature_subset"), F.lit(cell.scale).alias("time_scale"), F.lit(cell.learner).alias("model"),
            F.lit(cell.seed).alias("seed"), "*")
        out.write.mode("overwrite").parquet(f"{folder}/cells/{key}")
        spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").json(f"{folder}/done/{key}")

    failed = []
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        jobs = {pool.submit(inheritable_thread_target(spark)(one), k): k for k in left}
        for job in as_completed(jobs):
            if job.exception() is not None:
                failed.append((keys[jobs[job]], job.exception()))
    if failed:
        raise RuntimeError("; ".join(f"{c}: {type(e).__name__}: {str(e)[:300]}" for c, e in failed)) from failed[0][1]
    return spark.read.parquet(*[f"{folder}/cells/{k}" for k in keys])


def fit_on(table: DataFrame, subsets: dict[str, list[str]], targets: dict[str, str], split_col: str = "split",
           id_col: str = "file_name") -> Callable[[Cell], DataFrame]:
    """A function that fits a cell on the training rows of a stored table and predicts all others:
    (dataset, id_col, y, y_hat, probs). The neighbours of a subset do not depend on the target: they are searched once
    and written, and the cells of all targets vote on them."""
    coded, searched, locks, guard = {}, {}, {}, Lock()
    for scale, target in targets.items():
        classes = materialize(class_index(table.filter(F.col(split_col) == "train"), target))  # every job of every cell reads it
        coded[scale] = label_encode(table, classes, target)

    def neighbours(cell: Cell, train: DataFrame, rest: DataFrame) -> tuple[classifiers.Neighbours, DataFrame]:
        key = cell.subset, cell.options
        with guard:
            lock = locks.setdefault(key, Lock())
        with lock:
            if key in searched:
                model, found = searched[key]
                return model.with_labels(train, id_col), found
            model = classifiers.Neighbours.fit(train, subsets[cell.subset], id_col=id_col, **dict(cell.options))
            searched[key] = model, materialize(model.nearest(rest, id_col))
            return searched[key]

    def fit_cell(cell: Cell) -> DataFrame:
        rows = coded[cell.scale]
        train, rest = rows.filter(F.col(split_col) == "train"), rows.filter(F.col(split_col) != "train")
        kept = [id_col, split_col, "y"]
        if cell.learner == "knn":
            model, near = neighbours(cell, train, rest)
            found = model.score(rest, kept, id_col, near)
        else:
            model = classifiers.fit(cell.learner, train, subsets[cell.subset], cell.seed, **dict(cell.options))
            found = classifiers.score(model, rest, kept)
        return found.select(F.col(split_col).alias("dataset"), id_col, F.col("y").cast("int").alias("y"), "y_hat", "probs")

    return fit_cell
