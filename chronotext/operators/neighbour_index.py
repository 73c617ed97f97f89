"""Neighbour search between two tables: a stored index of one, queries from another.

`CellIndex` is exact. Its points are stored by the nearest of about sqrt(n) pivots. A query
searches its home cells for an upper bound on its k-th distance, then the cells that the
triangle inequality cannot rule out.

`HashIndex` is approximate. Each of its tables cuts space by random projections into buckets;
a query visits the buckets that are cheapest to reach from its own place (multi-probe), and all
points in them are measured. The number of probes is fitted on a bounded sample so that the
sample's own neighbours are found at the wanted rate; neighbours in the whole table are nearer, so
its rate is at least that as a rule.

Both visit cells by zones (`neighbours.search_zones`): a query travels once to a zone with the names of
the cells it wants there, zones are cut into blocks of bounded size on either side,
and each block hands on k rows per query. Of equal vectors only the first `most` ids are
indexed, as no more can be among `most` nearest; Spark limits them before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.operators import neighbours
from chronotext.operators.neighbours import FOUND, PLACED, VISIT, Cells, _distances, _matrix, place, search_zones, visit_rows
from chronotext.operators.ordering import hash_key
from chronotext.session import materialize, staging_path

MAX_PIVOTS = 4096  # vectors a task holds to place points
SAMPLE = 4096  # vectors on which a hash index is fitted
PER_CELL = 64


def first_copies(points: DataFrame, most: int) -> DataFrame:
    """(id, vec): of each vector the `most` smallest ids, each once, so that a block hands on as many different ones."""
    copies = Window.partitionBy("vec").orderBy("id")
    rows = points.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.withColumn("_r", F.dense_rank().over(copies)).filter(F.col("_r") <= most).drop("_r").distinct()


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist) of the k nearest, ties by id; a point found in several tables counts once."""
    order = Window.partitionBy("qid").orderBy("dist", "id")
    once = found.groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def _queries(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").cast("array<double>").alias("vec"))


@dataclass
class CellIndex:
    """An exact index in a folder: `pivots` (cell, vec), `points` (grp, cell, id, vec) and
    `cells` (grp, cell, n, near, far)."""

    path: str
    most: int

    @staticmethod
    def fit(points: DataFrame, most: int = 16, path: str | None = None) -> CellIndex:
        """Index (id, vec) rows for searches of up to `most` neighbours."""
        spark = points.sparkSession
        path = path or staging_path(spark, "cells")
        kept = materialize(first_copies(points, most))
        n = kept.count()
        wanted = max(1, min(MAX_PIVOTS, ceil(sqrt(n)), n // PER_CELL))
        chosen = kept.orderBy(hash_key(7, "id"), "id").limit(wanted).select("vec").toPandas()["vec"]
        pivots = _matrix(chosen) if n else np.zeros((1, 1))
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pivots)], "cell bigint, vec array<double>").write.parquet(f"{path}/pivots")

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    cell, radius = place(_matrix(rows["vec"]), pivots)
                    yield rows.assign(grp=0, cell=cell, radius=radius)[["grp", "cell", "id", "vec", "radius"]]

        placed = kept.mapInPandas(assign, PLACED)
        placed.write.parquet(f"{path}/points")
        spark.read.parquet(f"{path}/points").groupBy("grp", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")
        ).write.parquet(f"{path}/cells")
        return CellIndex(path, most)

    def _load(self, spark: SparkSession):
        pivots = spark.read.parquet(f"{self.path}/pivots").orderBy("cell").toPandas()  # MAX_PIVOTS rows at most
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()
        return _matrix(pivots["vec"]), cells

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, id, dist): the k nearest indexed points of every (qid, vec) row."""
        if k > self.most:
            raise ValueError(f"this index was fitted for {self.most} neighbours")
        spark = queries.sparkSession
        asked = _queries(queries)
        pivots, stats = self._load(spark)
        if stats.empty:
            return ranked(spark.createDataFrame([], FOUND), k)
        cells = Cells(pivots, *(stats[x].to_numpy() for x in ("cell", "n", "near", "far")))
        zones = spark.createDataFrame([(int(c), int(z)) for c, z in zip(cells.ids, cells.zones)], "cell bigint, zone bigint")
        points = spark.read.parquet(f"{self.path}/points").join(F.broadcast(zones), "cell").select("grp", "zone", "cell", "id", "vec")

        def visit(first: bool):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for rows in batches:
                    yield from cells.visits(0, rows, k, first)

            return run

        found = materialize(search_zones(asked.mapInPandas(visit(True), VISIT), points, k))
        bound = ranked(found, k).groupBy("qid").agg(
            F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(float("inf")).alias("bound"))
        rest = asked.join(bound, "qid").mapInPandas(visit(False), VISIT)
        return ranked(found.unionByName(search_zones(rest, points, k)), k)


@dataclass
class HashIndex:
    """An approximate index: `points` (grp = table, cell = bucket, id, vec) in a folder; its projections
    (tables x bits x dimensions), offsets, width and probes are a few small arrays."""

    path: str
    most: int
    axes: np.ndarray
    shifts: np.ndarray
    width: float
    probes: int
    sample_recall: float

    @staticmethod
    def fit(points: DataFrame, k: int = 5, tables: int = 4, recall: float = 0.95, seed: int = 42, path: str | None = None) -> HashIndex:
        """Index every (id, vec) row; at most SAMPLE rows, the first by hash, choose width and probes."""
        spark = points.sparkSession
        path = path or staging_path(spark, "buckets")
        most = k + 1  # a point may ask for others than itself
        kept = materialize(first_copies(points, most))
        n = kept.count()
        rows = kept.orderBy(hash_key(seed, "id"), "id").limit(SAMPLE).select("vec").toPandas()["vec"]
        sample = _matrix(rows) if n else np.zeros((1, 1))
        bits = max(1, min(16, round(log2(max(2, n / PER_CELL)) / 1.5)))
        draw = np.random.default_rng(seed)
        axes = draw.normal(size=(tables, bits, sample.shape[1]))
        spread = float(np.std(np.einsum("tbd,nd->ntb", axes, sample))) or 1.0
        index = HashIndex(path, most, axes, draw.uniform(size=(tables, bits)), 2.0 * spread, 1, 0.0)
        index._choose_probes(sample, k, recall)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if not len(rows):
                    continue
                cells = index.buckets(np.floor(index.positions(_matrix(rows["vec"]))).astype(np.int64))
                for t in range(tables):
                    yield pd.DataFrame({"grp": t, "cell": cells[:, t], "id": rows["id"].to_numpy(), "vec": rows["vec"].to_numpy()})

        kept.mapInPandas(deal, "grp int, cell bigint, id bigint, vec array<double>").write.parquet(f"{path}/points")
        return index

    def positions(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x tables x bits: places on the projections, in bucket widths."""
        return np.einsum("tbd,nd->ntb", self.axes, vectors) / self.width + self.shifts

    @staticmethod
    def buckets(corners: np.ndarray) -> np.ndarray:
        """One 64-bit number for each row of whole numbers (last axis)."""
        out = np.zeros(corners.shape[:-1], dtype=np.uint64)
        for b in range(corners.shape[-1]):
            out = (out ^ corners[..., b].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def steps(self) -> np.ndarray:
        """Steps to other buckets: all of up to three bits to either side, nothing first."""
        bits = self.axes.shape[1]
        out = [np.zeros(bits, dtype=np.int64)]
        for m in range(1, min(bits, 3 if bits > 6 else bits) + 1):
            for at in combinations(range(bits), m):
                for signs in product((-1, 1), repeat=m):
                    step = np.zeros(bits, dtype=np.int64)
                    step[list(at)] = signs
                    out.append(step)
        return np.array(out)

    def visited(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """Rows x tables x probes: the buckets cheapest to reach, by squared ways to their walls."""
        place = self.positions(vectors)
        corner = np.floor(place)
        down, steps = place - corner, self.steps()
        low, high = (steps == -1).astype(float), (steps == 1).astype(float)
        cost = np.einsum("ntb,sb->nts", down**2, low) + np.einsum("ntb,sb->nts", (1 - down) ** 2, high)
        probes = min(probes, len(steps))
        pick = np.argpartition(cost, probes - 1, axis=2)[:, :, :probes]
        return self.buckets(corner.astype(np.int64)[:, :, None, :] + steps[pick])

    def _choose_probes(self, sample: np.ndarray, k: int, recall: float) -> None:
        """The fewest probes (a power of two) that find the sample's neighbours at the wanted rate."""
        asked = sample[:256]
        d = _distances(asked, sample)
        d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
        own = self.buckets(np.floor(self.positions(sample)).astype(np.int64))
        limit = len(self.steps())
        while True:
            cells = self.visited(asked, self.probes)
            met = [(own[near[i]][:, :, None] == cells[i][None]).any(axis=(1, 2)).mean() for i in range(len(asked))]
            self.sample_recall = float(np.mean(met))
            if self.sample_recall >= recall or self.probes >= limit:
                return
            self.probes = min(2 * self.probes, limit)

    def search(self, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
        """(qid, rank, id, dist): about the k nearest indexed points of every (qid, vec) row;
        `others` leaves out the point of the query's own id."""
        spark = queries.sparkSession
        placed = spark.read.parquet(f"{self.path}/points")
        count = max(1, ceil(placed.count() / len(self.axes) / neighbours.BLOCK))
        points = placed.select("grp", F.pmod("cell", F.lit(count)).alias("zone"), "cell", "id", "vec")
        index = self

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for i in range(0, len(rows), 256):
                    some = rows.iloc[i: i + 256]
                    cells = index.visited(_matrix(some["vec"]), index.probes)
                    n, tables, probes = cells.shape
                    for t in range(tables):
                        yield visit_rows(t, some, np.repeat(np.arange(n), probes), cells[:, t].ravel(), cells[:, t].ravel() % count)

        found = search_zones(_queries(queries).mapInPandas(visit, VISIT), points, k + 1 if others else k)
        return ranked(found.filter("qid <> id") if others else found, k)


def vote(found: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """(qid, probs, y_hat): shares of the classes 0.. among the neighbours found; ties go to the
    smaller class. `labels` has (id, y)."""
    votes = found.join(labels.select("id", F.col("y").cast("int").alias("y")), "id").groupBy("qid", "y").agg(
        F.count(F.lit(1)).alias("n"))
    own = votes.groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("of"),  # k entries at most
        F.sum("n").alias("all"), F.max_by("y", F.struct("n", -F.col("y"))).alias("y_hat"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce(F.col("of")[c], F.lit(0)) / F.col("all"))
    return own.select("qid", shares.alias("probs"), "y_hat")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): share of the exact neighbours (qid, id) that were found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
