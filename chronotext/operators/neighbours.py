"""Exact nearest neighbours, and the two resampling steps built on them.

Points are assigned to the nearest of a bounded set of pivots. A query first searches
its home cell, which gives an upper bound on its k-th distance, and then only those
cells that the triangle inequality cannot rule out. Cells lie together in zones; a query
travels once to a zone with the names of the cells it wants there. Zones are cut into blocks of
bounded size on both sides, distances are taken a slice at a time, and each block
hands on k rows per query, never the pairs. Copies of one vector are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators.ordering import hash_key, hash_number
from chronotext.session import materialize

MAX_PIVOTS = 256
BLOCK = 32_768  # points of a task
PART = 16_384  # queries of a task
SLICE = 512  # queries measured together
MEASURED = 1 << 20  # distances held at a time
SLACK = 1e-9
FOUND = "grp int, qid bigint, id bigint, dist double"
VISIT = "grp int, zone bigint, qid bigint, vec array<double>, bound double, cells array<bigint>"
PLACED = "grp int, cell bigint, id bigint, vec array<double>, radius double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out *= -2.0
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    return out


def _first(at: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """The k first of each query by distance, ties by id."""
    order = np.lexsort((ids, dist, at))
    at, ids, dist = at[order], ids[order], dist[order]
    start = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return at[place < k], ids[place < k], dist[place < k]


def _nearest_visited(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """k nearest points of each query among those of the cells it visits, ties by id. A query has a `bound`
    beyond which it wants none. Distances are held for at most MEASURED pairs at a time."""
    points = points.sort_values("cell", kind="stable")
    q, p, ids = _matrix(queries["vec"]), _matrix(points["vec"]), points["id"].to_numpy()
    names, starts = np.unique(points["cell"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(points))
    # The rough form loses digits, so keep a margin and measure again.
    margin = 1e-12 * ((q * q).sum(1) + (p * p).sum(1).max())
    pairs = max(1, MEASURED // max(q.shape[1], 1))
    qids, bounds, cells = queries["qid"].to_numpy(), queries["bound"].to_numpy(float), queries["cells"].tolist()
    out = []
    for low in range(0, len(q), SLICE):
        some = slice(low, min(low + SLICE, len(q)))
        lengths = [len(c) for c in cells[some]]
        owner, named = np.repeat(np.arange(low, low + len(lengths)), lengths), np.concatenate(cells[some])
        order = np.argsort(named, kind="stable")
        owner, named = owner[order], named[order]
        left, right = np.searchsorted(named, names, "left"), np.searchsorted(named, names, "right")
        limit = bounds.copy()
        held = (np.zeros(0, np.int64), ids[:0], np.zeros(0))
        waiting, n_waiting = [], 0
        for c in np.nonzero(left < right)[0]:
            rows = owner[left[c]: right[c]]
            step = max(1, MEASURED // len(rows))
            for at in range(starts[c], ends[c], step):
                part = p[at: min(at + step, ends[c])]
                rough = _squared(q[rows], part)
                top = (limit[rows] * (1.0 + SLACK)) ** 2 + margin[rows]
                wide = (~np.isfinite(top)).any() or np.count_nonzero(rough <= top[:, None]) > 4 * k * len(rows)
                if wide and len(part) > k:
                    top = np.minimum(top, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * margin[rows])
                qi, pi = np.nonzero(rough <= top[:, None])
                for i in range(0, len(qi), pairs):
                    a, b = qi[i: i + pairs], pi[i: i + pairs]
                    waiting.append((rows[a], ids[at + b], np.sqrt(((q[rows[a]] - part[b]) ** 2).sum(1))))
                n_waiting += len(qi)
                if n_waiting >= MEASURED // 4:
                    held = _first(*(np.concatenate(x) for x in zip(held, *waiting)), k)
                    full = np.bincount(held[0], minlength=len(q)) >= k
                    last = np.zeros(len(q))
                    np.maximum.at(last, held[0], held[2])
                    limit = np.where(full, np.minimum(limit, last), limit)
                    waiting, n_waiting = [], 0
        out.append(_first(*(np.concatenate(x) for x in zip(held, *waiting)), k))
    at, found, dist = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"grp": queries["grp"].iat[0], "qid": qids[at], "id": found, "dist": dist})


def search_zones(visits: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(grp, qid, id, dist): the k nearest points to each query in every block of a zone that it visits.

    Visits are (grp, zone, qid, vec, bound, cells): the cells of the zone to be searched. Points are (grp, zone,
    cell, id, vec). Zones are cut into blocks of BLOCK points and parts of PART queries.
    """
    sizes = points.groupBy("grp", "zone").agg(F.count(F.lit(1)).alias("n"))
    load = visits.groupBy("grp", "zone").agg(F.count(F.lit(1)).alias("nq"))
    # One row a zone, of which there is one for BLOCK points.
    plan = F.broadcast(materialize(load.join(sizes, ["grp", "zone"]).select(
        "grp", "zone", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("nq") / PART).cast("int").alias("parts"))))

    def spread(n: str, key: str):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    keys = ["grp", "zone", "block", "part"]
    left = visits.join(plan, ["grp", "zone"]).withColumn("part", spread("parts", "qid")).withColumn("block", every("blocks"))
    right = points.join(plan, ["grp", "zone"]).withColumn("block", spread("blocks", "id")).withColumn("part", every("parts"))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"grp": [], "qid": [], "id": [], "dist": []})
        return _nearest_visited(a, b, k)

    return left.select(*keys, "qid", "vec", "bound", "cells").groupBy(*keys).cogroup(
        right.select(*keys, "cell", "id", "vec").groupBy(*keys)).applyInPandas(block, FOUND)


def visit_rows(grp: int, rows: pd.DataFrame, q: np.ndarray, cells: np.ndarray, zones: np.ndarray) -> pd.DataFrame:
    """The visits of some queries: row number, cell and its zone of each cell to be searched."""
    order = np.lexsort((zones, q))
    q, cells, z = q[order], cells[order], zones[order]
    start = np.nonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (z[1:] != z[:-1])]))[0] if len(q) else np.zeros(0, int)
    at = q[start]
    return pd.DataFrame({
        "grp": grp, "zone": z[start], "qid": rows["qid"].to_numpy()[at], "vec": rows["vec"].to_numpy()[at],
        "bound": rows["bound"].to_numpy(float)[at] if "bound" in rows else np.inf,
        "cells": pd.Series(np.split(cells, start[1:]) if len(start) else [], dtype=object),
    })


def place(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the way to it."""
    cell, radius = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, MEASURED // len(pivots))
    for i in range(0, len(vectors), step):
        d = _distances(vectors[i: i + step], pivots)
        cell[i: i + step] = d.argmin(1)
        radius[i: i + step] = d[np.arange(len(d)), cell[i: i + step]]
    return cell, radius


class Cells:
    """The cells of one group around their pivots, and which of them a query has to search."""

    def __init__(self, pivots: np.ndarray, ids: np.ndarray, counts: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.pivots, self.ids, self.counts, self.near, self.far = pivots, ids, counts, near, far
        # Cells are dealt to zones of about BLOCK points.
        self.zones = ((np.cumsum(counts) - counts) // BLOCK).astype(np.int64)

    def visits(self, grp: int, rows: pd.DataFrame, k: int, first: bool) -> Iterator[pd.DataFrame]:
        """Nearest cells until k points are sure; then the rest that may hold a nearer one than the bound."""
        step = max(1, MEASURED // max(len(self.pivots), 1))
        for i in range(0, len(rows), step):
            some = rows.iloc[i: i + step]
            q, c = np.nonzero(self._pick(some, k, first))
            yield visit_rows(grp, some, q, self.ids[c], self.zones[c])

    def _pick(self, rows: pd.DataFrame, k: int, first: bool) -> np.ndarray:
        every = _distances(_matrix(rows["vec"]), self.pivots)
        d = every[:, self.ids]
        order = np.argsort(d, axis=1, kind="stable")
        sure = np.cumsum(self.counts[order], axis=1)
        home = np.zeros_like(d, dtype=bool)
        np.put_along_axis(home, order, np.concatenate([np.ones((len(rows), 1), bool), sure[:, :-1] < k], axis=1), axis=1)
        if first:
            return home
        bound, own = rows["bound"].to_numpy()[:, None], every.argmin(1)
        low = np.maximum(d - self.far, self.near - d)
        apart, nearest_d = _distances(self.pivots[own], self.pivots[self.ids]), every[np.arange(len(rows)), own][:, None]
        # The rough form is off by about 1e-7 of the vectors' length, which counts most between pivots close together.
        scale = np.sqrt((self.pivots * self.pivots).sum(1).max())
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 1e-3 * scale, (d**2 - nearest_d**2) / (2 * apart), 0.0)
        return ~home & (np.maximum(low, plane) <= bound + SLACK * (1.0 + bound) + 1e-6 * (scale + nearest_d))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("grp", "qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(points: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(qid, rank, id, dist): the k nearest other points of every point of a table
    (id BIGINT, vec ARRAY<DOUBLE>), inside its group if one is named."""
    grp = F.col(group).cast("int") if group else F.lit(0)
    base = points.select(grp.alias("grp"), F.col("id").cast("bigint").alias("id"), "vec")
    # Of equal vectors only the first k+1 ids can ever be among the k nearest others.
    copies = Window.partitionBy("grp", "vec").orderBy("id")
    targets = materialize(
        base.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k + 1).drop("_r")
    )
    queries = base.groupBy("grp", "vec").agg(F.min("id").alias("qid"))

    n = targets.count()
    n_pivots = max(1, min(MAX_PIVOTS, n // 64))
    # A bounded number of vectors, spread by hash.
    pivots = _matrix(
        targets.orderBy(hash_key(7, "id"), "id").limit(n_pivots).select("vec").toPandas()["vec"]
    ) if n else np.zeros((1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                cell, radius = place(_matrix(rows["vec"]), pivots)
                yield rows.assign(cell=cell, radius=radius)[["grp", "cell", "id", "vec", "radius"]]

    placed = materialize(targets.mapInPandas(assign, PLACED))
    stats = placed.filter("grp IS NOT NULL").groupBy("grp", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")
    ).toPandas()  # groups times pivots rows
    of_group = {int(g): Cells(pivots, *(c[x].to_numpy() for x in ("cell", "n", "near", "far")))
                for g, c in stats.sort_values("cell").groupby("grp")}
    zones = points.sparkSession.createDataFrame(
        [(g, int(c), int(z)) for g, cells in of_group.items() for c, z in zip(cells.ids, cells.zones)],
        "grp int, cell bigint, zone bigint")

    def visit(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for g, some in rows.groupby("grp"):
                    yield from of_group[int(g)].visits(int(g), some, k + 1, first)

        return run

    home_visits = queries.select("grp", "qid", "vec").mapInPandas(visit(True), VISIT)
    points_by_cell = placed.join(F.broadcast(zones), ["grp", "cell"]).select("grp", "zone", "cell", "id", "vec")
    found_home = materialize(search_zones(home_visits, points_by_cell, k + 1))
    bound = (
        _best(found_home, k + 1).groupBy("grp", "qid")
        .agg(F.when(F.count(F.lit(1)) > k, F.max("dist")).otherwise(float("inf")).alias("bound"))
    )
    far_visits = queries.join(bound, ["grp", "qid"]).select("grp", "qid", "vec", "bound").mapInPandas(
        visit(False), VISIT
    )
    found = found_home.unionByName(search_zones(far_visits, points_by_cell, k + 1))
    best = _best(found, k + 1).select("grp", F.col("qid").alias("rep"), "id", "dist")

    # Give every copy its answer, without the point itself. A hot vector is split by
    # the skew handling of the join, its answer being only k+1 rows.
    named = base.join(queries.withColumnRenamed("qid", "rep"), ["grp", "vec"]).select(
        "grp", "rep", F.col("id").alias("qid")
    )
    others = named.join(best, ["grp", "rep"]).filter(F.col("qid") != F.col("id"))
    again = Window.partitionBy("qid").orderBy("dist", "id")
    return (
        others.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k)
        .select("qid", "rank", "id", "dist")
    )


def knn_classify(points: DataFrame, k: int = 5) -> DataFrame:
    """(id, y, y_hat): vote of the k nearest other points; ties go to the smaller label."""
    labels = points.select(F.col("id"), F.col("label").alias("_vote"))
    votes = (
        nearest(points.select("id", "vec"), k)
        .join(labels, "id")
        .groupBy("qid", "_vote")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("qid")
        .agg(F.max_by("_vote", F.struct("_n", -F.col("_vote"))).alias("y_hat"))
    )
    return points.select("id", F.col("label").alias("y")).join(
        votes.withColumnRenamed("qid", "id"), "id"
    )


def tomek_links(points: DataFrame) -> DataFrame:
    """(id, nn, label, nn_label): pairs that are each other's nearest neighbour and
    carry different labels, once from each side."""
    nn = nearest(points.select("id", "vec"), 1).select(F.col("qid").alias("id"), F.col("id").alias("nn"))
    nn = materialize(nn)
    back = nn.select(F.col("id").alias("nn"), F.col("nn").alias("id"))
    mutual = nn.join(back, ["id", "nn"])
    own = points.select("id", "label")
    other = points.select(F.col("id").alias("nn"), F.col("label").alias("nn_label"))
    return mutual.join(own, "id").join(other, "nn").filter("label <> nn_label").select(
        "id", "nn", "label", "nn_label"
    )


def remove_tomek_links(points: DataFrame) -> DataFrame:
    """Drop linked points of every class but the smallest one."""
    smallest = points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by("label", F.struct("n", "label")).alias("label")
    )
    drop = tomek_links(points).filter(F.col("label") != smallest.scalar()).select("id")
    return points.join(drop, "id", "left_anti")


CHUNK = 65_536


def smote(points: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(id, vec, label, synthetic): the input and, for each smaller class, as many
    synthetic points as it lacks to the largest.

    Each lies on the way from a point to one of its k nearest points of the same
    class; point, neighbour and weight follow from hashes. A point with a large share
    is cut into chunks before its copies are made.
    """
    from chronotext.operators.ordering import hash_rank

    n_class = points.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    need = n_class.withColumn("_most", F.lit(n_class.agg(F.max("_n")).scalar())).select(
        "label", "_n", (F.col("_most") - F.col("_n")).alias("_need")
    ).filter("_need > 0 AND _n > 1")
    ranked = hash_rank(points.select("id", "label"), seed, "id", ["label"])
    shares = (
        ranked.join(F.broadcast(need), "label")
        .withColumn(
            "_copies",
            F.floor(F.col("_need") / F.col("_n"))
            + F.when(F.col("hash_pos") < F.col("_need") % F.col("_n"), 1).otherwise(0),
        )
        .filter("_copies > 0").select("id", "label", "_copies")
    )
    near = nearest(points, k, "label")
    vectors = points.select("id", F.col("vec").alias("_to"))
    ways = near.join(vectors, "id").groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_to"))), lambda s: s["_to"])
        .alias("_ways")  # k vectors
    )
    base = shares.join(points.select("id", "vec"), "id").join(
        ways.withColumnRenamed("qid", "id"), "id"
    )
    chunks = base.withColumn(
        "_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"), F.lit(CHUNK).cast("bigint")))
    ).repartition("id", "_from")
    each = chunks.withColumn(
        "_i", F.explode(F.sequence("_from", F.least("_copies", F.col("_from") + CHUNK - 1)))
    )
    h = hash_key(seed, F.concat_ws("/", "id", "_i"))
    weight = hash_number(h) / F.lit(2.0**32)
    which = F.pmod(hash_number(F.substring(h, 9, 8)), F.size("_ways")).cast("int")
    # Drawn before the new `id` is named: inside a lambda, `id` would mean that null.
    drawn = each.withColumn("_weight", weight).withColumn("_way", F.get("_ways", which))
    made = drawn.select(
        F.lit(None).cast("bigint").alias("id"),
        F.zip_with("vec", "_way", lambda a, b: a + F.col("_weight") * (b - a)).alias("vec"),
        "label", F.lit(True).alias("synthetic"),
    )
    return points.select("id", "vec", "label", F.lit(False).alias("synthetic")).unionByName(made)
