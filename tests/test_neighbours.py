"""Neighbour search, Tomek links and oversampling against brute force."""

import random

import numpy as np
import pytest

from chronotext.operators import neighbours as N


def cloud(n=400, dims=3, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            vec = [1.0] * dims  # a third of all rows is one and the same vector
        else:
            vec = [round(rng.gauss(rng.choice([0, 4]), 1), 3) for _ in range(dims)]
        out.append((i, vec, 0 if i % 4 else i % 3))
    return out


def brute(points, k, group=None):
    out = {}
    for i, v, g in points:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j)
                   for j, w, h in points if j != i and (group is None or g == h))
        out[i] = d[:k]
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(cloud(), "id long, vec array<double>, label int")


@pytest.mark.parametrize("block,group", [(4096, None), (16, None), (16, "label")])
def test_nearest(points, monkeypatch, block, group):
    monkeypatch.setattr(N, "BLOCK", block)
    want = brute(cloud(), 4, group)
    got = {}
    for r in N.nearest(points, 4, group).collect():
        got.setdefault(r.qid, []).append((r.rank, r.dist, r.id))
    assert set(got) == {i for i, near in want.items() if near}
    for i, found in got.items():
        found.sort()
        assert [f[2] for f in found] == [j for _, j in want[i]]
        assert [f[1] for f in found] == pytest.approx([d for d, _ in want[i]], abs=1e-9)


def test_smote_balances_between_neighbours(points):
    rows = N.smote(points, k=3).collect()
    counts = {}
    for r in rows:
        counts[r.label] = counts.get(r.label, 0) + 1
    assert len(set(counts.values())) == 1
    for label in counts:
        own = np.array([v for _, v, g in cloud() if g == label])
        for r in rows:
            if r.label == label and r.synthetic:
                v = np.array(r.vec)
                assert (v >= own.min(0) - 1e-9).all() and (v <= own.max(0) + 1e-9).all()
    again = sorted((r.label, tuple(r.vec)) for r in N.smote(points.repartition(3), k=3).collect())
    assert again == sorted((r.label, tuple(r.vec)) for r in rows)


def test_smote_draws_a_weight_for_each_point(spark):
    """Two points of a class lie on a line, so what is made shows its weight."""
    rows = [(i, [float(i % 7), 100.0 + i], 0) for i in range(40)] + [(100 + i, [float(i), 0.0], 1) for i in range(2)]
    points = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    made = [r["vec"] for r in N.smote(points, 1).filter("synthetic").collect()]
    assert len(made) == 38 and all(0 <= x <= 1 and y == 0 for x, y in made)
    assert len({round(min(x, 1 - x), 9) for x, _ in made}) == 38


def test_a_block_is_measured_in_slices():
    """All points of a block are wanted by all queries, and most lie equally far: what is held stays small."""
    import tracemalloc

    import pandas as pd

    n, m = 4_000, 6_000
    queries = pd.DataFrame({"grp": 0, "qid": range(n), "vec": [np.zeros(4)] * n, "bound": np.inf, "cells": [np.arange(2)] * n})
    points = pd.DataFrame({"cell": [i % 2 for i in range(m)], "id": range(m), "vec": [np.eye(4)[i % 4] for i in range(m)]})
    tracemalloc.start()
    found = N._nearest_visited(queries, points, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.groupby("qid")["id"].apply(list).tolist() == [[0, 1, 2]] * n
    assert peak < 150e6  # all distances of this block at once are 192 MB, several times over


def test_a_query_travels_once_to_a_zone(monkeypatch):
    """All cells are wanted: a vector is copied for each zone, not for each cell."""
    import pandas as pd

    rng = np.random.default_rng(1)
    pivots, rows = rng.normal(size=(200, 4)), rng.normal(size=(50, 4))
    monkeypatch.setattr(N, "BLOCK", 1_000)
    cells = N.Cells(pivots, np.arange(200), np.full(200, 10), np.zeros(200), np.full(200, 99.0))
    asked = pd.DataFrame({"qid": range(50), "vec": list(rows), "bound": 99.0})
    made = pd.concat(cells.visits(0, asked, 5, False))
    assert len(made) == 50 * 2 and made["cells"].map(len).sum() == 50 * 199
