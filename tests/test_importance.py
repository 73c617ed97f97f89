"""Identities of the component tables and of resampled points."""

import numpy as np
import pytest

from chronotext.operators import importance, neighbours

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4)) * [1, 10, 0.1, 3]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in FEATURES)), x


def test_components_rebuild_the_correlations(table):
    frame, x = table
    found = importance.pca_tables(frame, FEATURES)
    cells = {(r["feature"], r["component"]): r["loading"] for r in found["loadings"].collect()}
    loadings = np.array([[cells[f, j + 1] for j in range(4)] for f in FEATURES])
    assert np.allclose(loadings.T @ loadings, np.eye(4), atol=1e-8)
    ratios = [r["explained_variance_ratio"] for r in found["variance"].orderBy("component").collect()]
    assert sum(ratios) == pytest.approx(1) and ratios == sorted(ratios, reverse=True)
    assert np.allclose(loadings @ np.diag(ratios) @ loadings.T * 4, np.corrcoef(x.T), atol=1e-8)
    mean = {r["feature"]: r["mean_abs_loading"] for r in found["contribution"].collect()}
    assert all(mean[f] == pytest.approx(np.abs(loadings[i]).mean()) for i, f in enumerate(FEATURES))


def test_resampled_points_lie_between_points_of_their_class(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3)], 0 if i < 30 else 1 if i < 42 else 2) for i in range(50)]
    points = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    made = neighbours.smote(points, k=3).collect()
    counts = {y: sum(r["label"] == y for r in made) for y in range(3)}
    assert set(counts.values()) == {30}
    for r in made:
        own = np.array([v for _, v, y in rows if y == r["label"]])
        p = np.array(r["vec"])
        gaps = [np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a in own for b in own]
        assert min(gaps) < 1e-9
