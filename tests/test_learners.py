"""Boosting, kernel machine, neighbour index, grid, importance of any model, model versions, densities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.operators import (
    bayes, boosting, classifiers, distributions, grid, kernel_machine, learners, model_store, neighbour_index, ordering, permutation,
)

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    data = []
    for i in range(400):
        y = i % 3
        a, b, c = draw.normal(size=3) + np.array([(0, 0, 0), (2.5, 0, 0), (0, 2.5, 0)][y])
        data.append((f"r{i}", "train" if i % 4 else "test", 1900 + y, float(round(a, 3)), float(b), float(c), y))
    return spark.createDataFrame(data, "file_name string, split string, year int, a double, b double, c double, y int").cache()


def parts(rows):
    return rows.filter("split = 'train'"), rows.filter("split <> 'train'")


def table(df):
    return df.orderBy("file_name").toPandas()


def plain_boosting(x, y, w, edges, rounds, depth, rate, l2, min_rows):
    """The same trees without Spark: every node searched over all cuts."""
    classes, bins = y.max() + 1, np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margins = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for k in range(classes):
            g = np.rint((p[:, k] - (y == k)) * w / boosting.STEP) * boosting.STEP
            h = np.rint(p[:, k] * (1 - p[:, k]) * w / boosting.STEP) * boosting.STEP
            groups = [np.arange(len(x))]
            for _ in range(depth):
                after = []
                for own in groups:
                    best, cut = 1e-12, None
                    for f in range(x.shape[1]):
                        for b in range(63):
                            left = own[bins[own, f] <= b]
                            right = own[bins[own, f] > b]
                            if len(left) < min_rows or len(right) < min_rows:
                                continue
                            gain = sum(s * g[i].sum() ** 2 / (h[i].sum() + l2) for s, i in ((1, left), (1, right), (-1, own)))
                            if gain > best + 1e-9:
                                best, cut = gain, (left, right)
                    after += list(cut) if cut else [own, own[:0]]
                groups = after
            for own in groups:
                if len(own):
                    step[own, k] = -rate * g[own].sum() / (h[own].sum() + l2)
        margins += step
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_boosting_equals_plain_trees(rows):
    train, _ = parts(rows)
    weighted = learners.with_weights(train, "y")
    model = boosting.fit(weighted, FEATURES, rounds=3, depth=2, every=2)
    got = table(boosting.score(model, weighted, ["file_name"]))
    own = table(weighted)
    want = plain_boosting(own[FEATURES].to_numpy(), own.y.to_numpy(), own.weight.to_numpy(), model.edges, 3, 2, 0.1, 1.0, 20)
    assert np.abs(np.array(got.probs.tolist()) - want).max() < 1e-9


@pytest.mark.parametrize("name,options", [("gnb", {}), ("random_forest", {}), ("boosting", {"rounds": 20}), ("kernel_svm", {"size": 64}), ("knn", {})])
def test_learners_learn(rows, name, options):
    train, test = parts(rows)
    got = table(classifiers.score(classifiers.fit(name, train, FEATURES, **options), test, ["file_name", "y"]))
    p = np.array(got.probs.tolist())
    assert (got.y == got.y_hat).mean() > 0.75 and np.allclose(p.sum(axis=1), 1) and p.shape[1] == 3
    assert set(got.columns) == {"file_name", "y", "probs", "y_hat"} and len(got) == 100


def test_forest_arrays_score_as_spark(rows):
    train, test = parts(rows)
    fitted = classifiers.fit("random_forest", train, FEATURES, 1, trees=5, depth=4)
    a, b = (table(classifiers.score(m, test, ["file_name"])) for m in (fitted, fitted.arrays()))
    assert np.allclose(np.array(a.probs.tolist()), np.array(b.probs.tolist()))


def test_fourier_features_approach_the_kernel(rows):
    fourier = kernel_machine.FourierMap.fit(rows, FEATURES, 4000, 7)
    x = np.array([[0.0, 0, 0], [1, 0.5, -1], [3, 2, 1]])
    z, s = fourier(x), (x - fourier.mean) / fourier.scale
    want = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / 3)
    assert np.abs(z @ z.T - want).max() < 0.06


def test_neighbours_equal_brute_force(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(700, 4))
    x[100:160] = x[0]  # copies of one vector
    q = np.concatenate([draw.normal(size=(60, 4)), x[:40]])
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(q)], "qid bigint, vec array<double>")
    got = neighbour_index.CellIndex.fit(points, 5).search(asked, 5).collect()
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, r + 1): int(j) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(x)), np.round(d[i], 9)))[:5])}
    assert {(r["qid"], r["rank"]): r["id"] for r in got} == want
    with pytest.raises(ValueError):
        neighbour_index.CellIndex("", 5).search(asked, 6)
    none = neighbour_index.CellIndex.fit(points.limit(0), 5)
    assert none.search(asked, 5).count() == 0
    few = neighbour_index.CellIndex.fit(points.limit(3), 5).search(asked.limit(2), 5)
    assert few.count() == 6


def test_hashed_neighbours_are_found(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 16)) + 4 * draw.normal(size=(30, 16))[np.arange(3000) % 30]
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    asked = points.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vec")
    index = neighbour_index.HashIndex.fit(points, 5)
    found = index.search(asked, 5, others=True)
    d = np.sqrt(((x[::20, None] - x[None]) ** 2).sum(axis=2))
    exact = [(20 * i, int(j)) for i, row in enumerate(d) for j in [j for j in np.argsort(row)[:6] if j != 20 * i][:5]]
    share = neighbour_index.recall(found, spark.createDataFrame(exact, "qid bigint, id bigint")).agg(F.avg("recall")).first()[0]
    assert share >= 0.9 and found.filter("qid = id").count() == 0
    assert index.probes < len(index.steps())  # it does not visit everything


def test_grid_continues(spark, rows, tmp_path):
    wanted = grid.cells({"gnb": {}, "kernel_svm": {"size": 8, "passes": 2}}, ["all", "two"], ["years"], [1, 2])
    subsets = {"all": FEATURES, "two": FEATURES[:2]}
    fit_cell = grid.fit_on(rows.drop("y"), subsets, {"years": "year"})
    calls = []

    def killed(cell):
        calls.append(cell)
        if cell.seed == 2 and cell.subset == "two":
            raise RuntimeError("killed")
        return fit_cell(cell)

    folder = str(tmp_path / "grid")
    with pytest.raises(RuntimeError, match="killed"):
        grid.run(spark, folder, wanted, killed)
    assert len(calls) == len(wanted) == 8 and len(grid.finished(spark, folder)) == 6
    (tmp_path / "grid" / "cells" / wanted[-1].key("")).mkdir(parents=True)  # what a killed writer may leave
    seen = []
    again = grid.run(spark, folder, wanted, lambda c: seen.append(c) or fit_cell(c))
    assert {(c.subset, c.seed) for c in seen} == {("two", 2)} and len(seen) == 2
    whole = grid.run(spark, str(tmp_path / "other"), wanted, fit_cell)
    columns = ["feature_subset", "time_scale", "model", "seed", "dataset", "file_name", "y", "y_hat"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert again.count() == 8 * 100


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_permutation_of_any_model(rows, block):
    train, test = parts(rows)
    model = classifiers.NaiveBayes.fit(train, FEATURES)
    got = table(permutation.permutation_importance(test, FEATURES, model.probabilities, 5, 3, block=block).withColumnRenamed("feature", "file_name"))
    order = ordering.hash_rank(test, 3).orderBy("hash_pos").toPandas()
    x, y = order[FEATURES].to_numpy(), order.y.to_numpy()
    hits = lambda m: (model.probabilities(m).argmax(axis=1) == y).mean()
    for f, name in enumerate(FEATURES):
        losses = []
        for r in range(1, 6):
            changed = x.copy()
            changed[:, f] = np.roll(x[:, f], -r)
            losses.append(hits(x) - hits(changed))
        row = got[got.file_name == name].iloc[0]
        assert math.isclose(row.importance_mean, np.mean(losses), abs_tol=1e-12)
        assert math.isclose(row.importance_std, np.std(losses), abs_tol=1e-12)


def test_model_versions(spark, rows, tmp_path):
    folder = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        model_store.newest(spark, folder)
    train, test = parts(rows)
    fitted = bayes.gnb_fit(bayes.feature_moments(train, FEATURES))
    assert model_store.publish(spark, folder, model_store.bayes_parts(fitted.limit(0))) == 1
    index = classifiers.Neighbours.fit(train, FEATURES).index
    tables, about = model_store.index_parts(spark, "near", index)
    forest = learners.random_forest(FEATURES, 3, 3).fit(learners.with_weights(train, "y"))
    assert model_store.publish(spark, folder, {**model_store.bayes_parts(fitted), **tables, "forest": forest}, about) == 2
    fitted.limit(1).write.parquet(f"{folder}/version=3/bayes")  # without a manifest
    held = model_store.newest(spark, folder)
    assert held.number == 2 and held.table(spark, "bayes").count() == 9
    asked = test.select(F.xxhash64("file_name").alias("qid"), boosting.vector(FEATURES).alias("vec"))
    assert held.index("near").search(asked, 5).exceptAll(index.search(asked, 5)).count() == 0
    assert held.pipeline("forest").transform(test).count() == 100
    assert model_store.publish(spark, folder, model_store.bayes_parts(fitted)) == 3 and model_store.newest(spark, folder).number == 3


def test_densities_integrate_to_one(spark):
    draw = np.random.default_rng(6)
    data = [("x", g, float(v)) for g, values in ((1, draw.normal(size=500)), (2, [3.0]), (3, [1.0] * 9)) for v in values]
    got = distributions.violin_density(spark.createDataFrame(data, "feature string, g int, value double"), ["feature", "g"]).toPandas()
    for g, own in got.groupby("g"):
        own = own.sort_values("cell")
        assert len(own) == distributions.CELLS and math.isclose((own.density * np.diff(own["value"]).mean()).sum(), 1.0, rel_tol=1e-9)
    own = got[got.g == 1].sort_values("cell")
    values = np.array([v for _, g, v in data if g == 1])
    h = values.std(ddof=1) * len(values) ** -0.2
    want = np.exp(-0.5 * ((own["value"].to_numpy()[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert np.abs(own.density - want).max() < 0.02


def test_first_in_order_is_the_head_of_the_ranking(spark):
    rows = spark.range(5000).select(F.concat(F.lit("d"), "id").alias("file_name"), (F.col("id") % 7 * F.when(F.col("id") < 4000, 0).otherwise(1)).alias("s"))
    got = ordering.first_in_order(rows, 5, "file_name", ["s"], lambda n: F.floor(n * 0.3))
    want = ordering.hash_rank(rows, 5, "file_name", ["s"]).filter("hash_pos < floor(stratum_n * 0.3)").select("file_name", "s")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_repeated_rows_hide_no_neighbour(spark):
    """A row given three times is one of the k nearest, not three of them."""
    rows = [(i, [float(i), 0.0]) for i in range(12)] * 3
    points = spark.createDataFrame(rows, "id bigint, vec array<double>")
    asked = spark.createDataFrame([(0, [0.2, 0.0])], "qid bigint, vec array<double>")
    got = neighbour_index.CellIndex.fit(points, 4).search(asked, 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3]


def test_cells_read_the_class_numbers_as_stored(spark, rows):
    fit_cell = grid.fit_on(rows.drop("y"), {"all": FEATURES}, {"years": "year"})
    found = fit_cell(grid.Cell("gnb", "all", "years", 1))
    assert "Window" not in found._jdf.queryExecution().toString()  # the classes are not numbered again
    coded = rows.select("file_name", "y").toDF("file_name", "own")
    assert found.join(coded, "file_name").filter("y <> own").count() == 0


def test_targets_of_a_grid_share_one_neighbour_search(spark, rows, monkeypatch):
    table = rows.drop("y").withColumn("half", (F.col("year") / 2).cast("int"))
    targets, searches, search = {"years": "year", "halves": "half"}, [], neighbour_index.CellIndex.search
    monkeypatch.setattr(neighbour_index.CellIndex, "search", lambda self, *a: searches.append(1) or search(self, *a))
    shared = grid.fit_on(table, {"all": FEATURES, "two": FEATURES[:2]}, targets)
    columns = ["dataset", "file_name", "y", "y_hat", F.transform("probs", lambda p: F.round(p, 9))]
    for scale in targets:
        got = shared(grid.Cell("knn", "all", scale, 1, (("k", 4),))).select(*columns).collect()
        alone = grid.fit_on(table, {"all": FEATURES}, {scale: targets[scale]})
        want = alone(grid.Cell("knn", "all", scale, 1, (("k", 4),))).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 100
    assert len(searches) == 3  # one for both targets, and one for each grid of a single target
    shared(grid.Cell("knn", "two", "years", 1, (("k", 4),)))
    shared(grid.Cell("knn", "all", "years", 1, (("k", 3),)))
    assert len(searches) == 5  # other features and other options are searched on their own
