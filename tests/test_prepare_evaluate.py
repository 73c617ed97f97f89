"""Preparation, evaluation and threshold rules on small tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chronotext.operators import bayes, distributions, evaluate, prepare, seeds, thresholds
from chronotext.operators.ordering import hash_rank


def test_impute(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 0.0, None), ("c", 3.0, None), ("d", 2.0, 0.0)],
                               "file_name string, the double, NCD_Order_1 double")
    rows = prepare.impute_max(df, ["the", "NCD_Order_1"]).orderBy("file_name").collect()
    assert [r.the for r in rows] == [3, 3, 3, 2]
    assert {r.NCD_Order_1 for r in rows} == {1.0}
    kept = prepare.impute_max(df, ["the"], zero_is_missing=False).orderBy("file_name").collect()
    assert [r.the for r in kept] == [3, 0, 3, 2]


def test_unseen_class_stops(spark):
    train = spark.createDataFrame([(1,), (3,)], "y0 int")
    classes = prepare.class_index(train, "y0")
    assert [r.y for r in prepare.label_encode(train, classes, "y0").orderBy("y0").collect()] == [0, 1]
    with pytest.raises(Exception, match="unseen class"):
        prepare.label_encode(spark.createDataFrame([(2,)], "y0 int"), classes, "y0").collect()


def test_hash_rank_is_whole_and_skew_safe(spark):
    rows = [(f"f{i}", 0 if i % 3 == 0 else i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "file_name string, s int")
    got = hash_rank(df, 1, "file_name", ["s"]).collect()
    for s in {r[1] for r in rows}:
        places = sorted(r.hash_pos for r in got if r.s == s)
        assert places == list(range(len(places)))
        assert {r.stratum_n for r in got if r.s == s} == {len(places)}
    again = {r.file_name: r.hash_pos for r in hash_rank(df.repartition(3), 1).collect()}
    assert sorted(again.values()) == list(range(500))
    assert again == {r.file_name: r.hash_pos for r in hash_rank(df, 1, prefix=1).collect()}


def predictions(n=300, k=4, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice([0.0, 0.1, 0.2, 0.5, rng.random()]) + 1e-9 for _ in range(k)]
        p = [round(v / sum(w), 6) for v in w]
        out.append((i, rng.randrange(k), p.index(max(p)), p))
    return out


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame(predictions(), "id int, y int, y_hat int, probs array<double>").withColumn(
        "g", F.lit("all"))


def pair_auc(scores, labels):
    pos = [s for s, l in zip(scores, labels) if l]
    neg = [s for s, l in zip(scores, labels) if not l]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def avg_precision(scores, labels):
    total, out, before = sum(labels), 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        chosen = [l for s, l in zip(scores, labels) if s >= t]
        out += (sum(chosen) / total - before) * sum(chosen) / len(chosen)
        before = sum(chosen) / total
    return out


def test_areas(pred):
    got = evaluate.probability_areas(pred, ["g"]).first()
    rows = predictions()
    aucs, aps = [], []
    for c in range(4):
        scores, labels = [r[3][c] for r in rows], [int(r[1] == c) for r in rows]
        aucs.append(pair_auc(scores, labels))
        aps.append(avg_precision(scores, labels))
    assert got.auc_roc == pytest.approx(sum(aucs) / 4)
    assert got.auprc == pytest.approx(sum(aps) / 4)


def test_area_null_and_ties(spark):
    h = spark.createDataFrame([("a", 0.5, 3, 3), ("b", 0.5, 2, 0)], "g string, score double, pos long, neg long")
    got = {r.g: r.auc for r in evaluate.curve_areas(h, ["g"]).collect()}
    assert got == {"a": 0.5, "b": None}


def test_counts(pred):
    rows = predictions()
    counted = evaluate.cells(pred, ["g"])
    assert evaluate.accuracy(counted, ["g"]).first().accuracy == pytest.approx(
        sum(r[1] == r[2] for r in rows) / len(rows))
    got = evaluate.precision_recall_f1(counted, ["g"]).first()
    f1 = []
    for c in range(4):
        tp = sum(r[1] == c == r[2] for r in rows)
        f1.append(2 * tp / (sum(r[1] == c for r in rows) + sum(r[2] == c for r in rows)))
    assert got.f1_macro == pytest.approx(sum(f1) / 4)
    assert evaluate.confusion_matrix(pred.withColumn("scale", F.lit(1)), ["scale", "g"], ["scale"]).agg(F.sum("n"), F.count("n")).first()[:] == (300, 16)


def test_topk_tie(spark):
    df = spark.createDataFrame([(0, [0.4, 0.4, 0.2]), (1, [0.4, 0.4, 0.2])], "y int, probs array<double>")
    got = [r.r for r in df.select(evaluate.true_rank(F.col("probs"), F.col("y")).alias("r")).collect()]
    assert got == [1, 0]


@pytest.mark.parametrize("top_k", [1, 2, 3, 4])
def test_vote_equals_definition(pred, top_k):
    got = {r.id: r.y_hat for r in thresholds.latest_newer_class(pred, top_k).collect()}
    for i, _, y_hat, p in predictions():
        top = sorted(range(4), key=lambda c: (p[c], c))[-top_k:]
        for t in range(1, 4):
            if top_k == 1:
                want = y_hat >= t
            else:
                want = sum(p[c] for c in sorted(top) if c >= t) > sum(p[c] for c in sorted(top) if c < t)
            assert (got[i] >= t) == want


def test_sweep(pred):
    got = {r.threshold: r for r in thresholds.binary_sweep(pred, ["g"], ["g"], 2, 9).collect()}
    assert sorted(got) == [1, 2]
    rows = predictions()
    for t, r in got.items():
        scores, labels = [round(sum(p[3][t:]), 9) for p in rows], [int(p[1] >= t) for p in rows]
        assert r.auc_roc == pytest.approx(pair_auc(scores, labels))
        assert r.pct_of_texts == pytest.approx(sum(p[1] <= t for p in rows) / len(rows))


def test_seed_statistics_of_one_run(spark):
    df = spark.createDataFrame([("s", "t", "d", "m", 1, "accuracy", 0.5)],
                               "feature_subset string, time_scale string, dataset string, model string, seed int, metric string, value double")
    r = seeds.seed_statistics(df).first()
    assert (r.mean, r["count"]) == (0.5, 1) and r.std is None and r.sem is None and r.ci_95_lower is None


def test_quantiles_in_narrowing_ranges(spark, monkeypatch):
    import numpy as np

    rng = random.Random(1)
    values = {"few": [rng.random() for _ in range(11)], "one": [2.0], "same": [3.5] * 50,
              "ties": [float(rng.choice([0, 0, 0, 1, 5, 9])) for _ in range(3000)],
              "many": [rng.gauss(0, 1) for _ in range(3000)],
              "outliers": [-1.7e308, 1.7e308] + [rng.random() * 1e-12 for _ in range(500)],
              "powers": [2.0 ** rng.randint(-300, 300) for _ in range(400)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(None, 1.0)], "k string, value double")
    shares = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}
    for slots in (4_096, 64):
        monkeypatch.setattr(distributions, "SLOTS", slots)
        got = {r.k: r for r in distributions.quantiles(df, ["k"], shares).collect()}
        assert set(got) == set(values)
        for k, r in got.items():
            want = np.quantile(values[k], list(shares.values()))
            assert [r.a, r.b, r.c, r.d] == pytest.approx(list(want), rel=1e-9, abs=0)


def test_quantiles_of_infinite_values_and_none(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", v) for v in (-inf, -inf, 1.0, 2.0, inf)] + [("b", v) for v in (1.0, 2.0, 3.0, nan)],
                               "k string, value double")
    got = {r.k: r for r in distributions.quantiles(df, ["k"], {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert (got["a"].lo, got["a"].mid, got["a"].hi) == (-inf, 1.0, inf)
    assert (got["b"].lo, got["b"].mid) == (1.0, 2.5) and got["b"].hi != got["b"].hi
    assert distributions.quantiles(df.limit(0), ["k"], {"mid": 0.5}).count() == 0


def test_a_round_of_quantiles_groups_by_slot_before_it_orders(spark):
    df = spark.range(100_000).selectExpr("id % 3 AS k", "CAST(hash(id) AS double) AS value")
    ends = df.groupBy("k").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).withColumn(
        "_at", F.array(F.struct(F.lit("q").alias("_q"), F.lit("a").alias("_side"), F.lit(10_000).cast("bigint").alias("_k"))))
    out = distributions._narrowed(df, ends, ["k"], True)
    below = {k: sum(v < lo for (v,) in df.filter(F.col("k") == k).select("value").collect())
             for k, lo in out.select("k", "_lo").collect()}
    for r in out.collect():
        assert r._at[0]._k + below[r.k] == 10_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window, aggregate = plan.index("Window "), plan.index("Aggregate [")
    assert window < aggregate  # printed from the top: slots are counted below the window


def test_naive_bayes_by_hand(spark):
    from math import exp, log, pi

    train = [(0, 1.0, 5.0), (0, 2.0, 6.0), (1, 4.0, 5.5), (1, 6.0, 7.0), (1, 5.0, 9.0)]
    df = spark.createDataFrame(train, "y int, a double, b double")
    packed = bayes.gnb_pack(bayes.gnb_fit(bayes.feature_moments(df, ["a", "b"])))
    got = bayes.gnb_score(df.limit(1), ["a", "b"], packed, ["y"]).first()

    def var(v):
        return sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)

    floor = 1e-9 * max(var([t[1] for t in train]), var([t[2] for t in train]))
    scores = []
    for c in (0, 1):
        rows = [t for t in train if t[0] == c]
        s = log(len(rows) / 5)
        for j, x in ((1, 1.0), (2, 5.0)):
            v = [t[j] for t in rows]
            s -= 0.5 * log(2 * pi * (var(v) + floor)) + (x - sum(v) / len(v)) ** 2 / (2 * (var(v) + floor))
        scores.append(s)
    assert got.probs[0] == pytest.approx(1 / (1 + exp(scores[1] - scores[0])))
