"""Models, evaluation and old/new thresholds over the cleaned feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators import bayes, evaluate, thresholds
from chronotext.plans import views as V
from chronotext.plans.registry import cte, query, rounded, stored
from chronotext.plans.text_queries import name

DIGITS = 9  # stored precision of probabilities
SUBSETS = {**V.MODEL_SUBSETS, "main": V.MAIN_FEATURES}
KEYS = ["feature_subset", "time_scale", "dataset", "model"]
TOP_K = {"decades": 10, "centuries": 1}
KS = [2, 3, 5, 10]


def moments(spark, sf_dir) -> DataFrame:
    """Moments per time scale, class and feature of the training set."""
    train = V.model_table(spark, sf_dir).filter("split = 'train'")
    scaled = train.withColumn("s", F.explode(F.array(*[
        F.struct(F.lit(s).alias("time_scale"), F.col(f"y_{s}").cast("int").alias("y")) for s in V.TARGETS
    ]))).select("*", "s.time_scale", "s.y")
    return bayes.feature_moments(scaled, V.MODEL_FEATURES, "y", ["time_scale"])


def fitted(spark, sf_dir) -> DataFrame:
    """Parameters of one model per feature subset and time scale."""
    member = F.array_compact(F.array(*[
        F.when(F.col("feature").isin(names), F.lit(s)) for s, names in SUBSETS.items()
    ]))
    by_subset = moments(spark, sf_dir).withColumn("feature_subset", F.explode(member))
    return bayes.gnb_fit(by_subset, ["feature_subset", "time_scale"])


def predictions(spark, sf_dir) -> DataFrame:
    """Every subset's and time scale's prediction for each document not in training."""
    def build():
        cases = F.explode(F.array(*[
            F.struct(F.lit(s).alias("time_scale"), F.col(f"y_{s}").cast("int").alias("y")) for s in V.TARGETS
        ]))
        rows = (
            V.model_table(spark, sf_dir).filter("split <> 'train'")
            .withColumn("c", cases).withColumn("feature_subset", F.explode(F.array(*map(F.lit, SUBSETS))))
            .select("*", F.col("split").alias("dataset"), "c.time_scale", "c.y")
        )
        keys = ["feature_subset", "time_scale"]
        packed = bayes.gnb_pack(fitted(spark, sf_dir), keys)
        scored = bayes.gnb_score(
            rows, V.MODEL_FEATURES, packed, ["file_name", "dataset", "y"], keys, DIGITS
        )
        return scored.withColumn("model", F.lit("gnb"))

    return stored(spark, sf_dir, "predictions", build)


def main_predictions(spark, sf_dir) -> DataFrame:
    return predictions(spark, sf_dir).filter("feature_subset = 'main'").drop("feature_subset", "model")


def baseline(spark, sf_dir, seed: int = V.SEED) -> DataFrame:
    """Seeded random draws for both time scales, without probabilities."""
    rows = main_predictions(spark, sf_dir).select("file_name", "dataset", "time_scale", "y")
    drawn = thresholds.random_baseline(rows, ["time_scale", "dataset"], seed)
    return drawn.withColumn("probs", F.lit(None).cast("array<double>"))


def all_predictions(spark, sf_dir) -> DataFrame:
    """Model and baseline, the baseline repeated beside each subset."""
    random = baseline(spark, sf_dir).withColumn("model", F.lit("random")).withColumn(
        "feature_subset", F.explode(F.array(*map(F.lit, SUBSETS)))
    )
    return predictions(spark, sf_dir).unionByName(random)


# --- SQL of the model --------------------------------------------------------------

cte("feat", " UNION ALL ".join(
    f"SELECT file_name, split, y_decades, y_centuries, '{c.replace(chr(39), chr(39) * 2)}' AS feature, {name(c)} AS x FROM model_table"
    for c in V.MODEL_FEATURES), ("model_table",))
cte("scales", "SELECT * FROM (VALUES ('decades'), ('centuries')) v(time_scale)")
cte("subsets", "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{f}')" for s, names in SUBSETS.items() for f in names) + ") v(feature_subset, feature)")
cte("moments", """
SELECT time_scale, CASE time_scale WHEN 'decades' THEN y_decades ELSE y_centuries END AS y, feature,
  count(*) AS n, avg(x) AS mean, var_pop(x) AS var
FROM feat CROSS JOIN scales WHERE split = 'train' GROUP BY ALL""", ("feat", "scales"))
cte("params", """
SELECT s.feature_subset, m.time_scale, m.y, m.feature, m.mean, m.var + f.e AS var,
  m.n::DOUBLE / (SELECT count(*) FROM model_table WHERE split = 'train') AS prior
FROM moments m JOIN subsets s USING (feature)
JOIN (SELECT feature_subset, 1e-9::DOUBLE * max(v) AS e FROM subsets JOIN (
  SELECT feature, var_pop(x) AS v FROM feat WHERE split = 'train' GROUP BY feature) USING (feature)
  GROUP BY feature_subset) f USING (feature_subset)""", ("moments", "subsets", "feat", "model_table"))
cte("class_scores", """
SELECT p.feature_subset, p.time_scale, split AS dataset, file_name,
  CASE p.time_scale WHEN 'decades' THEN y_decades ELSE y_centuries END AS y, p.y AS c,
  ln(any_value(prior)) - 0.5::DOUBLE * sum(ln(2::DOUBLE * pi() * var) + (x - mean) * (x - mean) / var) AS s
FROM feat JOIN params p USING (feature) WHERE split <> 'train' GROUP BY ALL""", ("feat", "params"))
cte("probs", f"""
SELECT feature_subset, time_scale, dataset, file_name, y, c,
  round(exp(s - top) / sum(exp(s - top)) OVER w, {DIGITS}) AS p, s
FROM (SELECT *, max(s) OVER (PARTITION BY feature_subset, time_scale, file_name) AS top FROM class_scores)
WINDOW w AS (PARTITION BY feature_subset, time_scale, file_name)""", ("class_scores",))
cte("pred", """
SELECT feature_subset, time_scale, dataset, 'gnb' AS model, file_name, y, arg_max(c, (s, -c)) AS y_hat
FROM probs GROUP BY feature_subset, time_scale, dataset, file_name, y""", ("probs",))
cte("present", """
SELECT time_scale, dataset, list_sort(list(DISTINCT y)) AS ys FROM pred GROUP BY time_scale, dataset""", ("pred",))


def draw(seed: str) -> str:
    return f"('0x' || substr(md5({seed} || ':' || file_name), 1, 8))::BIGINT"


cte("drawn", f"""
SELECT p.time_scale, p.dataset, file_name, y, ys[({draw(f"'{V.SEED}'")} % len(ys)) + 1] AS y_hat
FROM pred p JOIN present USING (time_scale, dataset) WHERE feature_subset = 'main'""", ("pred", "present"))
cte("all_pred", """
SELECT feature_subset, time_scale, dataset, model, file_name, y, y_hat FROM pred
UNION ALL SELECT s.feature_subset, time_scale, dataset, 'random', file_name, y, y_hat FROM drawn
CROSS JOIN (SELECT DISTINCT feature_subset FROM subsets) s""", ("pred", "drawn", "subsets"))


def metric_ctes(prefix: str, source: str, keys: list[str], deps: tuple[str, ...]) -> None:
    """Confusion cells, class counts and the metrics built on them."""
    k = ", ".join(keys)
    cte(f"{prefix}_cells", f"SELECT {k}, y, y_hat, count(*) AS n FROM {source} GROUP BY ALL", deps)
    cte(f"{prefix}_class", f"""
SELECT {k}, c, sum(tp)::DOUBLE AS tp, sum(sup)::DOUBLE AS sup, sum(prd)::DOUBLE AS prd FROM (
  SELECT {k}, y AS c, CASE WHEN y = y_hat THEN n ELSE 0 END AS tp, n AS sup, 0 AS prd FROM {prefix}_cells
  UNION ALL SELECT {k}, y_hat, 0, 0, n FROM {prefix}_cells) GROUP BY {k}, c""", (f"{prefix}_cells",))
    parts = {
        "precision": "CASE WHEN prd > 0 THEN tp / prd ELSE 0 END",
        "recall": "CASE WHEN sup > 0 THEN tp / sup ELSE 0 END",
        "f1": "CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END",
    }
    cte(f"{prefix}_prf", f"SELECT {k}, " + ", ".join(
        f"avg({e}) AS {m}_macro, sum(({e}) * sup) / sum(sup) AS {m}_weighted" for m, e in parts.items()
    ) + f" FROM {prefix}_class GROUP BY {k}", (f"{prefix}_class",))
    cte(f"{prefix}_acc", f"""
SELECT {k}, sum(CASE WHEN y = y_hat THEN n ELSE 0 END)::DOUBLE / sum(n) AS accuracy FROM {prefix}_cells GROUP BY {k}""",
        (f"{prefix}_cells",))
    cte(f"{prefix}_ord", f"""
SELECT {k}, sqrt(res / t) AS rmse, a / t AS mae,
  CASE WHEN ss - s * s / t > 0 THEN 1 - res / (ss - s * s / t) WHEN res = 0 THEN 1 ELSE 0 END AS r2
FROM (SELECT {k}, sum(n)::DOUBLE AS t, sum(n * (y - y_hat) * (y - y_hat))::DOUBLE AS res,
  sum(n * abs(y - y_hat))::DOUBLE AS a, sum(n * y)::DOUBLE AS s, sum(n * y * y)::DOUBLE AS ss
  FROM {prefix}_cells GROUP BY {k})""", (f"{prefix}_cells",))


def areas_sql(hist: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""
SELECT {k}, CASE WHEN pp > 0 AND nn > 0 THEN sum(pos * (below + neg / 2)) / (pp * nn) END AS auc,
  CASE WHEN pp > 0 THEN sum(CASE WHEN pos > 0 THEN pos * (tp / (tp + fp)) ELSE 0 END) / pp ELSE 0 END AS ap, pp, nn
FROM (SELECT {k}, pos, neg, sum(neg) OVER (PARTITION BY {k} ORDER BY score) - neg AS below,
  sum(pos) OVER (PARTITION BY {k} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY score DESC) AS fp,
  sum(pos) OVER (PARTITION BY {k}) AS pp, sum(neg) OVER (PARTITION BY {k}) AS nn
  FROM {hist}) GROUP BY {k}, pp, nn"""


PLACE = ["feature_subset", "time_scale", "dataset"]
metric_ctes("m", "all_pred", KEYS, ("all_pred",))
cte("class_hist", """
SELECT feature_subset, time_scale, dataset, c, p AS score, sum((y = c)::INTEGER)::DOUBLE AS pos,
  sum((y <> c)::INTEGER)::DOUBLE AS neg FROM probs GROUP BY ALL""", ("probs",))
cte("class_areas", areas_sql("class_hist", [*PLACE, "c"]), ("class_hist",))
cte("prob_areas", f"""
SELECT {', '.join(PLACE)}, 'gnb' AS model, CASE WHEN count(auc) = count(*) THEN avg(auc) END AS auc_roc,
  CASE WHEN count(auc) = count(*) THEN avg(ap) END AS auprc FROM class_areas GROUP BY {', '.join(PLACE)}""", ("class_areas",))
cte("true_rank", """
SELECT a.feature_subset, a.time_scale, a.dataset, a.file_name,
  sum((a.p > b.p OR (a.p = b.p AND a.c > b.c))::INTEGER) AS r
FROM probs a JOIN (SELECT * FROM probs WHERE c = y) b USING (feature_subset, time_scale, file_name) GROUP BY ALL""", ("probs",))
cte("topk", f"SELECT {', '.join(PLACE)}, 'gnb' AS model, " + ", ".join(
    f"avg((r < {k})::INTEGER::DOUBLE) AS top{k}_accuracy" for k in KS
) + f" FROM true_rank GROUP BY {', '.join(PLACE)}", ("true_rank",))
METRICS = (["accuracy"] + [f"{m}_{a}" for a in ("macro", "weighted") for m in ("f1", "recall", "precision")]
           + ["rmse", "mae", "r2", "auc_roc", "auprc"] + [f"top{k}_accuracy" for k in KS])
K = ", ".join(KEYS)
cte("report", f"""
SELECT {K}, {', '.join(METRICS)} FROM m_acc JOIN m_prf USING ({K}) JOIN m_ord USING ({K})
LEFT JOIN prob_areas USING ({K}) LEFT JOIN topk USING ({K})""", ("m_acc", "m_prf", "m_ord", "prob_areas", "topk"))


def rr(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


# --- E: naive Bayes, baseline ------------------------------------------------------


@query("gnb_fit", """
SELECT feature_subset, time_scale, y, feature, round(prior, 6) + 0.0 AS prior, round(mean, 6) + 0.0 AS mean,
  round(var, 6) + 0.0 AS var FROM params""", ("params",))
def gnb_fit(spark, sf_dir):
    return rounded(fitted(spark, sf_dir).drop("pos"))


@query("gnb_score", f"""
SELECT feature_subset, file_name, time_scale, dataset, any_value(probs.y) AS y, max(y_hat) AS y_hat,
  round(max(p), 6) + 0.0 AS p_max, round(max(CASE WHEN c = probs.y THEN p END), 6) + 0.0 AS p_true
FROM probs JOIN pred USING (feature_subset, time_scale, dataset, file_name)
GROUP BY feature_subset, file_name, time_scale, dataset""", ("probs", "pred"))
def gnb_score(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select(
        "feature_subset", "file_name", "time_scale", "dataset", "y", "y_hat", F.array_max("probs").alias("p_max"),
        F.get("probs", F.col("y")).alias("p_true"),
    ))


@query("random_baseline", "SELECT file_name, time_scale, dataset, y, y_hat FROM drawn", ("drawn",))
def random_baseline(spark, sf_dir):
    return rounded(baseline(spark, sf_dir).drop("probs"))


# --- F: multi-class evaluation -------------------------------------------------------

BY = ["time_scale", "dataset"]


cte("seen_classes", "SELECT time_scale, y FROM pred UNION SELECT time_scale, y_hat FROM pred", ("pred",))


@query("confusion_matrix", f"""
SELECT g.feature_subset, g.time_scale, g.dataset, a.y, b.y AS y_hat, coalesce(n, 0) AS n
FROM (SELECT DISTINCT feature_subset, time_scale, dataset FROM pred) g
JOIN seen_classes a ON a.time_scale = g.time_scale JOIN seen_classes b ON b.time_scale = g.time_scale
LEFT JOIN (SELECT * FROM m_cells WHERE model = 'gnb') c ON c.feature_subset = g.feature_subset
  AND c.time_scale = g.time_scale AND c.dataset = g.dataset AND c.y = a.y AND c.y_hat = b.y""", ("m_cells", "pred", "seen_classes"))
def confusion_matrix(spark, sf_dir):
    return rounded(evaluate.confusion_matrix(predictions(spark, sf_dir), PLACE, ["time_scale"]))


def _register_metrics(key: str, columns: list[str], source: str, fn) -> None:
    @query(key, f"SELECT {K}, {rr(*columns)} FROM {source} WHERE model = 'gnb'", (source,))
    def run(spark, sf_dir):
        return rounded(fn(predictions(spark, sf_dir)).select(*KEYS, *columns))


PRF = [f"{m}_{a}" for a in ("macro", "weighted") for m in ("f1", "recall", "precision")]
_register_metrics("accuracy", ["accuracy"], "m_acc", lambda p: evaluate.accuracy(evaluate.cells(p, KEYS), KEYS))
_register_metrics("precision_recall_f1", PRF, "m_prf",
                  lambda p: evaluate.precision_recall_f1(evaluate.cells(p, KEYS), KEYS))
_register_metrics("ordinal_errors", ["rmse", "mae", "r2"], "m_ord",
                  lambda p: evaluate.ordinal_errors(evaluate.cells(p, KEYS), KEYS))
_register_metrics("auc_roc_ovr_macro", ["auc_roc"], "prob_areas", lambda p: evaluate.probability_areas(p, KEYS))
_register_metrics("auprc_macro", ["auprc"], "prob_areas", lambda p: evaluate.probability_areas(p, KEYS))
_register_metrics("topk_accuracy", [f"top{k}_accuracy" for k in KS], "topk",
                  lambda p: evaluate.topk_accuracy(p, KEYS, KS))
_register_metrics("evaluation_report", METRICS, "report", lambda p: evaluate.evaluation_report(p, KEYS, KS))


@query("prediction_distribution", f"""
SELECT {K}, y_hat, sum(n)::BIGINT AS n FROM m_cells WHERE model = 'gnb' GROUP BY {K}, y_hat""", ("m_cells",))
def prediction_distribution(spark, sf_dir):
    return rounded(evaluate.prediction_distribution(evaluate.cells(predictions(spark, sf_dir), KEYS), KEYS))


# --- G: thresholds -------------------------------------------------------------------

cte("grid", """
SELECT time_scale, dataset, unnest(ys[2 : len(ys) - 1]) AS threshold FROM present""", ("present",))
cte("top_classes", """
SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY feature_subset, time_scale, file_name ORDER BY p DESC, c DESC) AS r FROM probs)
WHERE r <= CASE time_scale WHEN 'decades' THEN 10 ELSE 1 END""", ("probs",))
# A vote of one class is the prediction itself.
cte("votes", f"""
SELECT feature_subset, time_scale, dataset, 'gnb' AS model, file_name, y, threshold,
  sum(CASE WHEN c >= threshold THEN p ELSE 0 END) > sum(CASE WHEN c < threshold THEN p ELSE 0 END) AS newer
FROM top_classes JOIN grid USING (time_scale, dataset) WHERE time_scale = 'decades' GROUP BY ALL
UNION ALL SELECT feature_subset, time_scale, dataset, model, file_name, y, threshold, y_hat >= threshold
FROM all_pred JOIN grid USING (time_scale, dataset) WHERE time_scale = 'centuries' OR model = 'random'""",
    ("top_classes", "grid", "all_pred"))
cte("votes01", """
SELECT feature_subset, time_scale, dataset, model, threshold, (y >= threshold)::INTEGER AS y, newer::INTEGER AS y_hat FROM votes""",
    ("votes",))
BKEYS = [*KEYS, "threshold"]
metric_ctes("b", "votes01", BKEYS, ("votes01",))
cte("bscore", f"""
SELECT feature_subset, time_scale, dataset, 'gnb' AS model, file_name, threshold, (any_value(y) >= threshold)::INTEGER AS y,
  round(sum(CASE WHEN c >= threshold THEN p ELSE 0 END), {DIGITS}) AS score
FROM probs JOIN grid USING (time_scale, dataset) GROUP BY feature_subset, time_scale, dataset, file_name, threshold
UNION ALL SELECT feature_subset, time_scale, dataset, model, file_name, threshold, (y >= threshold)::INTEGER,
  (y_hat >= threshold)::INTEGER::DOUBLE FROM all_pred JOIN grid USING (time_scale, dataset) WHERE model = 'random'""",
    ("probs", "grid", "all_pred"))
cte("bhist", f"""
SELECT {', '.join(BKEYS)}, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM bscore GROUP BY ALL""", ("bscore",))
cte("bareas", areas_sql("bhist", BKEYS), ("bhist",))
cte("bpct", f"""
SELECT {', '.join(BKEYS)}, avg((y <= threshold)::INTEGER::DOUBLE) AS pct_of_texts FROM votes GROUP BY ALL""", ("votes",))
BK = ", ".join(BKEYS)
BMETRICS = ["accuracy", "auc_roc", "auprc", *PRF, "pct_of_texts"]
cte("binary_results", f"""
SELECT {BK}, accuracy, CASE WHEN pp > 0 AND nn > 0 THEN auc END AS auc_roc, CASE WHEN pp > 0 AND nn > 0 THEN ap END AS auprc,
  {', '.join(PRF)}, pct_of_texts
FROM b_acc JOIN b_prf USING ({BK}) JOIN bareas USING ({BK}) JOIN bpct USING ({BK})""", ("b_acc", "b_prf", "bareas", "bpct"))


@query("threshold_grid", "SELECT time_scale, dataset, threshold FROM grid", ("grid",))
def threshold_grid(spark, sf_dir):
    grid = thresholds.threshold_grid(main_predictions(spark, sf_dir), BY)
    return rounded(grid.select(*BY, F.explode("thresholds").alias("threshold")))


@query("binary_argmax", f"""
SELECT {K}, threshold, (y >= threshold)::INTEGER::BIGINT AS y, (y_hat >= threshold)::INTEGER::BIGINT AS y_hat, count(*) AS n
FROM all_pred JOIN grid USING (time_scale, dataset) GROUP BY ALL""", ("all_pred", "grid"))
def binary_argmax(spark, sf_dir):
    return rounded(_per_scale(spark, sf_dir, lambda pred, k: _cells_of(pred, 1)))


@query("binary_topk_vote", f"""
SELECT {K}, threshold, (y >= threshold)::INTEGER::BIGINT AS y, newer::INTEGER::BIGINT AS y_hat, count(*) AS n FROM votes
WHERE model = 'gnb' GROUP BY ALL""", ("votes",))
def binary_topk_vote(spark, sf_dir):
    """The vote of the model; the baseline has no probabilities to vote with."""
    return rounded(_per_scale(spark, sf_dir, lambda pred, k: _cells_of(pred.filter("model = 'gnb'"), k)))


@query("binary_confusion", """
SELECT feature_subset, time_scale, dataset, model, threshold, y::BIGINT AS y, y_hat::BIGINT AS y_hat, n FROM b_cells""", ("b_cells",))
def binary_confusion(spark, sf_dir):
    return rounded(_per_scale(spark, sf_dir, lambda pred, k: _cells_of(pred, k)))


def _cells_of(pred: DataFrame, top_k: int) -> DataFrame:
    grid = thresholds.threshold_grid(pred, ["dataset"])
    has = F.col("probs").isNotNull()
    voted = thresholds.latest_newer_class(pred.filter(has), top_k).unionByName(pred.filter(~has))
    return thresholds.binary_cells(evaluate.cells(voted, KEYS), grid, KEYS, ["dataset"])


def _per_scale(spark, sf_dir, fn) -> DataFrame:
    everything = all_predictions(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        fn(everything.filter(F.col("time_scale") == s), k) for s, k in TOP_K.items()
    ])


@query("binary_score", f"""
SELECT {K}, file_name, threshold, y::BIGINT AS y, score + 0.0 AS score FROM bscore""", ("bscore",))
def binary_score(spark, sf_dir):
    def score(pred: DataFrame, k: int) -> DataFrame:
        grid = thresholds.threshold_grid(pred, ["dataset"])
        return thresholds.binary_scores(pred, grid, KEYS, ["dataset"], DIGITS, ["file_name"])

    # Sums of numbers of DIGITS places: rounding them further would only make ties.
    return rounded(_per_scale(spark, sf_dir, score), DIGITS)


@query("pct_of_texts", f"SELECT {K}, threshold, round(pct_of_texts, 6) + 0.0 AS pct_of_texts FROM bpct", ("bpct",))
def pct_of_texts(spark, sf_dir):
    def share(pred: DataFrame, k: int) -> DataFrame:
        grid = thresholds.threshold_grid(pred, ["dataset"])
        return thresholds.pct_of_texts(evaluate.cells(pred, KEYS), grid, KEYS, ["dataset"])

    return rounded(_per_scale(spark, sf_dir, share))


@query("binary_metrics", f"SELECT {BK}, {rr(*BMETRICS)} FROM binary_results WHERE model = 'gnb'", ("binary_results",))
def binary_metrics(spark, sf_dir):
    """The model's own metrics, computed from its predictions alone."""
    def sweep(pred: DataFrame, k: int) -> DataFrame:
        return thresholds.binary_sweep(pred.filter("model = 'gnb'"), KEYS, ["dataset"], k, DIGITS)

    return rounded(_per_scale(spark, sf_dir, sweep).select(*BKEYS, *BMETRICS))


def binary_results(spark, sf_dir) -> DataFrame:
    def build():
        return _per_scale(spark, sf_dir, lambda pred, k: thresholds.binary_sweep(
            pred, KEYS, ["dataset"], k, DIGITS
        )).select(*BKEYS, *BMETRICS)

    return stored(spark, sf_dir, "binary_results", build)


@query("binary_sweep", f"SELECT {BK}, {rr(*BMETRICS)} FROM binary_results", ("binary_results",))
def binary_sweep(spark, sf_dir):
    return rounded(binary_results(spark, sf_dir))
