"""Multi-seed statistics and comparison of the stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators import comparison, evaluate, seeds, thresholds
from chronotext.plans import model_queries as M
from chronotext.plans import views as V
from chronotext.plans.registry import cte, query, rounded, stored

SEEDS = list(range(42, 52))
MODELS = ["gnb", "random"]
KEYS = M.KEYS
RANDOM_METRICS = ["accuracy", *M.PRF, "rmse", "mae", "r2"]


def seed_results(spark, sf_dir) -> DataFrame:
    """Long results of ten seeds. Naive Bayes draws nothing, so its runs agree; the
    baseline draws anew with each seed and has no curve areas."""
    def build():
        every = F.explode(F.array(*map(F.lit, SEEDS)))
        report = evaluate.evaluation_report(M.predictions(spark, sf_dir), KEYS, M.KS)
        model = evaluate.to_long(report, KEYS).withColumn("seed", every)
        rows = M.main_predictions(spark, sf_dir).select("file_name", "dataset", "time_scale", "y")
        drawn = None
        for s in SEEDS:
            one = thresholds.random_baseline(rows, ["time_scale", "dataset"], s).withColumn("seed", F.lit(s))
            drawn = one if drawn is None else drawn.unionByName(one)
        at = ["time_scale", "dataset", "seed"]
        counted = evaluate.cells(drawn, at)
        random = evaluate.accuracy(counted, at).join(evaluate.precision_recall_f1(counted, at), at).join(
            evaluate.ordinal_errors(counted, at), at
        )
        random = evaluate.to_long(random, at).withColumn("model", F.lit("random")).withColumn(
            "feature_subset", F.explode(F.array(*map(F.lit, M.SUBSETS)))
        )
        columns = ["feature_subset", "time_scale", "dataset", "model", "seed", "metric", "value"]
        return model.select(columns).unionByName(random.select(columns))

    return stored(spark, sf_dir, "seed_results", build)


def base_results(spark, sf_dir) -> DataFrame:
    return seed_results(spark, sf_dir).filter(F.col("seed") == SEEDS[0]).drop("seed")


# --- SQL ------------------------------------------------------------------------------

cte("seeds", f"SELECT unnest(range({SEEDS[0]}, {SEEDS[-1] + 1})) AS seed")
cte("seed_drawn", f"""
SELECT p.time_scale, p.dataset, seed, y, ys[({M.draw('seed')} % len(ys)) + 1] AS y_hat
FROM pred p JOIN present USING (time_scale, dataset) CROSS JOIN seeds WHERE feature_subset = 'main'""",
    ("pred", "present", "seeds"))
M.metric_ctes("sd", "seed_drawn", ["time_scale", "dataset", "seed"], ("seed_drawn",))
cte("seed_results", f"""
SELECT feature_subset, time_scale, dataset, model, seed, metric, value FROM (
  SELECT * FROM (UNPIVOT (SELECT {M.K}, {', '.join(f'{m}::DOUBLE AS {m}' for m in M.METRICS)} FROM report WHERE model = 'gnb')
    ON {', '.join(M.METRICS)} INTO NAME metric VALUE value) CROSS JOIN seeds
  UNION ALL BY NAME
  SELECT s.feature_subset, 'random' AS model, u.* FROM (UNPIVOT (
    SELECT time_scale, dataset, seed, {', '.join(f'{m}::DOUBLE AS {m}' for m in RANDOM_METRICS)}
    FROM sd_acc JOIN sd_prf USING (time_scale, dataset, seed) JOIN sd_ord USING (time_scale, dataset, seed))
    ON {', '.join(RANDOM_METRICS)} INTO NAME metric VALUE value) u
  CROSS JOIN (SELECT DISTINCT feature_subset FROM subsets) s)""",
    ("report", "seeds", "sd_acc", "sd_prf", "sd_ord", "subsets"))
cte("seed_stats", """
SELECT *, mean - 1.96::DOUBLE * sem AS ci_95_lower, mean + 1.96::DOUBLE * sem AS ci_95_upper,
  CASE WHEN dataset = 'validation' THEN 'training' ELSE 'testing' END AS phase
FROM (SELECT feature_subset, time_scale, dataset, model, metric, avg(value) AS mean, stddev_samp(value) AS std,
    min(value) AS min, max(value) AS max, median(value) AS median, count(value) AS count,
    stddev_samp(value) / sqrt(count(value)) AS sem
  FROM seed_results WHERE value IS NOT NULL GROUP BY feature_subset, time_scale, dataset, model, metric)""", ("seed_results",))
cte("base", "SELECT * EXCLUDE (seed) FROM seed_results WHERE seed = 42", ("seed_results",))

STATS = ["mean", "std", "min", "max", "median", "sem", "ci_95_lower", "ci_95_upper"]
STAT_SQL = ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in STATS)
GRID = "feature_subset, time_scale"
PLACE = "feature_subset, time_scale, dataset"


@query("seed_statistics", f"""
SELECT {PLACE}, model, metric, "count", {STAT_SQL} FROM seed_stats""", ("seed_stats",))
def seed_statistics(spark, sf_dir):
    return rounded(seeds.seed_statistics(seed_results(spark, sf_dir)))


@query("seed_summary_all", f"""SELECT {PLACE}, model, metric, phase, "count", {STAT_SQL} FROM seed_stats""", ("seed_stats",))
def seed_summary_all(spark, sf_dir):
    return rounded(seeds.seed_summary(seed_results(spark, sf_dir)))


def _register_pivot(value: str) -> None:
    @query(f"accuracy_pivot_{value}", f"SELECT {PLACE}, " + ", ".join(
        f"round(max(\"{value}\") FILTER (model = '{m}'), 6) + 0.0 AS {m}" for m in MODELS
    ) + f" FROM seed_stats WHERE metric = 'accuracy' GROUP BY {PLACE}", ("seed_stats",))
    def run(spark, sf_dir):
        return rounded(seeds.accuracy_pivot(seeds.seed_summary(seed_results(spark, sf_dir)), MODELS, value))


for _v in ("mean", "std"):
    _register_pivot(_v)


@query("best_model_gap", f"""
SELECT {GRID}, b.model, t.dataset, {M.rr('train_accuracy_mean', 'train_accuracy_std', 'test_accuracy_mean', 'test_accuracy_std')},
  round(train_accuracy_mean - test_accuracy_mean, 6) + 0.0 AS generalization_gap
FROM (SELECT {GRID}, model, mean AS train_accuracy_mean, std AS train_accuracy_std FROM seed_stats
  WHERE phase = 'training' AND metric = 'accuracy'
  QUALIFY row_number() OVER (PARTITION BY {GRID} ORDER BY mean DESC, model) = 1) b
JOIN (SELECT {GRID}, model, dataset, mean AS test_accuracy_mean, std AS test_accuracy_std FROM seed_stats
  WHERE phase = 'testing' AND metric = 'accuracy') t USING ({GRID}, model)""", ("seed_stats",))
def best_model_gap(spark, sf_dir):
    return rounded(seeds.best_model_gap(seeds.seed_summary(seed_results(spark, sf_dir))))


# --- K ----------------------------------------------------------------------------------

SHARED = ["accuracy", "f1_macro", "auc_roc", "auprc"]


def unpivoted(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {M.BK}, '{c}' AS metric, {c}::DOUBLE AS value FROM binary_results" for c in columns
    )


@query("results_catalog", f"""
SELECT {PLACE}, model, threshold, metric, round(value, 6) + 0.0 AS value, kind FROM (
  SELECT {PLACE}, model, NULL::BIGINT AS threshold, metric, value, 'base' AS kind FROM base
  UNION ALL BY NAME SELECT *, 'binary' AS kind FROM ({unpivoted(M.BMETRICS)}))""", ("base", "binary_results"))
def results_catalog(spark, sf_dir):
    base = base_results(spark, sf_dir).filter("value IS NOT NULL")
    return rounded(comparison.results_catalog(base, M.binary_results(spark, sf_dir)))


@query("metric_matrix", "SELECT time_scale, dataset, metric, feature_subset, " + ", ".join(
    f"round(max(value) FILTER (model = '{m}'), 6) + 0.0 AS {m}" for m in MODELS
) + " FROM base GROUP BY time_scale, dataset, metric, feature_subset", ("base",))
def metric_matrix(spark, sf_dir):
    return rounded(comparison.metric_matrix(base_results(spark, sf_dir).filter("value IS NOT NULL"), MODELS))


@query("binary_model_comparison", f"SELECT {PLACE}, model, " + ", ".join(
    f"round(avg({m}), 6) + 0.0 AS {m}" for m in M.BMETRICS[:-1]
) + f" FROM binary_results GROUP BY {PLACE}, model", ("binary_results",))
def binary_model_comparison(spark, sf_dir):
    return rounded(comparison.binary_model_comparison(M.binary_results(spark, sf_dir), M.BMETRICS[:-1]))


@query("performance_summary", f"""
SELECT {PLACE}, model_type, metric, model AS best_model, round(value, 6) + 0.0 AS best_score FROM (
  SELECT {PLACE}, 'base' AS model_type, metric, model, NULL::BIGINT AS threshold, value FROM base
  WHERE metric IN ('accuracy', 'f1_macro', 'auc_roc')
  UNION ALL BY NAME SELECT *, 'binary' AS model_type FROM ({unpivoted(['accuracy', 'f1_macro', 'auc_roc'])}))
WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {PLACE}, model_type, metric ORDER BY value DESC, model, threshold) = 1""",
       ("base", "binary_results"))
def performance_summary(spark, sf_dir):
    return rounded(comparison.performance_summary(base_results(spark, sf_dir), M.binary_results(spark, sf_dir)))


@query("dataset_difference", f"""
SELECT {GRID}, model, threshold, round(a.accuracy, 6) + 0.0 AS test, round(b.accuracy, 6) + 0.0 AS gutenberg,
  round(b.accuracy - a.accuracy, 6) + 0.0 AS difference
FROM (SELECT * FROM binary_results WHERE dataset = 'test') a
JOIN (SELECT * FROM binary_results WHERE dataset = 'gutenberg') b USING ({GRID}, model, threshold)""", ("binary_results",))
def dataset_difference(spark, sf_dir):
    return rounded(comparison.dataset_difference(M.binary_results(spark, sf_dir)))


@query("time_scale_difference", """
SELECT feature_subset, dataset, model, round(d.value, 6) + 0.0 AS decades, round(c.value, 6) + 0.0 AS centuries,
  round(c.value - d.value, 6) + 0.0 AS difference
FROM (SELECT * FROM base WHERE time_scale = 'decades' AND metric = 'accuracy') d
JOIN (SELECT * FROM base WHERE time_scale = 'centuries' AND metric = 'accuracy') c USING (feature_subset, dataset, model)""",
       ("base",))
def time_scale_difference(spark, sf_dir):
    return rounded(comparison.time_scale_difference(base_results(spark, sf_dir)))


@query("threshold_curve", f"""
SELECT {PLACE}, model, threshold, metric, round(value, 6) + 0.0 AS value FROM ({unpivoted(M.BMETRICS)})""", ("binary_results",))
def threshold_curve(spark, sf_dir):
    return rounded(comparison.threshold_curve(M.binary_results(spark, sf_dir), M.BMETRICS))


@query("stability_cv", f"""
SELECT {PLACE}, model, round(avg(cv), 6) + 0.0 AS cv FROM (
  SELECT {PLACE}, model, metric, stddev_pop(value) / nullif(avg(value), 0) AS cv FROM ({unpivoted(SHARED)})
  WHERE value IS NOT NULL GROUP BY {PLACE}, model, metric) GROUP BY {PLACE}, model""", ("binary_results",))
def stability_cv(spark, sf_dir):
    return rounded(comparison.stability_cv(M.binary_results(spark, sf_dir)))


@query("dataset_gap_curve", f"""
SELECT {GRID}, model, threshold, metric, round(a.value - b.value, 6) + 0.0 AS gap
FROM (SELECT * FROM ({unpivoted(['accuracy', 'f1_macro'])}) WHERE dataset = 'test') a
JOIN (SELECT * FROM ({unpivoted(['accuracy', 'f1_macro'])}) WHERE dataset = 'gutenberg') b USING ({GRID}, model, threshold, metric)""",
       ("binary_results",))
def dataset_gap_curve(spark, sf_dir):
    return rounded(comparison.dataset_gap_curve(M.binary_results(spark, sf_dir)))


@query("optimal_threshold", f"""
SELECT {PLACE}, model, threshold, round(accuracy, 6) + 0.0 AS best FROM binary_results
QUALIFY row_number() OVER (PARTITION BY {PLACE}, model ORDER BY accuracy DESC, threshold) = 1""", ("binary_results",))
def optimal_threshold(spark, sf_dir):
    return rounded(comparison.optimal_threshold(M.binary_results(spark, sf_dir)))


@query("peak_performance", f"""
SELECT {PLACE}, model, round(max(accuracy), 6) + 0.0 AS peak FROM binary_results GROUP BY {PLACE}, model""", ("binary_results",))
def peak_performance(spark, sf_dir):
    return rounded(comparison.peak_performance(M.binary_results(spark, sf_dir)))
