"""Boosting, kernel machine, importance of any model, and the model store over the model table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators import bayes, boosting, classifiers, kernel_machine, model_store, neighbour_index, permutation
from chronotext.plans import explore_queries as X
from chronotext.plans import views as V
from chronotext.plans.registry import cte, query, rounded
from chronotext.plans.text_queries import name
from chronotext.session import staging_path

FEATURES = V.MAIN_FEATURES
SEED = V.SEED


def coded(spark, sf_dir, scale: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and the others of one time scale."""
    rows = V.model_table(spark, sf_dir).withColumn("y", F.col(f"y_{scale}").cast("int"))
    return rows.filter("split = 'train'"), rows.filter("split <> 'train'")


def fit_score(spark, sf_dir, learner: str, **options) -> DataFrame:
    """Predictions at both time scales, and the probability of the true class."""
    def one(scale: str) -> DataFrame:
        train, rest = coded(spark, sf_dir, scale)
        found = classifiers.score(classifiers.fit(learner, train, FEATURES, SEED, **options), rest, ["file_name", "split", "y"])
        return found.select(
            "file_name", F.lit(scale).alias("time_scale"), F.col("split").alias("dataset"), "y", "y_hat",
            F.coalesce(F.get("probs", F.col("y")), F.lit(0.0)).alias("p_true"),
            F.round(F.aggregate("probs", F.lit(0.0), lambda s, p: s + p), 6).alias("p_sum"))

    return reduce(DataFrame.unionByName, map(one, V.TARGETS))


@query("boosting_fit_score")
def boosting_fit_score(spark, sf_dir):
    """Boosted trees of all classes at once; rows-only, as SQL has no boosting."""
    return rounded(fit_score(spark, sf_dir, "boosting", rounds=10))


@query("kernel_svm_fit_score")
def kernel_svm_fit_score(spark, sf_dir):
    """Kernel machine with calibrated probabilities; its feature map is checked as `kernel_features`."""
    return rounded(fit_score(spark, sf_dir, "kernel_svm"))


MAP_SIZE = 32
cte("kernel_draws", f"""
SELECT j, i, sqrt(-2::DOUBLE * ln((('0x' || substr(h, 1, 8))::BIGINT + 1)::DOUBLE / 4294967296))
  * cos(2::DOUBLE * pi() * ('0x' || substr(h, 9, 8))::BIGINT::DOUBLE / 4294967296) AS w
FROM (SELECT j, i, md5('{SEED}:' || j || '/' || i) AS h FROM range({MAP_SIZE}) a(j), range({len(FEATURES)}) b(i))""")
cte("kernel_values", " UNION ALL ".join(
    f"SELECT file_name, split, {i} AS i, {name(c)}::DOUBLE AS x FROM model_table" for i, c in enumerate(FEATURES)), ("model_table",))


@query("kernel_features", f"""
SELECT file_name, j AS component,
  round(sqrt(2::DOUBLE / {MAP_SIZE}) * cos(sqrt(2::DOUBLE / {len(FEATURES)}) * sum(w * (x - m) / s)
    + 2::DOUBLE * pi() * ('0x' || substr(md5('{SEED}:b' || j), 9, 8))::BIGINT::DOUBLE / 4294967296), 6) + 0.0 AS value
FROM kernel_values JOIN kernel_draws USING (i)
JOIN (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s
  FROM kernel_values WHERE split = 'train' GROUP BY i) USING (i)
GROUP BY file_name, j""", ("kernel_values", "kernel_draws"))
def kernel_features(spark, sf_dir):
    """The random Fourier features of every document, one row a component."""
    train, rest = coded(spark, sf_dir, "centuries")
    fourier = kernel_machine.FourierMap.fit(train, FEATURES, MAP_SIZE, SEED)
    mapped = boosting.scored(train.unionByName(rest), FEATURES, ["file_name"], fourier)
    return rounded(mapped.select("file_name", F.posexplode("probs").alias("component", "value")))


cte("shift_base", f"""
SELECT file_name, row_number() OVER (ORDER BY md5('{SEED}:' || file_name), file_name) - 1 AS r, count(*) OVER () AS n
FROM corpus WHERE split <> 'train'""", ("corpus",))
cte("shift_loss", f"""
SELECT rep, feature, (SELECT avg((y = y_hat)::INTEGER::DOUBLE) FROM (
    SELECT file_name, y, arg_max(c, (s, -c)) AS y_hat FROM main_scores GROUP BY file_name, y))
  - avg((y = y_hat)::INTEGER::DOUBLE) AS loss
FROM (SELECT rep, a.feature, b.file_name, m.y, arg_max(m.c, (m.s - a.term + t.term, -m.c)) AS y_hat
  FROM shift_base b CROSS JOIN (SELECT unnest(range(1, {X.REPEATS + 1})) AS rep)
  JOIN shift_base d ON d.r = (b.r + rep) % b.n JOIN main_scores m ON m.file_name = b.file_name
  JOIN main_terms a ON a.file_name = b.file_name AND a.c = m.c
  JOIN main_terms t ON t.file_name = d.file_name AND t.c = m.c AND t.feature = a.feature
  GROUP BY rep, a.feature, b.file_name, m.y)
GROUP BY rep, feature""", ("shift_base", "main_scores", "main_terms"))


@query("permutation_any_model", """
SELECT feature, round(m, 6) + 0.0 AS importance_mean, round(s, 6) + 0.0 AS importance_std,
  row_number() OVER (ORDER BY round(m, 9) DESC, feature) AS rank
FROM (SELECT feature, avg(loss) AS m, stddev_pop(loss) AS s FROM shift_loss GROUP BY feature)""", ("shift_loss",))
def permutation_any_model(spark, sf_dir):
    """The way that takes any model, on naive Bayes, whose scores SQL can compute."""
    train, rest = coded(spark, sf_dir, "centuries")
    model = classifiers.NaiveBayes.fit(train, FEATURES)
    return rounded(permutation.permutation_importance(rest, FEATURES, model.probabilities, X.REPEATS, SEED))


@query("permutation_learners")
def permutation_learners(spark, sf_dir):
    """Forest, boosting and kernel machine, each changed column by column."""
    train, rest = coded(spark, sf_dir, "centuries")
    models = {
        "random_forest": classifiers.fit("random_forest", train, FEATURES, SEED).arrays(),
        "boosting": classifiers.fit("boosting", train, FEATURES, SEED, rounds=10),
        "kernel_svm": classifiers.fit("kernel_svm", train, FEATURES, SEED),
    }
    return rounded(reduce(DataFrame.unionByName, [
        permutation.permutation_importance(rest, FEATURES, m.probabilities, X.REPEATS, SEED).withColumn("model", F.lit(n))
        for n, m in models.items()
    ]))


@query("model_versions", """
SELECT 2::BIGINT AS version, y, feature, round(prior, 6) + 0.0 AS prior, round(mean, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS var
FROM main_params""", ("main_params",))
def model_versions(spark, sf_dir):
    """Two versions of naive Bayes and a neighbour index are published, a third is left half written; the
    newest complete one is read back."""
    train, _ = coded(spark, sf_dir, "centuries")
    folder = staging_path(spark, "models")
    fitted = bayes.gnb_fit(bayes.feature_moments(train, FEATURES))
    model_store.publish(spark, folder, model_store.bayes_parts(fitted.limit(0)))
    ids = train.select(F.xxhash64("file_name").alias("id"), boosting.vector(FEATURES).alias("vec"))
    parts, about = model_store.index_parts(spark, "neighbours", neighbour_index.CellIndex.fit(ids, 5))
    model_store.publish(spark, folder, {**model_store.bayes_parts(fitted), **parts}, about)
    fitted.limit(1).write.parquet(f"{folder}/version=3/bayes")  # as a killed writer leaves it
    held = model_store.newest(spark, folder)
    return rounded(held.table(spark, "bayes").select(
        F.lit(held.number).cast("bigint").alias("version"), "y", "feature", "prior", "mean", "var"))
