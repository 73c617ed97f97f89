"""Distributions, importance, neighbours and Spark ML models over the given tables."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.vocabulary import COMPRESSION_FEATURES, LEXICAL_FEATURES
from chronotext.operators import bayes, distributions as D, importance as I, learners as L
from chronotext.operators import evaluate, grid, neighbour_index, neighbours, prepare, seeds
from chronotext.plans import model_queries as M
from chronotext.plans import views as V
from chronotext.plans.ngram_queries import full_features
from chronotext.plans.registry import cte, query, rounded, source_state, stored
from chronotext.plans.text_queries import name
from chronotext.session import materialize, shared_dir, staging_path

FEATURES = V.MAIN_FEATURES


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, decade, feature, value) before imputation."""
    return D.to_long(V.raw_features(spark, sf_dir), FEATURES, ["split", "decade"])


cte("vals", " UNION ALL ".join(
    f"SELECT file_name, split, decade, '{c}' AS feature, {name(c)}::DOUBLE AS value FROM raw_features WHERE {name(c)} IS NOT NULL"
    for c in FEATURES), ("raw_features",))
cte("clipped", """
SELECT file_name, split, decade, feature, greatest(least(value, high), low) AS value FROM vals
JOIN (SELECT split, feature, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high
  FROM vals GROUP BY split, feature) USING (split, feature)""", ("vals",))


@query("winsorize", """
SELECT file_name, split, decade::BIGINT AS decade, feature, round(value, 6) + 0.0 AS value FROM clipped""", ("clipped",))
def winsorize(spark, sf_dir):
    long = D.to_long(V.raw_features(spark, sf_dir), FEATURES, ["file_name", "split", "decade"])
    return rounded(D.winsorize(long, ["split"]))


PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("winsorize_bounds_lineitem", " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS feature, round(quantile_cont({c}, 0.01), 6) + 0.0 AS low, "
    f"round(quantile_cont({c}, 0.99), 6) + 0.0 AS high FROM lineitem GROUP BY l_returnflag" for c in PRICES))
def winsorize_bounds_lineitem(spark, sf_dir):
    """The same quantiles on the largest table."""
    long = D.to_long(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), PRICES, ["l_returnflag"])
    return rounded(D.winsorize_bounds(long, ["l_returnflag", "feature"]))


@query("mean_by_period", "SELECT decade::BIGINT AS decade, round(avg(h), 6) + 0.0 AS \"Shannon_Entropy\", " + ", ".join(
    f"round(avg({name(c)}), 6) + 0.0 AS {name(c)}" for c in LEXICAL_FEATURES
) + " FROM lexical JOIN entropy USING (file_name) GROUP BY decade", ("lexical", "entropy"))
def mean_by_period(spark, sf_dir):
    from chronotext.operators import lexical, ngrams

    docs = V.corpus(spark, sf_dir)
    code = ngrams.character_entropy(docs).withColumnRenamed("entropy", "Shannon_Entropy")
    rows = prepare.join_metadata(
        lexical.lexical_features(docs).join(code, "file_name"), V.metadata(spark, sf_dir)
    )
    return rounded(D.mean_by_period(rows, "decade", ["Shannon_Entropy", *LEXICAL_FEATURES]))


@query("axis_ranges", """
SELECT feature, round(min(lo - (hi - lo) * 0.02::DOUBLE), 6) + 0.0 AS low, round(max(hi + (hi - lo) * 0.02::DOUBLE), 6) + 0.0 AS high
FROM (SELECT split, feature, min(mn) AS lo, max(av) AS hi FROM (
  SELECT split, feature, decade, min(value) AS mn, avg(value) AS av FROM clipped GROUP BY split, feature, decade)
  GROUP BY split, feature) GROUP BY feature""", ("clipped",))
def axis_ranges(spark, sf_dir):
    return rounded(D.axis_ranges(D.winsorize(values(spark, sf_dir), ["split"]), "split", "decade"))


@query("box_stats", """
SELECT v.feature, v.decade::BIGINT AS decade, round(q1, 6) + 0.0 AS q1, round(md, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
  round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) + 0.0 AS whisker_low,
  round(max(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) + 0.0 AS whisker_high,
  sum(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END)::BIGINT AS outliers
FROM vals v JOIN (SELECT feature, decade, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md,
  quantile_cont(value, 0.75) AS q3 FROM vals GROUP BY feature, decade) q ON q.feature = v.feature AND q.decade = v.decade
GROUP BY v.feature, v.decade, q1, md, q3""", ("vals",))
def box_stats(spark, sf_dir):
    return rounded(D.box_stats(values(spark, sf_dir), ["feature", "decade"]))


@query("violin_bins", """
SELECT feature, decade::BIGINT AS decade, bin, count(*) AS n, round(any_value(mean), 6) + 0.0 AS mean FROM (
  SELECT feature, decade, avg(value) OVER (PARTITION BY feature, decade) AS mean,
    least(19, CASE WHEN hi > lo THEN floor((value - lo) / ((hi - lo) / 20)) ELSE 0 END)::BIGINT AS bin
  FROM vals JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM vals GROUP BY feature) USING (feature))
GROUP BY feature, decade, bin""", ("vals",))
def violin_bins(spark, sf_dir):
    return rounded(D.violin_bins(values(spark, sf_dir), ["feature", "decade"]))


cte("violin_groups", f"""
SELECT feature, decade, lo - 3 * h AS a, (hi - lo + 6 * h) / {D.CELLS} AS step, h FROM (
  SELECT feature, decade, min(value) AS lo, max(value) AS hi, CASE WHEN stddev_samp(value) > 0
    THEN stddev_samp(value) * pow(count(*)::DOUBLE, -0.2::DOUBLE) ELSE 1::DOUBLE END AS h FROM vals GROUP BY feature, decade)""", ("vals",))
cte("violin_cells", f"""
SELECT feature, decade, least({D.CELLS - 1}, floor((value - a) / step + 1e-9))::INTEGER AS c, count(*) AS m
FROM vals JOIN violin_groups USING (feature, decade) GROUP BY ALL""", ("vals", "violin_groups"))


@query("violin_density", f"""
SELECT feature, decade::BIGINT AS decade, i AS cell, round(a + (i + 0.5) * step, 6) + 0.0 AS value,
  round(v / (sum(v) OVER (PARTITION BY feature, decade) * step), 6) + 0.0 AS density
FROM (SELECT feature, decade, i, a, step, sum(m * exp(-0.5::DOUBLE * pow((i - c) * step / h, 2))) AS v
  FROM violin_cells JOIN violin_groups USING (feature, decade) CROSS JOIN range({D.CELLS}) r(i)
  GROUP BY feature, decade, i, a, step)""", ("violin_cells", "violin_groups"))
def violin_density(spark, sf_dir):
    return rounded(D.violin_density(values(spark, sf_dir), ["feature", "decade"]))


@query("shared_features", """
SELECT feature, count(DISTINCT split) AS datasets FROM vals GROUP BY feature
HAVING count(DISTINCT split) = (SELECT count(DISTINCT split) FROM vals)""", ("vals",))
def shared_features(spark, sf_dir):
    return D.shared_features(values(spark, sf_dir), "split")


# --- J: importance ------------------------------------------------------------------------


def main_model(spark, sf_dir, scale: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to explain, the moments and the packed model of one time scale."""
    table = V.model_table(spark, sf_dir).withColumn("y", F.col(f"y_{scale}").cast("int"))
    moments = bayes.feature_moments(table.filter("split = 'train'"), FEATURES)
    return table.filter("split <> 'train'"), moments, bayes.gnb_pack(bayes.gnb_fit(moments))


REPEATS = 10
cte("perm_base", f"""
SELECT file_name, row_number() OVER (ORDER BY md5('{V.SEED}/0:' || file_name), file_name) AS r
FROM corpus WHERE split <> 'train'""", ("corpus",))
cte("perm_draw", f"""
SELECT rep, file_name AS donor, row_number() OVER (
  PARTITION BY rep ORDER BY md5('{V.SEED}:' || rep || '/' || file_name), rep || '/' || file_name) AS r
FROM corpus CROSS JOIN (SELECT unnest(range(1, {REPEATS + 1})) AS rep) WHERE split <> 'train'""", ("corpus",))
cte("main_params", "SELECT * FROM params WHERE feature_subset = 'main' AND time_scale = 'centuries'", ("params",))
cte("main_scores", "SELECT file_name, y, c, s FROM class_scores WHERE feature_subset = 'main' AND time_scale = 'centuries'",
    ("class_scores",))
cte("main_terms", """
SELECT f.file_name, p.y AS c, feature, -0.5::DOUBLE * (x - mean) * (x - mean) / var AS term
FROM feat f JOIN main_params p USING (feature) WHERE split <> 'train'""", ("feat", "main_params"))
cte("perm_loss", """
SELECT rep, feature, (SELECT avg((y = y_hat)::INTEGER::DOUBLE) FROM (
    SELECT file_name, y, arg_max(c, (s, -c)) AS y_hat FROM main_scores GROUP BY file_name, y))
  - avg((y = y_hat)::INTEGER::DOUBLE) AS loss
FROM (SELECT rep, a.feature, b.file_name, m.y, arg_max(m.c, (m.s - a.term + t.term, -m.c)) AS y_hat
  FROM perm_base b JOIN perm_draw d USING (r) JOIN main_scores m ON m.file_name = b.file_name
  JOIN main_terms a ON a.file_name = b.file_name AND a.c = m.c
  JOIN main_terms t ON t.file_name = d.donor AND t.c = m.c AND t.feature = a.feature
  GROUP BY rep, a.feature, b.file_name, m.y)
GROUP BY rep, feature""", ("perm_base", "perm_draw", "main_scores", "main_terms"))


@query("permutation_importance", """
SELECT feature, round(m, 6) + 0.0 AS importance_mean, round(s, 6) + 0.0 AS importance_std,
  row_number() OVER (ORDER BY round(m, 9) DESC, feature) AS rank
FROM (SELECT feature, avg(loss) AS m, stddev_pop(loss) AS s FROM perm_loss GROUP BY feature)""", ("perm_loss",))
def permutation_importance(spark, sf_dir):
    rows, _, packed = main_model(spark, sf_dir, "centuries")
    return rounded(I.permutation_importance(rows, FEATURES, packed, REPEATS, V.SEED))


@query("shapley_additive", """
SELECT c AS class, feature, round(a, 6) + 0.0 AS mean_abs_shap, round(m, 6) + 0.0 AS mean_shap,
  row_number() OVER (PARTITION BY c ORDER BY round(a, 9) DESC, feature) AS rank
FROM (SELECT t.c, t.feature, avg(abs(term - mu)) AS a, avg(term - mu) AS m FROM main_terms t
  JOIN (SELECT p.y AS c, feature, avg(-0.5::DOUBLE * (x - mean) * (x - mean) / var) AS mu
    FROM feat JOIN main_params p USING (feature) WHERE split = 'train' GROUP BY p.y, feature) USING (c, feature)
  GROUP BY t.c, t.feature)""", ("main_terms", "feat", "main_params"))
def shapley_additive(spark, sf_dir):
    rows, moments, packed = main_model(spark, sf_dir, "centuries")
    return rounded(I.shapley_additive(rows, FEATURES, moments, packed))


PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({name(a)}, {name(b)}) AS c FROM model_table"
    for a, b in combinations(FEATURES, 2))
cte("pairs", PAIRS, ("model_table",))


@query("correlation_matrix", f"""
SELECT feature_1, feature_2, round(c, 6) + 0.0 AS correlation FROM (
  SELECT * FROM pairs UNION ALL SELECT feature_2, feature_1, c FROM pairs
  UNION ALL SELECT f, f, 1 FROM (VALUES {', '.join(f"('{f}')" for f in FEATURES)}) v(f))""", ("pairs",))
def correlation_matrix(spark, sf_dir):
    return rounded(I.correlation_matrix(V.model_table(spark, sf_dir), FEATURES).drop("i", "j"))


@query("top_correlations", """
SELECT feature_1, feature_2, round(c, 6) + 0.0 AS correlation, round(abs(c), 6) + 0.0 AS abs_correlation,
  row_number() OVER (ORDER BY round(abs(c), 9) DESC, feature_1, feature_2) AS rank
FROM pairs WHERE c IS NOT NULL AND NOT isnan(c) QUALIFY rank <= 20""", ("pairs",))
def top_correlations(spark, sf_dir):
    return rounded(I.top_correlations(V.model_table(spark, sf_dir), FEATURES))


# --- E2, B18, B19: neighbours in the embedding table -------------------------------------------


def points(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


cte("dist", """
SELECT a.vec_id AS q, b.vec_id AS id, a.label AS la, b.label AS lb,
  list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id""")
cte("ranked", "SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM dist", ("dist",))


@query("nearest_neighbours", """
SELECT q AS qid, id, r AS rank, round(d, 6) + 0.0 AS dist FROM ranked WHERE r <= 5""", ("ranked",))
def nearest_neighbours(spark, sf_dir):
    return rounded(neighbours.nearest(points(spark, sf_dir), 5))


@query("knn_exact", """
SELECT q AS id, la::BIGINT AS y, arg_max(lb, (n, -lb))::BIGINT AS y_hat FROM (
  SELECT q, la, lb, count(*) AS n FROM ranked WHERE r <= 5 GROUP BY q, la, lb) GROUP BY q, la""", ("ranked",))
def knn_exact(spark, sf_dir):
    return rounded(neighbours.knn_classify(points(spark, sf_dir), 5))


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    """Hashed neighbours of the points whose id is divisible by 20 among all, with the share of
    the exact neighbours they hold; no SQL, as the projections are drawn."""
    every = points(spark, sf_dir)
    asked = every.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vec")
    found = materialize(neighbour_index.HashIndex.fit(every, 5).search(asked, 5, others=True))
    exact = neighbour_index.CellIndex.fit(every, 6).search(asked, 6).filter("qid <> id")
    exact = neighbour_index.ranked(exact, 5)
    share = neighbour_index.recall(found, exact)
    whole = share.agg(F.avg("recall")).scalar()
    return rounded(found.join(share.withColumnRenamed("recall", "query_recall"), "qid").withColumn("recall", whole))


cte("knn_rows", f"""
SELECT file_name, substr(file_name, 5)::BIGINT AS id, split, y_decades, y_centuries,
  [{', '.join(f'{name(c)}::DOUBLE' for c in FEATURES)}] AS v FROM model_table""", ("model_table",))
cte("knn_found", """
SELECT q.file_name, q.split AS dataset, q.y_decades AS qd, q.y_centuries AS qc, t.y_decades AS td, t.y_centuries AS tc
FROM knn_rows q JOIN knn_rows t ON q.split <> 'train' AND t.split = 'train'
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) <= 5""", ("knn_rows",))
cte("knn_votes", """
SELECT file_name, dataset, time_scale, y, c, count(*) AS n FROM (
  SELECT file_name, dataset, 'decades' AS time_scale, qd AS y, td AS c FROM knn_found
  UNION ALL SELECT file_name, dataset, 'centuries', qc, tc FROM knn_found) GROUP BY ALL""", ("knn_found",))


def knn_predictions(spark, sf_dir, features: list[str] = FEATURES, k: int = 5) -> DataFrame:
    """Neighbours of the documents outside training among the training documents, from a stored
    index, and their vote at both time scales."""
    table = V.model_table(spark, sf_dir).withColumn("id", F.substring("file_name", 5, 20).cast("bigint"))
    rows = table.withColumn("vec", F.array(*[F.col(c).cast("double") for c in features]))
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    index = neighbour_index.CellIndex.fit(train.select("id", "vec"), k)
    found = materialize(index.search(rest.select(F.col("id").alias("qid"), "vec"), k))
    out = None
    for scale in V.TARGETS:
        y = F.col(f"y_{scale}").cast("int").alias("y")
        classes = train.agg(F.max(f"y_{scale}")).first()[0] + 1
        one = neighbour_index.vote(found, train.select("id", y), int(classes)).join(
            rest.select(F.col("id").alias("qid"), "file_name", F.col("split").alias("dataset"), y), "qid"
        ).select("file_name", "dataset", F.lit(scale).alias("time_scale"), "y", "y_hat", "probs")
        out = one if out is None else out.unionByName(one)
    return out


@query("knn_fit_score", """
SELECT file_name, dataset, time_scale, y::BIGINT AS y, arg_max(c, (n, -c))::BIGINT AS y_hat,
  round(coalesce(sum(n) FILTER (c = y), 0) / sum(n), 6) + 0.0 AS p_true
FROM knn_votes GROUP BY file_name, dataset, time_scale, y""", ("knn_votes",))
def knn_fit_score(spark, sf_dir):
    """Fitted on the training set, scored on the others."""
    pred = knn_predictions(spark, sf_dir)
    return rounded(pred.select("file_name", "dataset", "time_scale", "y", "y_hat", F.coalesce(F.get("probs", F.col("y")), F.lit(0.0)).alias("p_true")))


cte("links", """
SELECT a.q AS id, a.id AS nn, a.la AS label, a.lb AS nn_label FROM ranked a JOIN ranked b ON b.q = a.id AND b.id = a.q
WHERE a.r = 1 AND b.r = 1 AND a.la <> a.lb""", ("ranked",))


@query("tomek_links", "SELECT id, nn, label::BIGINT AS label, nn_label::BIGINT AS nn_label FROM links", ("links",))
def tomek_links(spark, sf_dir):
    return rounded(neighbours.tomek_links(points(spark, sf_dir)))


@query("tomek_removed", """
SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE vec_id NOT IN (
  SELECT id FROM links WHERE label <> (SELECT label FROM embeddings GROUP BY label ORDER BY count(*), label LIMIT 1))""", ("links",))
def tomek_removed(spark, sf_dir):
    return rounded(neighbours.remove_tomek_links(points(spark, sf_dir)).select("id", "label"))


@query("smote")
def smote(spark, sf_dir):
    made = neighbours.smote(points(spark, sf_dir))
    return made.select("id", "label", "synthetic", F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


cte("smote_need", """
SELECT label, n, most - n AS need FROM (
  SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM embeddings GROUP BY label) WHERE most > n AND n > 1""")
cte("smote_copies", f"""
SELECT id, label, v, unnest(range(1, need // n + (pos < need % n)::BIGINT + 1)) AS i FROM (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, n, need,
    row_number() OVER (PARTITION BY label ORDER BY md5('{V.SEED}:' || vec_id), vec_id) - 1 AS pos
  FROM embeddings JOIN smote_need USING (label))""", ("smote_need",))
cte("smote_ways", """
SELECT q AS id, list(embedding::DOUBLE[] ORDER BY d, dist.id) AS ways FROM (
  SELECT q, id, d FROM dist WHERE la = lb QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, id) <= 5) dist
JOIN embeddings e ON e.vec_id = dist.id GROUP BY q""", ("dist",))
cte("smote_drawn", f"""
SELECT label, v, ways[('0x' || substr(h, 9, 8))::BIGINT % len(ways) + 1] AS w,
  ('0x' || substr(h, 1, 8))::BIGINT::DOUBLE / 4294967296 AS share
FROM (SELECT *, md5('{V.SEED}:' || id || '/' || i) AS h FROM smote_copies JOIN smote_ways USING (id))""",
    ("smote_copies", "smote_ways"))


@query("smote_values", """
SELECT id, label::BIGINT AS label, synthetic, j AS component, round(x, 6) + 0.0 AS value FROM (
  SELECT vec_id AS id, label, false AS synthetic, unnest(range(len(embedding))) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings
  UNION ALL SELECT NULL, label, true, unnest(range(len(v))),
    unnest(list_transform(list_zip(v, w), lambda p: p[1] + share * (p[2] - p[1]))) FROM smote_drawn)""", ("smote_drawn",))
def smote_values(spark, sf_dir):
    """The points of `smote`, one row a component."""
    made = neighbours.smote(points(spark, sf_dir))
    return rounded(made.select("id", F.col("label").cast("bigint").alias("label"), "synthetic",
                               F.posexplode("vec").alias("component", "value")))


# --- Spark ML ---------------------------------------------------------------------------------


@query("class_weights", """
SELECT decade::BIGINT AS class, count(*) AS n,
  round((SELECT count(*) FROM corpus WHERE split = 'train')::DOUBLE
    / ((SELECT count(DISTINCT decade) FROM corpus WHERE split = 'train') * count(*)), 6) + 0.0 AS weight
FROM corpus WHERE split = 'train' GROUP BY decade""", ("corpus",))
def class_weights(spark, sf_dir):
    return rounded(L.class_weights(V.corpus(spark, sf_dir).filter("split = 'train'"), "decade"))


def _coded(spark, sf_dir, scale: str) -> DataFrame:
    return V.model_table(spark, sf_dir).withColumn("y", F.col(f"y_{scale}").cast("int"))


def _register_learner(key: str, learner: str) -> None:
    @query(key)
    def run(spark, sf_dir):
        coded = _coded(spark, sf_dir, "centuries")
        return L.fit_score(learner, coded.filter("split = 'train'"), coded.filter("split <> 'train'"),
                           FEATURES, ["file_name", "split", "y"])


for _key, _learner in (("rf_fit_score", "random_forest"), ("gbt_ovr_fit_score", "gradient_boosting"),
                       ("linear_svm_ovr", "svm")):
    _register_learner(_key, _learner)


# Options of the registered fits; each is a parameter of its learner.
GRID_LEARNERS = {"random_forest": {}, "boosting": {"rounds": 5}, "kernel_svm": {"size": 64, "passes": 5}, "gnb": {}, "knn": {}}
SEEDED = {n: GRID_LEARNERS[n] for n in ("random_forest", "kernel_svm")}
SEEDS = list(range(42, 52))


def grid_predictions(spark, sf_dir, subsets: list[str], targets: list[str], learners: dict[str, dict], runs: list[int]) -> DataFrame:
    """Predictions of a grid that continues where a killed run of the same inputs has stopped."""
    flags = {c: F.col(c).cast("double") for c in V.NEOLOGISM_FEATURES}
    table = stored(spark, sf_dir, "grid_table", lambda: V.imputed(full_features(spark, sf_dir)).withColumns(flags))
    chosen = {s: [c for c in table.columns if c not in prepare.subset_drop_columns(s) and c != "split"] for s in subsets}
    state = json.dumps([source_state(spark, sf_dir), chosen])
    folder = f"{shared_dir(spark).rstrip('/')}/grid"
    fit_cell = grid.fit_on(table, chosen, {s: V.TARGETS[s] for s in targets})
    return grid.run(spark, folder, grid.cells(learners, subsets, targets, runs), fit_cell, state)


@query("train_grid")
def train_grid(spark, sf_dir):
    """Metrics of all learners over all seven subsets and both time scales."""
    def build():
        pred = grid_predictions(spark, sf_dir, list(V_SUBSETS), list(V.TARGETS), GRID_LEARNERS, [V.SEED])
        return evaluate.to_long(evaluate.evaluation_report(pred, M.KEYS, M.KS), M.KEYS)

    return stored(spark, sf_dir, "train_grid", build)


V_SUBSETS = ["compression", "lexical_structure", "readability", "distance", "neologism", "final_model", "optimal"]


@query("seed_runs")
def seed_runs(spark, sf_dir):
    """The learners that draw, fitted with ten seeds, and their statistics."""
    keys = [*M.KEYS, "seed"]
    pred = grid_predictions(spark, sf_dir, ["compression"], ["centuries"], SEEDED, SEEDS)
    report = evaluate.to_long(evaluate.evaluation_report(pred, keys, M.KS), keys)
    return seeds.seed_statistics(report)


@query("model_store")
def model_store(spark, sf_dir):
    """A stored model scores as the fitted one did, with its own classes and names."""
    coded = _coded(spark, sf_dir, "centuries")
    train = coded.filter("split = 'train'")
    path = staging_path(spark, "model")
    fitted = L.random_forest(FEATURES).fit(L.with_weights(train, "y"))
    L.save_model(fitted, prepare.class_index(train, "century"), FEATURES, path)
    model, classes, names = L.load_model(spark, path)
    scored = L.score(model, coded.filter("split <> 'train'").select("file_name", "century", *names), ["file_name", "century"])
    return prepare.label_decode(scored, classes, "y_hat", "predicted_century")


@query("tree_importance")
def tree_importance(spark, sf_dir):
    train = _coded(spark, sf_dir, "centuries").filter("split = 'train'")
    model = L.random_forest(FEATURES).fit(L.with_weights(train, "y"))
    return L.tree_importance(model, FEATURES, spark)


def _register_pca(key: str, part: str) -> None:
    @query(key)
    def run(spark, sf_dir):
        return I.pca_tables(V.model_table(spark, sf_dir), FEATURES)[part]


for _key, _part in (("pca_loadings", "loadings"), ("pca_variance", "variance"), ("pca_contribution", "contribution")):
    _register_pca(_key, _part)


@query("pca_rebuilt_correlations", f"""
SELECT feature_1, feature_2, round(c, 6) + 0.0 AS correlation FROM (
  SELECT * FROM pairs UNION ALL SELECT feature_2, feature_1, c FROM pairs
  UNION ALL SELECT f, f, 1 FROM (VALUES {', '.join(f"('{f}')" for f in FEATURES)}) v(f))""", ("pairs",))
def pca_rebuilt_correlations(spark, sf_dir):
    """Correlations from the loadings and the variance ratios alone, which holds only if both are right."""
    return rounded(I.rebuilt_correlations(I.pca_tables(V.model_table(spark, sf_dir), FEATURES)))


@query("importance_by_scale")
def importance_by_scale(spark, sf_dir):
    """Permutation and tree importance of both time scales in one table."""
    out = None
    for scale in V.TARGETS:
        rows, _, packed = main_model(spark, sf_dir, scale)
        perm = I.permutation_importance(rows, FEATURES, packed, 5, V.SEED).select(
            F.lit("permutation").alias("kind"), "feature", F.col("importance_mean").alias("importance"), "rank"
        )
        train = _coded(spark, sf_dir, scale).filter("split = 'train'")
        forest = L.random_forest(FEATURES).fit(L.with_weights(train, "y"))
        tree = L.tree_importance(forest, FEATURES, spark).select(
            F.lit("tree").alias("kind"), "feature", "importance", F.col("rank").cast("bigint").alias("rank")
        )
        both = perm.unionByName(tree).withColumn("time_scale", F.lit(scale))
        out = both if out is None else out.unionByName(both)
    return out
