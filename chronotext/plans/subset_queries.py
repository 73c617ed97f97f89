"""Importance side by side: every feature subset at both time scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators import classifiers, importance, permutation
from chronotext.plans import explore_queries as X
from chronotext.plans import learner_queries as L
from chronotext.plans import model_queries as M
from chronotext.plans import views as V
from chronotext.plans.registry import cte, query, rounded
from chronotext.plans.text_queries import name

cte("subset_terms", """
SELECT p.feature_subset, p.time_scale, f.file_name, p.y AS c, feature, -0.5::DOUBLE * (x - mean) * (x - mean) / var AS term
FROM feat f JOIN params p USING (feature) WHERE split <> 'train'""", ("feat", "params"))
cte("subset_hits", f"""
SELECT m.feature_subset, m.time_scale, rep, a.feature, b.file_name, m.y, arg_max(m.c, (m.s - a.term + t.term, -m.c)) AS y_hat
FROM shift_base b CROSS JOIN (SELECT unnest(range(1, {X.REPEATS + 1})) AS rep)
JOIN shift_base d ON d.r = (b.r + rep) % b.n JOIN class_scores m ON m.file_name = b.file_name
JOIN subset_terms a ON a.file_name = b.file_name AND a.c = m.c AND a.feature_subset = m.feature_subset AND a.time_scale = m.time_scale
JOIN subset_terms t ON t.file_name = d.file_name AND t.c = m.c AND t.feature = a.feature
  AND t.feature_subset = m.feature_subset AND t.time_scale = m.time_scale
GROUP BY m.feature_subset, m.time_scale, rep, a.feature, b.file_name, m.y""",
    ("shift_base", "class_scores", "subset_terms"))
cte("subset_loss", """
SELECT feature_subset, time_scale, rep, feature, any_value(plain) - avg((y = y_hat)::INTEGER::DOUBLE) AS loss
FROM subset_hits JOIN (SELECT feature_subset, time_scale, avg((y = y_hat)::INTEGER::DOUBLE) AS plain FROM pred GROUP BY ALL)
  USING (feature_subset, time_scale) GROUP BY feature_subset, time_scale, rep, feature""", ("subset_hits", "pred"))


@query("importance_by_subset", """
SELECT feature_subset, time_scale, feature, round(m, 6) + 0.0 AS importance_mean, round(s, 6) + 0.0 AS importance_std,
  row_number() OVER (PARTITION BY feature_subset, time_scale ORDER BY round(m, 9) DESC, feature) AS rank
FROM (SELECT feature_subset, time_scale, feature, avg(loss) AS m, stddev_pop(loss) AS s FROM subset_loss GROUP BY ALL)""", ("subset_loss",))
def importance_by_subset(spark, sf_dir):
    """Permutation importance of naive Bayes for every subset and time scale."""
    def one(scale: str, subset: str) -> DataFrame:
        train, rest = L.coded(spark, sf_dir, scale)
        features = M.SUBSETS[subset]
        model = classifiers.NaiveBayes.fit(train, features)
        found = permutation.permutation_importance(rest, features, model.probabilities, X.REPEATS, V.SEED)
        return found.select(F.lit(subset).alias("feature_subset"), F.lit(scale).alias("time_scale"), "*")

    return rounded(reduce(DataFrame.unionByName, [one(scale, subset) for scale in V.TARGETS for subset in M.SUBSETS]))


TOP = 5


def _pairs(names: list[str], subset: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{subset}' AS feature_subset, '{a}' AS feature_1, '{b}' AS feature_2, corr({name(a)}, {name(b)}) AS c FROM model_table"
        for i, a in enumerate(names) for b in names[i + 1:])


@query("correlation_by_subset", f"""
SELECT feature_subset, feature_1, feature_2, round(c, 6) + 0.0 AS correlation, round(abs(c), 6) + 0.0 AS abs_correlation,
  row_number() OVER (PARTITION BY feature_subset ORDER BY round(abs(c), 9) DESC, feature_1, feature_2) AS rank
FROM ({' UNION ALL '.join(_pairs(names, subset) for subset, names in M.SUBSETS.items())})
WHERE c IS NOT NULL AND NOT isnan(c) QUALIFY rank <= {TOP}""", ("model_table",))
def correlation_by_subset(spark, sf_dir):
    """The strongest correlations inside each subset."""
    table = V.model_table(spark, sf_dir)
    return rounded(reduce(DataFrame.unionByName, [
        importance.top_correlations(table, names, TOP).withColumn("feature_subset", F.lit(subset)) for subset, names in M.SUBSETS.items()
    ]))
