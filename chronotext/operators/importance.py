"""What drives a model: permutation, attribution, correlation, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators import bayes
from chronotext.operators.ordering import hash_rank


def rank_by(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Add `rank`, largest first, ties (to nine digits) by name. For tables of features."""
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.withColumn(
        "rank", F.row_number().over(over.orderBy(F.round(value, 9).desc(), "feature")).cast("bigint")
    )


def permutation_importance(
    rows: DataFrame, features: list[str], packed: DataFrame, repeats: int = 10, seed: int = 42,
    id_col: str = "file_name",
) -> DataFrame:
    """(feature, importance_mean, importance_std, rank): loss of accuracy when one
    column is shuffled.

    A shuffle pairs the row at place i of one hash order with the value at place i of
    another, an equi-join on the place. Each row is scored once; changing a column
    only swaps that column's term in the class scores.
    """
    base = hash_rank(
        rows.select(id_col, "y", bayes.feature_array(features).alias("x")), f"{seed}/0", id_col
    ).select("hash_pos", "y", "x")
    drawn = rows.select(
        F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), id_col,
        bayes.feature_array(features).alias("donor"),
    ).withColumn("_pid", F.concat_ws("/", "repeat", id_col))
    donors = hash_rank(drawn, seed, "_pid", ["repeat"]).select("repeat", "hash_pos", "donor")
    joined = base.join(donors, "hash_pos").withColumn("model", packed.select("model").scalar())
    scored = (
        joined.withColumn("_own", bayes.terms_by_class(F.col("x"), F.col("model")))
        .withColumn("_new", bayes.terms_by_class(F.col("donor"), F.col("model")))
        .withColumn("_s", bayes.log_joint(F.col("x"), F.col("model")))
    )

    def hit(f):
        changed = F.transform(
            F.col("_s"), lambda s, c: s - F.get(F.get("_own", c), f) + F.get(F.get("_new", c), f)
        )
        return (bayes.argmax(changed) == F.col("y")).cast("int")

    hits = F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), hit)
    plain = (bayes.argmax(F.col("_s")) == F.col("y")).cast("int")
    per = (
        scored.select("repeat", plain.alias("_plain"), F.posexplode(hits).alias("pos", "_hit"))
        .groupBy("repeat", "pos")
        .agg((F.avg("_plain") - F.avg("_hit")).alias("loss"))
        .groupBy("pos")
        .agg(F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std"))
    )
    names = F.array(*[F.lit(f) for f in features])
    return rank_by(
        per.select(F.get(names, F.col("pos")).alias("feature"), "importance_mean", "importance_std"),
        "importance_mean",
    )


def shapley_additive(
    rows: DataFrame, features: list[str], moments: DataFrame, packed: DataFrame
) -> DataFrame:
    """(class, feature, mean_abs_shap, mean_shap, rank).

    The naive Bayes class score is a sum of one term per feature, so with independent
    features a term less its mean over the training rows is the exact attribution.
    That mean follows from the moments of the fit.
    """
    per_feature = Window.partitionBy("feature")
    n = F.sum("n").over(per_feature)
    overall = moments.withColumn("_mu", F.sum(F.col("n") * F.col("mean")).over(per_feature) / n)
    overall = overall.withColumn(
        "_var",
        F.sum(F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("_mu"), 2))).over(per_feature) / n,
    ).select("pos", "_mu", "_var").distinct().groupBy().agg(
        F.array_sort(F.collect_list(F.struct("pos", "_mu", "_var"))).alias("o")  # one per feature
    )
    placed = rows.select(bayes.feature_array(features).alias("x")).withColumn(
        "model", packed.select("model").scalar()
    ).withColumn("_o", overall.scalar())

    def expected(t):
        whole = F.get(F.col("_o"), t["pos"])
        return -0.5 * t["inv"] * (whole["_var"] + F.pow(whole["_mu"] - t["mean"], 2))

    parts = F.transform(
        "model",
        lambda c: F.transform(
            c["terms"],
            lambda t: -0.5 * F.pow(F.get(F.col("x"), t["pos"]) - t["mean"], 2) * t["inv"] - expected(t),
        ),
    )
    per = (
        placed.select(F.posexplode(parts).alias("class", "_p"))
        .select("class", F.posexplode("_p").alias("pos", "_v"))
        .groupBy("class", "pos")
        .agg(F.avg(F.abs("_v")).alias("mean_abs_shap"), F.avg("_v").alias("mean_shap"))
    )
    names = F.array(*[F.lit(f) for f in features])
    return rank_by(
        per.select("class", F.get(names, F.col("pos")).alias("feature"), "mean_abs_shap", "mean_shap"),
        "mean_abs_shap", ["class"],
    )


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature_1, feature_2, correlation) for all ordered pairs, rows with a missing
    value left out pair by pair.

    Each task sums the products of its centred rows into features-squared numbers; the
    matrix is the sum over tasks.
    """
    size = len(features)
    x = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    means = df.agg(*[F.avg(c) for c in x]).first()  # one number per feature
    centre = np.array([0.0 if m is None else m for m in means])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, p = (np.zeros((size, size)) for _ in range(4))
        for rows in batches:
            v = rows.to_numpy(dtype=float) - centre
            known = ~np.isnan(v)
            v = np.where(known, v, 0.0)
            m = known.astype(float)
            n += m.T @ m
            s += v.T @ m
            q += (v * v).T @ m
            p += v.T @ v
        i, j = np.indices((size, size))
        yield pd.DataFrame({
            "i": i.ravel(), "j": j.ravel(), "n": n.ravel(), "sa": s.ravel(), "sb": s.T.ravel(),
            "qa": q.ravel(), "qb": q.T.ravel(), "p": p.ravel(),
        })

    schema = "i int, j int, n double, sa double, sb double, qa double, qb double, p double"
    total = df.select(*x).mapInPandas(products, schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")]
    )
    n = F.col("n")
    va, vb = n * F.col("qa") - F.col("sa") ** 2, n * F.col("qb") - F.col("sb") ** 2
    value = (n * F.col("p") - F.col("sa") * F.col("sb")) / (F.sqrt(va) * F.sqrt(vb))
    names = F.array(*[F.lit(f) for f in features])
    return total.select(
        F.get(names, F.col("i")).alias("feature_1"), F.get(names, F.col("j")).alias("feature_2"),
        F.when((va > 0) & (vb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
        .alias("correlation"), "i", "j",
    )


def top_correlations(df: DataFrame, features: list[str], top: int = 20) -> DataFrame:
    """The strongest pairs by absolute value, ranked."""
    found = correlation_matrix(df, features).filter("i < j AND correlation IS NOT NULL").drop("i", "j")
    by = [F.round("abs_correlation", 9).desc(), "feature_1", "feature_2"]
    strongest = found.withColumn("abs_correlation", F.abs("correlation")).orderBy(*by).limit(top)
    order = Window.partitionBy(F.lit(0)).orderBy(*by)
    return strongest.withColumn("rank", F.row_number().over(order).cast("bigint"))


def pca_tables(df: DataFrame, features: list[str]) -> dict[str, DataFrame]:
    """loadings (feature, component, loading), variance (component, ratio, cumulative)
    and contribution (feature, mean_abs_loading, rank) of standardised features."""
    spark = df.sparkSession
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features]).dropna()
    vector = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(vector)
    model = PCA(k=len(features), inputCol="scaled", outputCol="pc").fit(scaler.transform(vector))
    weights = model.pc.toArray()  # features by features
    cells = []
    for j in range(weights.shape[1]):
        column = weights[:, j]
        sign = 1.0 if column[abs(column).argmax()] >= 0 else -1.0
        cells += [(f, j + 1, float(sign * v)) for f, v in zip(features, column)]
    loadings = spark.createDataFrame(cells, "feature string, component int, loading double")
    ratio = spark.createDataFrame(
        [(j + 1, float(v)) for j, v in enumerate(model.explainedVariance)],
        "component int, explained_variance_ratio double",
    )
    running = Window.partitionBy(F.lit(0)).orderBy("component")
    return {
        "loadings": loadings,
        "variance": ratio.withColumn("cumulative_variance", F.sum("explained_variance_ratio").over(running)),
        "contribution": rank_by(
            loadings.groupBy("feature").agg(F.avg(F.abs("loading")).alias("mean_abs_loading")),
            "mean_abs_loading",
        ),
    }


def rebuilt_correlations(tables: dict[str, DataFrame]) -> DataFrame:
    """feature_1, feature_2 and their correlation as the sum over components of variance times both
    loadings; `tables` as given by `pca_tables`, of features none of which is constant."""
    each = tables["loadings"].join(tables["variance"], "component")
    one, two = (each.select("component", F.col("feature").alias(f"feature_{i}"), F.col("loading").alias(f"l{i}"),
                            "explained_variance_ratio") for i in (1, 2))
    n = tables["loadings"].agg(F.count_distinct("feature")).scalar()  # the variances of standardised features add up to it
    return one.join(two.drop("explained_variance_ratio"), "component").groupBy("feature_1", "feature_2").agg(
        F.sum(F.col("explained_variance_ratio") * F.col("l1") * F.col("l2")).alias("share")
    ).select("feature_1", "feature_2", (F.col("share") * n).alias("correlation"))
