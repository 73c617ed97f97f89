"""Gaussian naive Bayes as aggregates and array expressions.

Fitting is one grouped aggregate. A fitted model is an array with one entry per
class (at most a few dozen), so it enters a scoring plan as a scalar subquery or, for
a grid of models, by an equi-join on the model's keys. Rows are never multiplied by
classes.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VARIANCE_FLOOR = 1e-9


def feature_moments(
    train: DataFrame, features: list[str], y: str = "y", keys: list[str] | None = None
) -> DataFrame:
    """(keys, y, n, pos, feature, mean, var): moments per class and feature, counted
    on (feature, value) pairs so that the aggregate stays three columns wide."""
    keys = keys or []
    pairs = F.posexplode(feature_array(features)).alias("pos", "_v")
    names = F.array(*[F.lit(f) for f in features])
    return (
        train.select(*keys, F.col(y).alias("y"), pairs)
        .groupBy(*keys, "y", "pos")
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("var")
        )
        .withColumn("feature", F.get(names, F.col("pos")))
    )


def gnb_fit(moments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, y, pos, feature, prior, mean, var) with the variance floor added: a
    share of the largest overall variance of any feature. Works on the moments only,
    a table of classes times features."""
    keys = keys or []
    per_feature = Window.partitionBy(*keys, "feature")
    per_model = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum("n").over(per_feature)
    centred = moments.withColumn("_mu", F.sum(F.col("n") * F.col("mean")).over(per_feature) / total)
    spread = F.sum(F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("_mu"), 2)))
    return (
        centred.withColumn("_all", spread.over(per_feature) / total)
        .withColumn("_floor", F.max("_all").over(per_model) * VARIANCE_FLOOR)
        .select(
            *keys, "y", "pos", "feature", (F.col("n") / total).alias("prior"), "mean",
            (F.col("var") + F.col("_floor")).alias("var"),
        )
    )


def gnb_pack(fitted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, model): classes in order, each with its constant and its (mean, 1/var)
    pairs in feature order. `places` maps model features to columns of the row."""
    keys = keys or []
    per_class = fitted.groupBy(*keys, "y").agg(
        (F.log(F.first("prior")) - 0.5 * F.sum(F.log(2 * pi * F.col("var")))).alias("const"),
        F.array_sort(F.collect_list(F.struct("pos", "mean", (1 / F.col("var")).alias("inv"))))
        .alias("terms"),
    )
    return per_class.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("y", "const", "terms"))).alias("model")
    )


def feature_array(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def log_joint(x: Column, model: Column) -> Column:
    """Class log scores of one row."""
    def one(c: Column) -> Column:
        distance = F.aggregate(
            c["terms"], F.lit(0.0),
            lambda s, t: s + F.pow(F.get(x, t["pos"]) - t["mean"], 2) * t["inv"],
        )
        return c["const"] - 0.5 * distance

    return F.transform(model, one)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.transform(weights, lambda w: w / total)


def argmax(values: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def gnb_score(
    rows: DataFrame, features: list[str], packed: DataFrame, keep: list[str],
    keys: list[str] | None = None, digits: int | None = None,
) -> DataFrame:
    """(keep, keys, probs, y_hat). With `keys`, each row is scored by the model of
    its keys; `packed` then has one row per model. `digits` fixes the stored
    precision, so that equal scores stay equal wherever they are read."""
    rows = rows.select(*keep, *(keys or []), feature_array(features).alias("_x"))
    if keys:
        placed = rows.join(F.broadcast(packed), keys)
        model = F.col("model")
    else:
        placed = rows.withColumn("model", packed.select("model").scalar())
        model = F.col("model")
    scored = placed.withColumn("_s", log_joint(F.col("_x"), model))
    probs = softmax(F.col("_s"))
    if digits is not None:
        probs = F.transform(probs, lambda p: F.round(p, digits))
    scored = scored.withColumn("probs", probs)
    return scored.select(*keep, *(keys or []), "probs", argmax(F.col("_s")).alias("y_hat"))


def terms_by_class(x: Column, model: Column) -> Column:
    """Per class the array of per-feature parts of its log score."""
    return F.transform(
        model,
        lambda c: F.transform(
            c["terms"], lambda t: -0.5 * F.pow(F.get(x, t["pos"]) - t["mean"], 2) * t["inv"]
        ),
    )
