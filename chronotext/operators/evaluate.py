"""Multi-class evaluation from prediction tables.

Predictions carry `y`, `y_hat` and, where a model gives them, `probs` (one entry per
class index). Counts come from the confusion cells, a table of at most classes
squared rows per group; curve areas come from counts per distinct score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(pred: DataFrame, keys: list[str]) -> DataFrame:
    return pred.groupBy(*keys, "y", "y_hat").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, keys: list[str], class_keys: list[str]) -> DataFrame:
    """All class pairs of every group, zero where nothing fell.

    `class_keys` are the keys that fix the set of classes (a time scale); the classes are all
    that occur as truth or prediction there."""
    counted = cells(pred, keys)
    classes = counted.groupBy(*class_keys).agg(F.collect_set("y").alias("_t"), F.collect_set("y_hat").alias("_p"))
    classes = classes.select(*class_keys, F.array_union("_t", "_p").alias("_classes"))  # one entry a class
    groups = counted.select(*keys).distinct().join(classes, class_keys)
    grid = groups.withColumn("y", F.explode("_classes")).withColumn("y_hat", F.explode("_classes")).drop("_classes")
    return grid.join(counted, [*keys, "y", "y_hat"], "left").select(
        *keys, "y", "y_hat", F.coalesce("n", F.lit(0)).alias("n")
    )


def accuracy(counted: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n")
    hit = F.when(F.col("y") == F.col("y_hat"), n).otherwise(0)
    return counted.groupBy(*keys).agg((F.sum(hit) / F.sum(n)).alias("accuracy"))


def class_counts(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, tp, support, predicted) for classes in y or y_hat."""
    same = F.col("y") == F.col("y_hat")
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("y_hat").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    return counted.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
    )


def safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def precision_recall_f1(counted: DataFrame, keys: list[str]) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    per_class = class_counts(counted, keys).select(
        *keys, "support",
        safe(tp, predicted).alias("precision"), safe(tp, support).alias("recall"),
        safe(2 * tp, support + predicted).alias("f1"),
    )
    return per_class.groupBy(*keys).agg(
        *[F.avg(m).alias(f"{m}_macro") for m in ("f1", "recall", "precision")],
        *[(F.sum(F.col(m) * support) / F.sum("support")).alias(f"{m}_weighted")
          for m in ("f1", "recall", "precision")],
    )


def ordinal_errors(counted: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, MAE and R2 on class indices."""
    n, y, e = F.col("n"), F.col("y"), F.col("y") - F.col("y_hat")
    sums = counted.groupBy(*keys).agg(
        F.sum("n").alias("N"), F.sum(n * e * e).alias("res"), F.sum(n * F.abs(e)).alias("abs"),
        F.sum(n * y).alias("s"), F.sum(n * y * y).alias("ss"),
    )
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("N")
    return sums.select(
        *keys,
        F.sqrt(F.col("res") / F.col("N")).alias("rmse"), (F.col("abs") / F.col("N")).alias("mae"),
        F.when(total > 0, 1 - F.col("res") / total)
        .when(F.col("res") == 0, 1.0).otherwise(0.0).alias("r2"),
    )


def prediction_distribution(counted: DataFrame, keys: list[str]) -> DataFrame:
    return counted.groupBy(*keys, "y_hat").agg(F.sum("n").alias("n"))


# --- areas under curves --------------------------------------------------------


def score_bucket(score: Column) -> Column:
    """A coarse, order-keeping cut of scores that spreads both ends of [0, 1]."""
    inner = F.floor(F.log(score / (1 - score)) * 8)
    return (
        F.when(score <= 0, F.lit(-100_000)).when(score >= 1, F.lit(100_000)).otherwise(inner)
        .cast("int")
    )


def curve_areas(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, P, N, auc, ap) from (keys, score, pos, neg), one row per distinct score.

    Running counts are taken inside score buckets and shifted by the totals of the
    other buckets, so that no group is ordered by a single task. AUC is null when one
    side is missing.
    """
    h = hist.withColumn("_b", score_bucket(F.col("score")))
    totals = h.groupBy(*keys, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    over = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_b",
        (F.sum("_p").over(over.orderBy("_b")) - F.col("_p")).alias("_p0"),
        (F.sum("_q").over(over.orderBy("_b")) - F.col("_q")).alias("_q0"),
        F.sum("_p").over(over).alias("P"), F.sum("_q").over(over).alias("N"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("score")
    run = (
        h.withColumn("_pb", F.sum("pos").over(inside) - F.col("pos"))
        .withColumn("_qb", F.sum("neg").over(inside) - F.col("neg"))
        .join(offsets, [*keys, "_b"])
    )
    below = F.col("_q0") + F.col("_qb")
    tp = F.col("P") - F.col("_p0") - F.col("_pb")
    fp = F.col("N") - below
    pos, neg = F.col("pos"), F.col("neg")
    sums = run.groupBy(*keys, "P", "N").agg(
        F.sum(pos * (below + neg / 2.0)).alias("_u"),
        F.sum(F.when(pos > 0, pos * (tp / (tp + fp))).otherwise(0.0)).alias("_a"),
    )
    P, N = F.col("P"), F.col("N")
    return sums.select(
        *keys, "P", "N",
        F.when((P > 0) & (N > 0), F.col("_u") / (P * N)).alias("auc"),
        F.when(P > 0, F.col("_a") / P).otherwise(0.0).alias("ap"),
    )


def class_score_counts(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, score, pos, neg): one-vs-rest counts per distinct score."""
    positive = F.when(F.col("y") == F.col("class"), 1).otherwise(0)
    return (
        pred.filter("probs IS NOT NULL")
        .select(*keys, "y", F.posexplode("probs").alias("class", "score"))
        .groupBy(*keys, "class", "score")
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )


def probability_areas(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc_roc, auprc): macro means over classes; null if a class is missing."""
    areas = curve_areas(class_score_counts(pred, keys), [*keys, "class"])
    defined = F.count("auc") == F.count(F.lit(1))
    return areas.groupBy(*keys).agg(
        F.when(defined, F.avg("auc")).alias("auc_roc"), F.when(defined, F.avg("ap")).alias("auprc")
    )


def true_rank(probs: Column, y: Column) -> Column:
    """Classes ranked before the true one; on equal scores the higher index wins."""
    own = F.get(probs, y)
    return F.size(F.filter(probs, lambda p, i: (p > own) | ((p == own) & (i > y))))


def topk_accuracy(pred: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    ranked = pred.filter("probs IS NOT NULL").withColumn(
        "_r", true_rank(F.col("probs"), F.col("y"))
    )
    return ranked.groupBy(*keys).agg(
        *[F.avg((F.col("_r") < k).cast("double")).alias(f"top{k}_accuracy") for k in ks]
    )


def evaluation_report(pred: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """All metrics, one row per group."""
    counted = cells(pred, keys)
    parts = [
        accuracy(counted, keys), precision_recall_f1(counted, keys), ordinal_errors(counted, keys),
    ]
    curves = [probability_areas(pred, keys), topk_accuracy(pred, keys, ks)]
    out = reduce(lambda a, b: a.join(b, keys), parts)
    return reduce(lambda a, b: a.join(b, keys, "left"), curves, out)


def to_long(report: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value)."""
    metrics = [c for c in report.columns if c not in keys]
    return report.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        keys, metrics, "metric", "value"
    )
