"""Old/new evaluation at every inner class boundary.

A text is newer at threshold t when its class is at least t. The number of rows is
multiplied by thresholds only where scores are needed; decisions come from cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators import evaluate
from chronotext.operators.ordering import hash_key, hash_number


def threshold_grid(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, thresholds): sorted classes of y without the first and the last."""
    classes = pred.select(*keys, "y").distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("y")).alias("_c")
    )
    inner = F.when(F.size("_c") > 2, F.slice("_c", F.lit(2), F.size("_c") - 2)).otherwise(
        F.expr("slice(_c, 1, 0)")
    )
    return classes.select(*keys, inner.alias("thresholds"))


def random_baseline(
    rows: DataFrame, keys: list[str], seed: int = 42, id_col: str = "file_name"
) -> DataFrame:
    """A uniform draw from the classes present, by hash of the seed and the row."""
    classes = rows.select(*keys, "y").distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("y")).alias("_c")
    )
    place = F.pmod(hash_number(hash_key(seed, id_col)), F.size("_c")).cast("int")
    joined = rows.join(F.broadcast(classes), keys) if keys else rows.withColumn(
        "_c", classes.select("_c").scalar()
    )
    return joined.withColumn("y_hat", F.get("_c", place)).drop("_c")


def latest_newer_class(pred: DataFrame, top_k: int) -> DataFrame:
    """Replace y_hat by the last class at which the vote of the top_k classes still
    says newer. The newer share only falls as t grows, so that one number settles the
    vote at every threshold: newer iff t <= y_hat. top_k = 1 is the plain argmax."""
    if top_k == 1:
        return pred
    placed = F.transform("probs", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    top = F.slice(F.reverse(F.array_sort(placed)), 1, top_k)
    last = F.transform(
        F.filter(
            F.col("_top"),
            lambda a: F.aggregate(
                F.col("_ord"), F.lit(0.0),
                lambda s, b: s + F.when(b["i"] >= a["i"], b["p"]).otherwise(F.lit(0.0)),
            )
            > F.aggregate(
                F.col("_ord"), F.lit(0.0),
                lambda s, b: s + F.when(b["i"] < a["i"], b["p"]).otherwise(F.lit(0.0)),
            ),
        ),
        lambda a: a["i"],
    )
    by_class = F.array_sort(F.transform("_top", lambda a: F.struct(a["i"].alias("i"), a["p"].alias("p"))))
    voted = (
        pred.withColumn("_top", top).withColumn("_ord", by_class)
        .withColumn("y_hat", F.array_max(last).cast("int"))
    )
    return voted.drop("_top", "_ord")


def binary_cells(counted: DataFrame, grid: DataFrame, keys: list[str], grid_keys: list[str]) -> DataFrame:
    """(keys, threshold, y, y_hat, n) with y and y_hat as 0/1, from confusion cells."""
    t = F.col("threshold")
    joined = counted.join(F.broadcast(grid), grid_keys) if grid_keys else counted.withColumn(
        "thresholds", grid.select("thresholds").scalar()
    )
    return (
        joined.withColumn("threshold", F.explode("thresholds"))
        .groupBy(
            *keys, "threshold", (F.col("y") >= t).cast("int").alias("y"),
            (F.col("y_hat") >= t).cast("int").alias("y_hat"),
        )
        .agg(F.sum("n").alias("n"))
    )


def binary_scores(pred: DataFrame, grid: DataFrame, keys: list[str], grid_keys: list[str],
                  digits: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keys, keep, threshold, y, score): probability of the classes from t on; rows
    without probabilities score their own decision."""
    t = F.col("threshold")
    total = F.aggregate(
        F.slice(F.col("probs"), t + 1, F.greatest(F.size("probs") - t, F.lit(0))), F.lit(0.0),
        lambda s, p: s + p,
    )
    if digits is not None:
        total = F.round(total, digits)
    score = F.when(F.col("probs").isNull(), (F.col("y_hat") >= t).cast("double")).when(
        (t > 0) & (t < F.size("probs")), total
    ).otherwise(0.0)
    joined = pred.join(F.broadcast(grid), grid_keys) if grid_keys else pred.withColumn(
        "thresholds", grid.select("thresholds").scalar()
    )
    return joined.withColumn("threshold", F.explode("thresholds")).select(
        *keys, *(keep or []), "threshold", (F.col("y") >= t).cast("int").alias("y"),
        score.alias("score"),
    )


def pct_of_texts(counted: DataFrame, grid: DataFrame, keys: list[str], grid_keys: list[str]) -> DataFrame:
    """(keys, threshold, share of y <= t)."""
    joined = counted.join(F.broadcast(grid), grid_keys) if grid_keys else counted.withColumn(
        "thresholds", grid.select("thresholds").scalar()
    )
    below = F.when(F.col("y") <= F.col("threshold"), F.col("n")).otherwise(0)
    return joined.withColumn("threshold", F.explode("thresholds")).groupBy(*keys, "threshold").agg(
        (F.sum(below) / F.sum("n")).alias("pct_of_texts")
    )


def binary_sweep(
    pred: DataFrame, keys: list[str], grid_keys: list[str], top_k: int = 1, digits: int | None = None
) -> DataFrame:
    """One row of metrics per (keys, threshold)."""
    grid = threshold_grid(pred, grid_keys)
    has_probs = F.col("probs").isNotNull()
    voted = latest_newer_class(pred.filter(has_probs), top_k).unionByName(pred.filter(~has_probs)) \
        if top_k > 1 else pred
    counted = evaluate.cells(voted, keys)
    two = binary_cells(counted, grid, keys, grid_keys)
    at = [*keys, "threshold"]
    hist = (
        binary_scores(pred, grid, keys, grid_keys, digits)
        .groupBy(*at, "score")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )
    areas = evaluate.curve_areas(hist, at)
    both = (F.col("P") > 0) & (F.col("N") > 0)
    areas = areas.select(
        *at, F.when(both, F.col("auc")).alias("auc_roc"), F.when(both, F.col("ap")).alias("auprc")
    )
    return (
        evaluate.accuracy(two, at)
        .join(evaluate.precision_recall_f1(two, at), at)
        .join(areas, at)
        .join(pct_of_texts(counted, grid, keys, grid_keys), at)
    )
