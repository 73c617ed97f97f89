"""Statistics over runs that differ in their seed only.

Results are long: (feature_subset, time_scale, dataset, model, seed, metric, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = ["feature_subset", "time_scale", "dataset", "model", "metric"]
GRID = ["feature_subset", "time_scale"]


def seed_statistics(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, extremes, median, count, standard error and 95 %
    interval; the spread is null for a single run. A group has one row per seed."""
    keys = keys or RUN
    base = results.filter("value IS NOT NULL").groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.median("value").alias("median"), F.count("value").alias("count"),
    )
    sem = F.when(F.col("count") > 1, F.col("std") / F.sqrt(F.col("count")))
    return base.withColumn("sem", sem).select(
        "*", (F.col("mean") - 1.96 * F.col("sem")).alias("ci_95_lower"),
        (F.col("mean") + 1.96 * F.col("sem")).alias("ci_95_upper"),
    )


def seed_summary(results: DataFrame, training: str = "validation") -> DataFrame:
    """Statistics of both phases in one table; runs on the `training` set form the
    training phase, all others the testing phase."""
    stats = seed_statistics(results)
    return stats.withColumn(
        "phase", F.when(F.col("dataset") == training, "training").otherwise("testing")
    )


def accuracy_pivot(summary: DataFrame, models: list[str], value: str = "mean",
                   metric: str = "accuracy") -> DataFrame:
    """(subset, scale, dataset) by model."""
    return summary.filter(F.col("metric") == metric).groupBy(*GRID, "dataset").pivot(
        "model", models
    ).agg(F.avg(value))


def best_model_gap(summary: DataFrame, metric: str = "accuracy") -> DataFrame:
    """The best model by training mean of each (subset, scale), beside its means on
    the other sets and the difference. Equal means go to the first name."""
    chosen = summary.filter(F.col("metric") == metric)
    train = chosen.filter("phase = 'training'").groupBy(*GRID).agg(
        F.min_by(F.struct("model", "mean", "std"), F.struct(-F.col("mean"), "model")).alias("b")
    ).select(
        *GRID, F.col("b.model").alias("model"), F.col("b.mean").alias("train_accuracy_mean"),
        F.col("b.std").alias("train_accuracy_std"),
    )
    test = chosen.filter("phase = 'testing'").select(
        *GRID, "model", "dataset", F.col("mean").alias("test_accuracy_mean"),
        F.col("std").alias("test_accuracy_std"),
    )
    return train.join(test, [*GRID, "model"]).withColumn(
        "generalization_gap", F.col("train_accuracy_mean") - F.col("test_accuracy_mean")
    )
