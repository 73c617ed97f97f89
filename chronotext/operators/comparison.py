"""Comparison of stored results.

`base` is long: (feature_subset, time_scale, dataset, model, metric, value).
`binary` is wide: (feature_subset, time_scale, dataset, model, threshold, metrics..).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators.evaluate import to_long

PLACE = ["feature_subset", "time_scale", "dataset"]
SUMMARY_METRICS = ["accuracy", "f1_macro", "auc_roc"]
STABILITY_METRICS = ["accuracy", "f1_macro", "auc_roc", "auprc"]


def results_catalog(base: DataFrame, binary: DataFrame) -> DataFrame:
    """Both kinds of results as one long table; base rows have no threshold."""
    long = to_long(binary, [*PLACE, "model", "threshold"])
    return base.select(
        *PLACE, "model", F.lit(None).cast("int").alias("threshold"), "metric", "value",
        F.lit("base").alias("kind"),
    ).unionByName(long.withColumn("kind", F.lit("binary")))


def metric_matrix(base: DataFrame, models: list[str]) -> DataFrame:
    """(scale, dataset, metric, subset) by model."""
    return base.groupBy("time_scale", "dataset", "metric", "feature_subset").pivot(
        "model", models
    ).agg(F.first("value"))


def binary_model_comparison(binary: DataFrame, metrics: list[str]) -> DataFrame:
    return binary.groupBy(*PLACE, "model").agg(*[F.avg(m).alias(m) for m in metrics])


def performance_summary(base: DataFrame, binary: DataFrame) -> DataFrame:
    """Best model and score per place and metric; equal scores go to the first name,
    then the first threshold."""
    scored = base.filter(F.col("metric").isin(SUMMARY_METRICS)).select(
        *PLACE, "metric", "model", F.lit(None).cast("int").alias("threshold"), "value",
        F.lit("base").alias("model_type"),
    ).unionByName(
        to_long(binary.select(*PLACE, "model", "threshold", *SUMMARY_METRICS),
                [*PLACE, "model", "threshold"]).withColumn("model_type", F.lit("binary"))
    ).filter("value IS NOT NULL")
    return scored.groupBy(*PLACE, "model_type", "metric").agg(
        F.min_by(F.struct("model", "value"), F.struct(-F.col("value"), "model", "threshold")).alias("b")
    ).select(
        *PLACE, "model_type", "metric", F.col("b.model").alias("best_model"),
        F.col("b.value").alias("best_score"),
    )


def dataset_difference(binary: DataFrame, metric: str = "accuracy", left: str = "test",
                       right: str = "gutenberg") -> DataFrame:
    """right minus left per subset, scale, model and threshold."""
    keys = ["feature_subset", "time_scale", "model", "threshold"]
    a = binary.filter(F.col("dataset") == left).select(*keys, F.col(metric).alias(left))
    b = binary.filter(F.col("dataset") == right).select(*keys, F.col(metric).alias(right))
    return a.join(b, keys).withColumn("difference", F.col(right) - F.col(left))


def time_scale_difference(base: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Centuries minus decades per subset, data set and model."""
    both = base.filter((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy(
        "feature_subset", "dataset", "model"
    ).pivot("time_scale", ["decades", "centuries"]).agg(F.first("value"))
    return both.filter("decades IS NOT NULL AND centuries IS NOT NULL").withColumn(
        "difference", F.col("centuries") - F.col("decades")
    )


def threshold_curve(binary: DataFrame, metrics: list[str]) -> DataFrame:
    """Each metric by threshold, long, in plotting order."""
    return to_long(binary.select(*PLACE, "model", "threshold", *metrics),
                   [*PLACE, "model", "threshold"]).orderBy(*PLACE, "model", "metric", "threshold")


def stability_cv(binary: DataFrame) -> DataFrame:
    """Mean over metrics of population deviation over mean along the thresholds."""
    long = to_long(binary.select(*PLACE, "model", "threshold", *STABILITY_METRICS),
                   [*PLACE, "model", "threshold"])
    per = long.filter("value IS NOT NULL").groupBy(*PLACE, "model", "metric").agg(
        (F.stddev_pop("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("_cv")
    )
    return per.groupBy(*PLACE, "model").agg(F.avg("_cv").alias("cv"))


def dataset_gap_curve(binary: DataFrame, metrics: tuple[str, ...] = ("accuracy", "f1_macro")) -> DataFrame:
    """test minus gutenberg at each threshold both sets have."""
    keys = ["feature_subset", "time_scale", "model", "threshold"]
    long = to_long(binary.select(*keys, "dataset", *metrics), [*keys, "dataset"])
    wide = long.groupBy(*keys, "metric").pivot("dataset", ["test", "gutenberg"]).agg(F.first("value"))
    return wide.filter("test IS NOT NULL AND gutenberg IS NOT NULL").select(
        *keys, "metric", (F.col("test") - F.col("gutenberg")).alias("gap")
    )


def optimal_threshold(binary: DataFrame, metric: str = "accuracy") -> DataFrame:
    """First threshold with the highest value."""
    return binary.groupBy(*PLACE, "model").agg(
        F.min_by("threshold", F.struct(-F.col(metric), "threshold")).alias("threshold"),
        F.max(metric).alias("best"),
    )


def peak_performance(binary: DataFrame, metric: str = "accuracy") -> DataFrame:
    return binary.groupBy(*PLACE, "model").agg(F.max(metric).alias("peak"))
