"""Spark ML classifiers, the training grid and stored models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators.prepare import class_index, label_encode


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight): rows over classes times rows of the class."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(
        F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")
    ).scalar()
    return counts.withColumn("_t", total).select(
        "class", "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight")
    )


def with_weights(df: DataFrame, target: str) -> DataFrame:
    weights = class_weights(df, target).select(F.col("class").alias(target), "weight")
    return df.join(F.broadcast(weights), target)


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def random_forest(features: list[str], trees: int = 20, depth: int = 8, seed: int = 42) -> Pipeline:
    forest = RandomForestClassifier(
        labelCol="y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth,
        seed=seed,
    )
    return Pipeline(stages=[assembler(features), forest])


def boosted_trees(features: list[str], rounds: int = 5, depth: int = 3, seed: int = 42) -> Pipeline:
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[
        assembler(features),
        OneVsRest(classifier=one, labelCol="y", featuresCol="features", parallelism=4),
    ])


def linear_svm(features: list[str], iterations: int = 20, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        OneVsRest(classifier=LinearSVC(maxIter=iterations), labelCol="y", featuresCol="features",
                  parallelism=4),
    ])


LEARNERS: dict[str, Callable[..., Pipeline]] = {
    "random_forest": random_forest, "gradient_boosting": boosted_trees, "svm": linear_svm,
}


def score(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, probs, y_hat); probs is null for models that give no probabilities."""
    out = model.transform(rows)
    probs = (
        vector_to_array("probability") if "probability" in out.columns
        else F.lit(None).cast("array<double>")
    )
    return out.select(*keep, probs.alias("probs"), F.col("prediction").cast("int").alias("y_hat"))


def fit_score(name: str, train: DataFrame, rows: DataFrame, features: list[str], keep: list[str],
              seed: int = 42, **options) -> DataFrame:
    learner = LEARNERS[name](features, seed=seed, **options)
    return score(learner.fit(with_weights(train, "y")), rows, keep)


def train_grid(
    table: DataFrame, subsets: dict[str, list[str]], targets: dict[str, str], learners: list[str],
    seeds: list[int], split_col: str = "split", id_col: str = "file_name",
) -> DataFrame:
    """Predictions of every subset, time scale, learner and seed on the sets that are
    not for training, one under the other. The loop runs over the small grid; each
    step is a distributed fit on the same stored table."""
    out = None
    train = table.filter(F.col(split_col) == "train")
    for scale, target in targets.items():
        classes = class_index(train, target)
        coded = label_encode(table, classes, target)
        coded_train = coded.filter(F.col(split_col) == "train")
        rest = coded.filter(F.col(split_col) != "train")
        for subset, features in subsets.items():
            for name in learners:
                for seed in seeds:
                    pred = fit_score(
                        name, coded_train, rest, features, [id_col, split_col, "y"], seed
                    ).select(
                        F.lit(subset).alias("feature_subset"), F.lit(scale).alias("time_scale"),
                        F.lit(name).alias("model"), F.lit(seed).alias("seed"),
                        F.col(split_col).alias("dataset"), id_col, "y", "y_hat", "probs",
                    )
                    out = pred if out is None else out.unionByName(pred)
    return out


def save_model(model: PipelineModel, classes: DataFrame, features: list[str], path: str) -> None:
    """Model, classes and feature names kept together."""
    model.write().overwrite().save(f"{path}/model")
    classes.write.mode("overwrite").parquet(f"{path}/classes")
    spark = classes.sparkSession
    spark.createDataFrame(list(enumerate(features)), "pos int, feature string").write.mode(
        "overwrite"
    ).parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, list[str]]:
    names = spark.read.parquet(f"{path}/features").orderBy("pos").collect()  # column names only
    return (
        PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/classes"),
        [r.feature for r in names],
    )


def tree_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance, rank) of a fitted tree model."""
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(features, map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(f, v, i + 1) for i, (f, v) in enumerate(ranked)],
        "feature string, importance double, rank int",
    )
