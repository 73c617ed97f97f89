"""A corpus pipeline: quality rules, quality classifier, near duplicates, benchmark
decontamination, packing. Each stage reads what the one before it has written.

Stages take and return whole rows; further columns go along, whatever their names, up to the last stage, which
returns pieces. Null and empty texts, and texts of few words, fail the base rules and go in the first stage. Repeated
rows are judged each, and of equal texts the near-duplicate stage keeps the smallest id; rows of one id and one text stay once. A null
id is one id; it is never the smallest. Where no document is labelled, all have the same score. An empty table
gives no pieces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import best_fit, decontaminate, jaccard_join, nb_svm, quality_rules
from chronotext.llm.common import find_package
from chronotext.llm.queries import QUALITY_LIMIT, quality_model, vocabulary
from chronotext.session import staging_path


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines are cut from the others."""
    find_package(spark)
    return quality_rules.clean(docs, n_chars="n_chars")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit go. Learns from the labelled ones among its input."""
    find_package(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]  # no column can clash with the score
    plain = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    scored = nb_svm.score(plain, quality_model(spark, docs, sf_dir), tuple(names), text)
    return scored.filter(F.col("score") >= QUALITY_LIMIT).select(*names).toDF(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    find_package(spark)
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    find_package(spark)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without_documents(docs, found)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    find_package(spark)
    return best_fit.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules_stage), ("quality classifier", classifier_stage), ("near duplicates", duplicates_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage),
]
# Scores and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""

    def step(docs: DataFrame, stage) -> DataFrame:
        path = staging_path(spark, "stage")
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
