"""Corpus, metadata, dictionary and feature-table readers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.vocabulary import METADATA_COLUMNS
from chronotext.session import find_package, materialize
from chronotext.sources import folders

METADATA_SCHEMA = "file_name STRING, year INT, decade INT, century INT"
NULL_TOKENS = ("", "None")
TASK_FILES = 4_096  # files that a task reads


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per text file below a folder; the base name is the key. Undecodable
    bytes are dropped and empty files give no row."""
    root = folders.place(spark, path)
    files = spark_files(spark, path, pattern) if root is None else listed_files(spark, root, pattern)
    repaired = F.replace(F.make_valid_utf8("text"), F.lit("\ufffd"), F.lit(""))
    return drop_empty(
        files.withColumn("text", F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(repaired))
    )


def spark_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file_name, text) by Spark's reader, which keeps a record of each file in the driver."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    )


def listed_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The same from a listing that tasks make: the names are a table, the driver gets their number."""
    find_package(spark)
    wanted, tasks = folders.regex(spark, pattern), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def top(batches):
        return folders.listing(batches, wanted, deep=False)

    def below(batches):
        return folders.listing(batches, wanted, deep=True)

    first = materialize(spark.createDataFrame([(root,)], "path string").mapInArrow(top, folders.LISTED))
    deeper = first.filter("folder").select("path").repartition(tasks, "path").mapInArrow(below, folders.LISTED)
    found = materialize(first.filter("not folder").unionByName(deeper))
    tasks = max(tasks, ceil(found.count() / TASK_FILES))
    read = found.select("path").repartition(tasks, "path").mapInArrow(folders.contents, "file_name string, value binary")
    return read.select("file_name", F.col("value").cast("string").alias("text"))


def read_corpus(spark: SparkSession, path: str, id_col: str, text_col: str = "text") -> DataFrame:
    """A corpus already stored as a Parquet table."""
    return drop_empty(
        spark.read.parquet(path).select(
            F.col(id_col).cast("string").alias("file_name"), F.col(text_col).alias("text")
        )
    )


def drop_empty(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.length("text") > 0)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The four metadata columns of a CSV that may hold others."""
    return _csv_by_name(spark, path, METADATA_SCHEMA).select(*METADATA_COLUMNS)


def _csv_by_name(spark: SparkSession, path: str, schema: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    wanted = dict(f.strip().split(" ") for f in schema.split(","))
    full = ", ".join(f"`{c}` {wanted.get(c, 'STRING')}" for c in header)
    return spark.read.option("header", True).option("enforceSchema", False).schema(full).csv(path)


def null_token(column: Column) -> Column:
    """Text cells that stand for a missing value, read as null."""
    return F.when(~column.isin(*NULL_TOKENS), column)


def read_features(
    spark: SparkSession, path: str, text_columns: tuple[str, ...] = ("file_name",)
) -> DataFrame:
    """Feature CSV: null tokens become null, other cells numbers where they parse."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        *[
            null_token(F.col(f"`{c}`")).alias(c) if c in text_columns
            else _number(null_token(F.col(f"`{c}`"))).alias(c)
            for c in raw.columns
        ]
    )


def _number(cell: Column) -> Column:
    flag = F.lower(cell)
    return (
        F.when(flag == "true", 1.0).when(flag == "false", 0.0)
        .otherwise(cell.try_cast("double"))
    )


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word-list JSON as (lang, word), (period, term) and (period, from_year, to_year)."""
    raw = spark.read.text(path, wholetext=True)
    top = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "body"))
    words = top.filter(~F.col("key").isin("neologisms", "neologism_periods")).select(
        F.col("key").alias("lang"), F.explode(F.array_distinct(F.from_json("body", "array<string>"))).alias("word")
    )
    terms = (
        top.filter("key = 'neologisms'")
        .select(F.explode(F.from_json("body", "map<string,array<string>>")).alias("period", "terms"))
        .select("period", F.explode("terms").alias("term"))
    )
    periods = (
        top.filter("key = 'neologism_periods'")
        .select(F.explode(F.from_json("body", "map<string,array<int>>")).alias("period", "years"))
        .select(
            "period", F.col("years")[0].alias("from_year"), F.col("years")[1].alias("to_year")
        )
    )
    return words, terms, periods


def latest_run(df: DataFrame, group: list[str], run_col: str = "run_id") -> DataFrame:
    """Rows of the newest run of each group. The newest ids are a small table."""
    newest = df.groupBy(*group).agg(F.max(run_col).alias(run_col))
    return df.join(newest, group + [run_col], "left_semi")


def quarantine(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split documents into usable ones and rejected ones with a reason."""
    reason = (
        F.when(F.col("text").isNull(), "unreadable")
        .when(F.length("text") == 0, "empty")
    )
    checked = corpus.withColumn("reason", reason)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()).select("file_name", "reason"),
    )
