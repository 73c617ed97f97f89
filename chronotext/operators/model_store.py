"""A folder of model versions, each of them complete or not there.

A version is a folder of Parquet tables (and of Spark ML models) with a manifest written last, by a
job of its own. Readers take the newest version that has a manifest, so what a
killed writer has left is never read. Naive Bayes parameters and neighbour indexes are plain tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators.neighbour_index import CellIndex


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions, rising."""
    try:
        found = spark.read.option("basePath", folder).schema("parts string, about string, version int").json(f"{folder}/version=*/manifest")
        return sorted({r["version"] for r in found.filter("parts IS NOT NULL").select("version").distinct().collect()})  # one row a version
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return []
        raise


def publish(spark: SparkSession, folder: str, parts: dict[str, DataFrame | PipelineModel], about: dict | None = None,
            version: int | None = None) -> int:
    """Write a version, by default the one after the newest complete one, over any unfinished rest of it."""
    version = (versions(spark, folder) or [0])[-1] + 1 if version is None else version
    at = f"{folder}/version={version}"
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            part.write.mode("overwrite").parquet(f"{at}/{name}")
        else:
            part.write().overwrite().save(f"{at}/{name}")
    line = spark.createDataFrame([(json.dumps(sorted(parts)), json.dumps(about or {}))], "parts string, about string")
    line.coalesce(1).write.mode("overwrite").json(f"{at}/manifest")
    return version


@dataclass
class Version:
    number: int
    path: str
    parts: list[str]
    about: dict

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def pipeline(self, name: str) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/{name}")

    def index(self, name: str) -> CellIndex:
        """A neighbour index published as <name>_pivots, <name>_points and <name>_cells."""
        return CellIndex(f"{self.path}/{name}", int(self.about[f"{name}_most"]))


def newest(spark: SparkSession, folder: str) -> Version:
    found = versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"no complete version in {folder}")
    at = f"{folder}/version={found[-1]}"
    line = spark.read.schema("parts string, about string").json(f"{at}/manifest").first()
    return Version(found[-1], at, json.loads(line["parts"]), json.loads(line["about"]))


def index_parts(spark: SparkSession, name: str, index: CellIndex) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a fitted index, to be published, and what to say about it."""
    parts = {f"{name}/{part}": spark.read.parquet(f"{index.path}/{part}") for part in ("pivots", "points", "cells")}
    return parts, {f"{name}_most": index.most}


def bayes_parts(fitted: DataFrame) -> dict[str, DataFrame]:
    """Parameters of naive Bayes as `bayes.gnb_fit` gives them."""
    return {"bayes": fitted.select(*[F.col(c) for c in fitted.columns])}
