"""Session helpers: shared folder, durable cuts in long plans, size checks."""

from __future__ import annotations

import os
import uuid
from math import ceil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a lookup side is broadcast. At about 100 bytes a row this is
# near 200 MB in an executor; a larger side goes through a shuffle join.
BROADCAST_ROWS = 2_000_000
TASK_CHARS = 1 << 21  # characters of text taken apart by one task


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver does. A cluster without a shared
    folder gets it with --py-files."""
    root, held = str(Path(__file__).parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, named by spark.checkpoint.dir.

    Where that is absent, a folder below the warehouse, which the executors share too.
    A local warehouse is refused on a cluster: each executor would see its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        local = folder.startswith(("file:", "/"))
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder and read from there afterwards."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has no more than the given number of rows."""
    return df.limit(rows + 1).count() <= rows


def text_sizes(df: DataFrame) -> tuple[int, int]:
    """Characters of all texts, and of the longest one."""
    row = df.agg(F.sum(F.length("text").cast("bigint")), F.max(F.length("text"))).first()
    return row[0] or 0, row[1] or 0


def text_tasks(chars: int) -> int:
    """Tasks that texts of so many characters are worth."""
    return max(1, ceil(chars / TASK_CHARS))


def text_partitions(df: DataFrame, chars: int | None = None) -> int:
    """Partitions for text about to be taken apart.

    A character becomes up to two hundred bytes of grams in a task, so the number follows the characters:
    sizing the partitions by the bytes of the shuffle would join far too many of them.
    """
    chars = text_sizes(df)[0] if chars is None else chars
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_tasks(chars))
