"""Permutation importance of any fitted model, without copying rows for features or repeats.

Rows are put in one hash order. In repeat r a row's changed value comes from the row r places on
(the last rows from the first ones), a random pairing as the order is random. So all repeats of a block
of the order need only the block and the few rows behind it: rows are shuffled once, and a task
holds one block. It changes one column at a time in a copy of the block's matrix and counts
hits; sums for each repeat and feature leave the task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.operators.boosting import vector
from chronotext.operators.importance import rank_by
from chronotext.operators.ordering import hash_rank

BLOCK = 4096


def blocks(rows: DataFrame, features: list[str], repeats: int, seed: int, id_col: str, block: int) -> DataFrame:
    """(block, size, n, at, y, x): each row in its own block and in those whose rows it serves, at its
    place behind the block's first row."""
    placed = hash_rank(rows.select(id_col, F.col("y").cast("int").alias("y"), vector(features).alias("x")), seed, id_col)
    n, pos = F.col("stratum_n"), F.col("hash_pos")
    serves = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(repeats)), lambda r: F.floor(F.pmod(pos - r, n) / block)))
    each = placed.withColumn("block", F.explode(serves))
    first = F.col("block") * block
    return each.select("block", F.least(F.lit(block), n - first).alias("size"), n.alias("n"),
                       F.pmod(pos - first, n).alias("at"), "y", "x")


def permutation_importance(
    rows: DataFrame, features: list[str], probabilities: Callable[[np.ndarray], np.ndarray], repeats: int = 10,
    seed: int = 42, id_col: str = "file_name", block: int = BLOCK,
) -> DataFrame:
    """(feature, importance_mean, importance_std, rank): accuracy lost when one column is shuffled."""
    width = len(features)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        x, y = np.array(part["x"].tolist(), dtype=float), part["y"].to_numpy()
        size, n = int(part["size"].iat[0]), int(part["n"].iat[0])
        own, y = x[:size], y[:size]
        plain = int((probabilities(own).argmax(axis=1) == y).sum())
        out = []
        for r in range(1, repeats + 1):
            donor = np.arange(size) + r
            donor = x[np.where(donor < len(x), donor, donor - n)]
            for f in range(width):
                changed = own.copy()
                changed[:, f] = donor[:, f]
                out.append((r, f, plain - int((probabilities(changed).argmax(axis=1) == y).sum()), size))
        return pd.DataFrame(out, columns=["repeat", "pos", "lost", "rows"])

    sums = blocks(rows, features, repeats, seed, id_col, block).groupBy("block").applyInPandas(
        count, "repeat int, pos int, lost long, rows long")
    per = sums.groupBy("repeat", "pos").agg((F.sum("lost") / F.sum("rows")).alias("loss")).groupBy("pos").agg(
        F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std"))
    names = F.array(*[F.lit(f) for f in features])
    return rank_by(per.select(F.get(names, F.col("pos")).alias("feature"), "importance_mean", "importance_std"), "importance_mean")
