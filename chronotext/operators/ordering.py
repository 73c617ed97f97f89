"""Ranks over whole tables without a single-task sort.

Rows are ordered by a hash of (seed, id). The leading hex digits of the hash cut
that order into buckets of nearly equal size, whatever the keys look like. A row's
rank is its place inside its bucket plus the rows in earlier buckets, and the
bucket totals are a table of at most 16^PREFIX rows per stratum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 3


def hash_key(seed: int | str, *ids: str | Column) -> Column:
    parts = [F.lit(f"{seed}:")] + [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat(*[p.cast("string") for p in parts]))


def hash_number(key: Column) -> Column:
    """First eight hex digits of a hash as a bigint in [0, 2^32)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash_rank(
    df: DataFrame,
    seed: int | str,
    id_col: str = "file_name",
    strata: list[str] | None = None,
    prefix: int = PREFIX,
) -> DataFrame:
    """Add `hash_pos` (0-based place in hash order inside the stratum) and
    `stratum_n` (rows of the stratum)."""
    strata = strata or []
    keyed = df.withColumn("_h", hash_key(seed, id_col)).withColumn(
        "_b", F.substring("_h", 1, prefix)
    )
    totals = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket; strata are classes, so this stays a small table.
    running = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    offsets = totals.select(
        *strata, "_b",
        (F.sum("_n").over(running.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(running).alias("stratum_n"),
    )
    keys = strata + ["_b"]
    local = Window.partitionBy(*keys).orderBy("_h", id_col)
    placed = keyed.withColumn("_place", F.row_number().over(local) - 1)
    if strata:
        condition = [placed[k].eqNullSafe(offsets[k]) for k in keys]
        joined = placed.join(offsets, condition, "inner")
        for k in keys:
            joined = joined.drop(offsets[k])
    else:
        joined = placed.join(offsets, keys)
    return joined.withColumn("hash_pos", F.col("_before") + F.col("_place")).drop(
        "_h", "_b", "_place", "_before"
    )


def first_in_order(
    df: DataFrame, seed: int | str, id_col: str, strata: list[str], wanted: Callable[[Column], Column],
    prefix: int = PREFIX,
) -> DataFrame:
    """The first `wanted(rows of the stratum)` rows of each stratum in hash order.

    Counts by hash bucket say which buckets are wanted whole; only the one bucket of a stratum in which
    the number is reached is ranked. Strata are not null.
    """
    keyed = df.withColumn("_h", hash_key(seed, id_col)).withColumn("_b", F.substring("_h", 1, prefix))
    running = Window.partitionBy(*strata)
    totals = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *strata, "_b", "_n", (F.sum("_n").over(running.orderBy("_b")) - F.col("_n")).alias("_before"),
        wanted(F.sum("_n").over(running)).alias("_want"))
    buckets = totals.select(*strata, "_b", (F.col("_want") - F.col("_before")).alias("_left"), "_n").filter("_left > 0")
    placed = keyed.join(buckets, [*strata, "_b"])
    order = Window.partitionBy(*strata, "_b").orderBy("_h", id_col)
    edge = placed.filter("_left < _n").withColumn("_place", F.row_number().over(order)).filter("_place <= _left").drop("_place")
    return placed.filter("_left >= _n").unionByName(edge).select(*df.columns)
