"""Relational preparation: samples, metadata repair, imputation, labels, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.functions.vocabulary import (
    DEPRECATED_FEATURES, METADATA_COLUMNS, subset_drop_columns,
)
from chronotext.operators.ordering import first_in_order, hash_rank

NUMERIC = (T.NumericType,)


def quota(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(share)))


def reference_sample_stratified(
    files: DataFrame, share: float, seed: int = 42, stratum: str = "decade",
    id_col: str = "file_name",
) -> DataFrame:
    """Ids of a share of each stratum, at least one, in hash order. Rows without a
    stratum are not drawn."""
    known = files.filter(F.col(stratum).isNotNull()).select(id_col, stratum)
    return first_in_order(known, seed, id_col, [stratum], lambda n: quota(n, share)).select(id_col, stratum)


def reference_sample_uniform(
    files: DataFrame, share: float, seed: int = 42, id_col: str = "file_name"
) -> DataFrame:
    ranked = hash_rank(files.select(id_col), seed, id_col)
    return ranked.filter(F.col("hash_pos") < quota(F.col("stratum_n"), share)).select(id_col)


def exclude_reference(files: DataFrame, used: DataFrame, id_col: str = "file_name") -> DataFrame:
    return files.join(used.select(id_col), id_col, "left_anti")


def join_metadata(features: DataFrame, metadata: DataFrame, id_col: str = "file_name") -> DataFrame:
    return features.join(metadata.select(*METADATA_COLUMNS), id_col, "left")


def _invalid(column: str, whole: bool) -> Column:
    value = F.col(column)
    missing = value.isNull() | F.isnan(value.cast("double"))
    return (missing | (value != F.floor(value))) if whole else missing


def repair_temporal(
    features: DataFrame, metadata: DataFrame, columns: tuple[str, ...] = ("year", "decade", "century"),
    id_col: str = "file_name",
) -> DataFrame:
    """Fill missing period columns (and fractional decades) from the metadata."""
    known = metadata.select(id_col, *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    joined = features.join(known, id_col, "left")
    for c in columns:
        fixed = F.when(_invalid(c, c == "decade"), F.col(f"_{c}")).otherwise(F.col(c).cast("double"))
        joined = joined.withColumn(c, fixed)
    return joined.drop(*[f"_{c}" for c in columns])


def repair_decade(features: DataFrame, metadata: DataFrame, id_col: str = "file_name") -> DataFrame:
    return repair_temporal(features, metadata, ("decade",), id_col)


def unresolved(
    repaired: DataFrame, columns: tuple[str, ...] = ("year", "decade", "century"),
    id_col: str = "file_name",
) -> DataFrame:
    """(id, column) for each value that is still missing."""
    gaps = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return repaired.select(id_col, F.explode(F.array_compact(gaps)).alias("column"))


def fill_default(column: str) -> float:
    """Value for a column without any usable entry."""
    if "NCD" in column or "NRC" in column or "Compression_Ratio" in column:
        return 1.0
    return -1.0


def _usable(column: str, zero_is_missing: bool) -> Column:
    value = F.col(column).cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return F.nullif(value, F.lit(0.0)) if zero_is_missing else value


def impute_max(
    df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, zero_is_missing: bool = True
) -> DataFrame:
    """Replace missing values (and zeros, by default) with the column's maximum.

    The maxima are one aggregate row, read back as scalars of the plan."""
    source = df if fit_on is None else fit_on
    columns = [c for c in columns if c in source.columns]
    best = source.agg(
        F.struct(*[F.max(_usable(c, zero_is_missing)).alias(c) for c in columns]).alias("m")
    ).scalar()
    filled = df.withColumn("_max", best)
    return filled.withColumns(
        {
            c: F.coalesce(
                _usable(c, zero_is_missing), F.col("_max").getField(c), F.lit(fill_default(c))
            )
            for c in columns
        }
    ).drop("_max")


def impute_word_max(
    splits: dict[str, DataFrame], columns: list[str], zero_is_missing: bool = True
) -> dict[str, DataFrame]:
    """Same over several sets that share their maxima."""
    stacked = union_splits({k: v.select(*columns) for k, v in splits.items()})
    return {k: impute_max(v, columns, stacked, zero_is_missing) for k, v in splits.items()}


def impute_all_max(df: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    return impute_max(
        df, [c for c in df.columns if c not in METADATA_COLUMNS], None, zero_is_missing
    )


def exclude_classes(df: DataFrame, target: str, values: list[int]) -> DataFrame:
    return df.filter(~F.col(target).cast("int").isin(values)) if values else df


def feature_subset(df: DataFrame, subset: str) -> DataFrame:
    drop = set(subset_drop_columns(subset))
    kept = [c for c in df.columns if c not in drop]
    if not kept:
        raise ValueError(f"No features remaining for subset '{subset}'.")
    return df.select(*kept)


def common_features(train: DataFrame, other: DataFrame) -> list[str]:
    """Columns in both sets, in training order."""
    available = set(other.columns)
    return [c for c in train.columns if c in available]


def align(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)


def drop_deprecated(df: DataFrame) -> DataFrame:
    return df.drop(*DEPRECATED_FEATURES)


def class_index(train: DataFrame, target: str) -> DataFrame:
    """(class, idx): sorted distinct classes from 0. One row per class."""
    classes = train.select(F.col(target).alias("class")).distinct()
    return classes.select(
        "class", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("class")) - 1)
        .cast("int").alias("idx")
    )


def label_encode(df: DataFrame, classes: DataFrame, target: str, out: str = "y") -> DataFrame:
    """Add the class index. A class not seen in training stops the job."""
    joined = df.join(
        F.broadcast(classes.withColumnsRenamed({"class": "_class", "idx": "_idx"})),
        F.col(target) == F.col("_class"), "left",
    )
    message = F.concat(F.lit("unseen class: "), F.coalesce(F.col(target).cast("string"), F.lit("null")))
    return joined.withColumn(
        out, F.when(F.col("_idx").isNotNull(), F.col("_idx")).otherwise(F.raise_error(message).cast("int"))
    ).drop("_class", "_idx")


def label_decode(df: DataFrame, classes: DataFrame, index: str, out: str) -> DataFrame:
    joined = df.join(
        F.broadcast(classes.withColumnsRenamed({"class": "_class", "idx": "_idx"})),
        F.col(index) == F.col("_idx"), "left",
    )
    return joined.withColumn(out, F.col("_class")).drop("_class", "_idx")


def union_splits(splits: dict[str, DataFrame], tag: str | None = None) -> DataFrame:
    out = None
    for name, df in splits.items():
        df = df.withColumn(tag, F.lit(name)) if tag else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def validate_table(splits: dict[str, DataFrame], target: str) -> DataFrame:
    """(dataset, violation) for each failed input rule; empty when all hold."""
    rows = None
    for name, df in splits.items():
        present = target in df.columns
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        counts = df.agg(
            F.count(F.lit(1)).alias("n"),
            (F.count(target) if present else F.lit(0)).alias("known"),
        )
        checks = F.array_compact(F.array(
            F.when(F.col("n") == 0, "empty"),
            F.when(F.lit(not present), "target column not found"),
            F.when(F.lit(present) & (F.col("known") == 0), "target is all null"),
            F.when(F.lit(not numeric), "no numeric columns"),
        ))
        found = counts.select(F.lit(name).alias("dataset"), F.explode(checks).alias("violation"))
        rows = found if rows is None else rows.unionByName(found)
    return rows
