"""Query registry and a small builder for the SQL beside each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}
_STORED: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; `sql` is its check and `uses` the shared CTEs it needs."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, uses)
        return fn

    return add


def cte(name: str, body: str, uses: tuple[str, ...] = ()) -> None:
    CTES[name] = (list(uses), body)


def with_ctes(select: str, uses: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][0]:
                visit(dep)
            ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return select
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{select}"


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A pipeline stage written once per session and state of the documents to the shared folder."""
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), name)
    if key not in _STORED:
        path = staging_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the documents' files: an overwritten input is another one."""
    jvm, folder = spark.sparkContext._jvm, f"{sf_dir}/documents.parquet"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return repr(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, counts to bigint."""
    def column(f):
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            return F.col(f"`{f.name}`").cast("bigint").alias(f.name)
        return F.col(f"`{f.name}`")

    return df.select(*[column(f) for f in df.schema.fields])
