"""Lines kept once in a corpus: levelled sorted runs of line hashes, with DataFrame functions only.

Documents come in batches of rising ids. A batch's lines are hashed and grouped to one row per
hash. That table is merge-joined with the runs written so far: a hash found in a run belongs to
an earlier document, so its lines go; a hash found in none is new, its lines stay in the batch's
smallest document, and it forms the batch's own run. Runs are bucketed and sorted by hash, so
neither side of a later merge moves them. When a level holds `fan` runs they are merged into one
run of the next level, so a batch meets at most (fan - 1) runs a level and every hash is
rewritten once a level.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; keys shorter
than `min_chars` code points are left alone. Hashes have 128 bits. Lines go unless they are in
the smallest document that holds their key, also when that one holds it several times.

Null and empty texts are one empty line. A null id counts as one document after all others.
Rows of one id are one document; rows are known by (id, hash of the text), so repeated rows get
equal results each. An empty table gives no rows. Further columns are not read. Ids must be
numbers to be cut into batches; others make one batch. A hash that stands in very many lines is
joined apart, by a broadcast of at most HEAVY_KEYS rows, so that no task gets all its lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.session import staging_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the characters stripped from both ends of a line.
EDGES = " \t\n\x0b\x0c\r"
HEAVY_KEYS = 100_000
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(EDGES)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed_lines(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """d (id), v (hash of the text), pos and the hash (h1, h2) of each line long enough."""
    rows = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("v"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    keyed = rows.select("d", "v", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("d", "v", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class LineRuns:
    """The runs of all hashes met so far. `add` takes one batch of (d, h1, h2) rows.

    Every run is a table in the shared folder, so a lost executor costs at most the merge of one batch."""

    def __init__(self, spark: SparkSession, fan: int = 3, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[tuple[int, str]] = []  # number and folder of each grouped batch
        self.tables: list[str] = []

    def _write(self, rows: DataFrame, *parts: str) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", staging_path(self.spark, "line_run")
        out = rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path)
        (out.partitionBy(*parts) if parts else out).saveAsTable(name)
        self.tables.append(name)
        return name, path

    def _hashes(self, table: str) -> DataFrame:
        rows = self.spark.table(table)
        return (rows.filter("NOT seen") if "seen" in rows.columns else rows).select(*KEY)

    def add(self, number: int, lines: DataFrame) -> None:
        """Merge one batch with the runs and keep what is new in it as a run of the lowest level."""
        grouped = lines.groupBy(*KEY).agg(
            F.min("d").alias("first"), F.max("d").alias("last"), F.max(F.col("d").isNull()).alias("unnamed"),
            F.count(F.lit(1)).alias("n"),
        )
        runs = [t for level in self.levels for t in level]
        for i, table in enumerate(runs):
            grouped = grouped.join(self._hashes(table).hint("merge").withColumn(f"in_{i}", F.lit(True)), KEY, "left")
        found = [F.col(f"in_{i}").isNotNull() for i in range(len(runs))]
        seen = F.lit(False)
        for f in found:
            seen = seen | f
        name, path = self._write(grouped.select(*KEY, "first", "last", "unnamed", "n", seen.alias("seen")), "seen")
        self.batches.append((number, path))
        self._level(0).append(name)
        self._compact()

    def _level(self, i: int) -> list[str]:
        while len(self.levels) <= i:
            self.levels.append([])
        return self.levels[i]

    def _compact(self) -> None:
        level = 0
        while len(self._level(level)) >= self.fan:
            merged = self._hashes(self.levels[level][0])
            for table in self.levels[level][1:]:
                merged = merged.unionByName(self._hashes(table))  # a hash is new in one run only
            name, _ = self._write(merged.repartition(self.buckets, *KEY))
            self.levels[level] = []
            self._level(level + 1).append(name)
            level += 1

    def verdicts(self) -> DataFrame:
        """batch, h1, h2, first, seen, n of the hashes that lose lines: those of earlier documents
        everywhere, the others in all documents but `first`."""
        schema = T.StructType.fromDDL("batch int, h1 long, h2 long, n long, seen boolean")
        out = None
        for b, path in self.batches:
            lost = F.col("seen") | (F.col("first") < F.col("last")) | (F.col("unnamed") & F.col("first").isNotNull())
            one = self.spark.read.parquet(path).filter(lost).select(F.lit(b).alias("batch"), *KEY, "first", "seen", "n")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], schema.add("first", "long")) if out is None else out

    def close(self) -> None:
        """Forget the table names; the folders stay with the other stages of the job."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def batch_number(docs: DataFrame, doc: str, batches: int) -> Column:
    """The batch of an id (column d): cuts at the ids' approximate quantiles, so ids rise with batches."""
    if batches < 2 or not isinstance(docs.schema[doc].dataType, T.NumericType):
        return F.lit(0)
    shares = [(i + 1) / batches for i in range(batches - 1)]
    cuts = docs.agg(F.percentile_approx(doc, shares, 10_000).alias("c")).first()["c"] or []  # one number a batch
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col("d") > F.lit(cut)).cast("int")
    return F.coalesce(number, F.lit(len(set(cuts))))


def dropped_lines(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """d, v and the positions (an array, rising) of the lines that go."""
    at = ["batch", *KEY]
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    bar = max(1000, total // HEAVY_KEYS)  # more lines than this: at most HEAVY_KEYS hashes
    heavy = F.broadcast(verdicts.filter(F.col("n") > bar).drop("n"))
    light = verdicts.filter(F.col("n") <= bar).drop("n")
    rest = lines.join(F.broadcast(verdicts.filter(F.col("n") > bar).select(*at)), at, "left_anti")
    hits = lines.join(heavy, at).unionByName(rest.join(light, at))
    gone = hits.filter(F.col("seen") | ~F.col("d").eqNullSafe(F.col("first")))
    return gone.groupBy("d", "v").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions `gone` (rising), in one walk."""
    before = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1))
    flags = F.flatten(F.transform(
        gone, lambda p, i: F.array_append(F.array_repeat(F.lit(False), p - before(i) - 1), F.lit(True))))
    kept = F.zip_with(split_lines(text), flags, lambda line, drop: F.when(drop, F.lit(None)).otherwise(line))
    return F.array_join(kept, "\n")  # leaves nulls out


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4,
                fan: int = 3) -> DataFrame:
    """doc, n_lines (before), n_dropped and kept (the text left) of every row."""
    spark = docs.sparkSession
    hashed = hashed_lines(docs, doc, text, min_chars).withColumn("batch", batch_number(docs, doc, batches))
    path = staging_path(spark, "lines")
    hashed.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(T.StructType(hashed.schema.fields)).parquet(path)
    numbers = sorted(r["batch"] for r in lines.select("batch").distinct().collect())  # one row a batch
    runs = LineRuns(spark, fan)
    for b in numbers:
        runs.add(b, lines.filter(F.col("batch") == b))
    gone = dropped_lines(lines, runs.verdicts())
    runs.close()
    rows = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("v"), F.col(text).alias("t"))
    found = gone.select(F.col("d").alias("_d"), F.col("v").alias("_v"), "gone")
    joined = rows.join(found, F.col("d").eqNullSafe(F.col("_d")) & (F.col("v") == F.col("_v")), "left")
    none = F.array().cast("array<int>")
    return joined.select(
        F.col("d").alias(doc), F.size(split_lines(F.col("t"))).cast("long").alias("n_lines"),
        F.size(F.coalesce("gone", none)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("t", F.lit(""))).otherwise(without_lines(F.col("t"), F.col("gone"))).alias("kept"),
    )
