"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_features(features: DataFrame, path: str, split_col: str = "split") -> None:
    """One Parquet table partitioned by split; a re-run replaces its own splits."""
    (
        features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(split_col).parquet(path)
    )


def write_text_files(corpus: DataFrame, path: str) -> None:
    """One text file per document, named by its key with `/` and `%` percent-encoded.

    A path without a scheme lies in the default file system, as for Spark's own writers."""
    jvm, context = corpus.sparkSession._jvm, corpus.sparkSession.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(path)
    full = folder.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(folder).toString()

    def write(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(full.replace("file:/", "file:///", 1) if full.startswith("file:/") else full)
        store.create_dir(root, recursive=True)
        for row in rows:
            name = row.file_name.replace("%", "%25").replace("/", "%2F")
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(row.text.encode("utf-8"))

    corpus.select("file_name", "text").foreachPartition(write)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
