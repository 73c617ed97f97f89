"""Folders of files listed and read by tasks, so that the driver holds no record of a file."""

from __future__ import annotations

import os
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

LISTED = "path string, folder boolean"
NAMES = 10_000  # rows of a batch of names
BYTES = 1 << 22  # of a batch of contents, if its last file is not longer
PLAIN = {*string.ascii_letters, *string.digits, *"-_.!~*'():@&=+$,;"}  # left as they are in the path of a Java URI


def place(spark: SparkSession, path: str) -> str | None:
    """The full name of a folder, or None where this module cannot list it: patterns, single files, and
    stores that only Hadoop opens."""
    if set(path) & set("*?[]{}\\,"):
        return None
    jvm, context = spark._jvm, spark.sparkContext
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    full = f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full
    try:
        store, root = opened(full)
        return full if store.get_file_info(root).type == fs.FileType.Directory else None
    except (OSError, ValueError):
        return None


def opened(full: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it. Hadoop's names are not percent-encoded."""
    if full.startswith("file://"):
        return fs.LocalFileSystem(), full[7:]
    return fs.FileSystem.from_uri(full)


def regex(spark: SparkSession, pattern: str) -> str:
    """A glob of Hadoop as a regular expression."""
    return spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()


def hidden(name: str) -> bool:
    """The names that Spark's readers leave out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool]]:
    """(path, name, whether it is a folder), one after the other where the store is local."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                yield x.path, x.name, x.is_dir()
        return
    for x in store.get_file_info(fs.FileSelector(folder)):
        yield x.path, x.base_name, x.type == fs.FileType.Directory


def listing(batches: Iterable[pa.RecordBatch], wanted: str, deep: bool) -> Iterator[pa.RecordBatch]:
    """(path, folder) of what lies in the given folders: all files below if `deep`, else files and folders."""
    fits, rows = re.compile(wanted, re.DOTALL), []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.bool_())], ["path", "folder"])
        rows.clear()
        return out

    for given in batches:
        for full in given.column(0).to_pylist():
            store, root = opened(full)
            before, waiting = full[:len(full) - len(root)], [root]
            while waiting:
                for path, name, folder in entries(store, waiting.pop()):
                    if hidden(name) or not (folder or fits.fullmatch(name)):
                        continue
                    if folder and deep:
                        waiting.append(path)
                        continue
                    rows.append((before + path, folder))
                    if len(rows) >= NAMES:
                        yield batch()
    if rows:
        yield batch()


def encoded(name: str) -> str:
    """A file's name as in a Java URI, which is how Spark's readers give it."""
    if PLAIN.issuperset(name):
        return name
    return "".join(
        c if c in PLAIN or (c > "\x9f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp"))
        else "".join(f"%{b:02X}" for b in c.encode()) for c in name)


def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_name, value) of the files whose full names are given."""
    names, values, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["file_name", "value"])

    for given in batches:
        for full in given.column(0).to_pylist():
            store, path = opened(full)
            with store.open_input_stream(path) as stream:
                values.append(stream.read())
            names.append(encoded(path.rsplit("/", 1)[-1]))
            size += len(values[-1])
            if size >= BYTES:
                yield batch()
                names, values, size = [], [], 0
    if names:
        yield batch()
