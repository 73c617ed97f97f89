"""Kernels over the UTF-8 bytes of an Arrow text column, shared by the operators.

All take whole texts. Rows are handled in slices of about a quarter megabyte, so the arrays
beside a slice stay small; one text longer than that is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chronotext.session import at_most

SLICE_BYTES = 1 << 18
U64 = np.uint64
# Odd constants of the hash functions.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def find_package(spark) -> None:
    """Let Python workers find this package where the driver does. A cluster without a shared
    folder gets it with --py-files, as any Spark job does."""
    import os
    from pathlib import Path

    root, held = str(Path(__file__).parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held]))


_HELD: list = [None, None]


def held(key=None, build=None):
    """What a Python worker keeps between tasks: one thing of one operator. A task of another
    operator, or one that keeps nothing, lets it go, so that these memories never add up."""
    if _HELD[0] != key:
        _HELD[:] = None, None
        _HELD[:] = key, build() if build else None
    return _HELD[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(MIX_1)
    x = (x ^ (x >> U64(27))) * U64(MIX_2)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, dtype=U64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


_POWERS = _powers(1)
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64; kept up to four slices."""
    global _POWERS
    if n > 4 * SLICE_BYTES:
        return _powers(n)
    if len(_POWERS[0]) < n:
        _POWERS = _powers(max(n, SLICE_BYTES + 1))
    return _POWERS


def table(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    column = pc.fill_null(batch.column(text), "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ascii_space() -> np.ndarray:
    """Which bytes separate words: the space and U+0009 to U+000D."""
    sep = np.zeros(256, dtype=bool)
    sep[[0x20, 9, 10, 11, 12, 13]] = True
    return sep


def lower_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
    """(starts, ends, rows): byte spans of the words, and where each row's words begin.

    `offsets` start at 0 within `data`; a word ends at the end of its row."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = ~sep[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(MIX_2))


def window_hashes(words: np.ndarray, rows: np.ndarray, n: int):
    """(hashes, rows) of all windows of n words inside one row; `rows` as in word_spans."""
    size = len(words) - n + 1
    counts = np.maximum(np.diff(rows) - n + 1, 0)
    out_rows = np.concatenate([[0], np.cumsum(counts)])
    if size <= 0:
        return np.zeros(0, dtype=U64), out_rows
    total = np.zeros(size, dtype=U64)
    factor = 1
    for k in range(n):
        factor = factor * BASE % (1 << 64)
        total += words[k: k + size] * U64(factor)
    inside = np.repeat(rows[:-1], counts) + np.arange(out_rows[-1]) - np.repeat(out_rows[:-1], counts)
    return mix(total[inside] + U64(n)), out_rows


def record(arrays: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the given schema from arrays or lists by name."""
    return pa.RecordBatch.from_arrays(
        [a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for f, a in ((f, arrays[f.name]) for f in schema)],
        schema=schema,
    )


def sum_parts(rows, count, size: int, width: int = 4096) -> np.ndarray:
    """The sum over all tasks of an integer array of fixed size.

    `count(batches)` yields each task's array in parts of `width`. Parts are summed where they
    meet, as a stream, so a task holds one array however many tasks there are."""

    def emit(batches):
        parts = [(i, zlib.compress(p.astype("<i8").tobytes(), 1)) for i, p in enumerate(count(batches)) if p.any()]
        for some in (parts[i: i + 64] for i in range(0, len(parts), 64)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())],
                names=["part", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                own = np.frombuffer(zlib.decompress(counts.as_py()), dtype="<i8")
                totals[i] = totals[i] + own if i in totals else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
            names=["part", "counts"])

    fields = "part int, counts binary"
    summed = rows.mapInArrow(emit, fields).repartition("part").mapInArrow(add, fields)
    out = np.zeros(size, dtype=np.int64)
    for row in summed.collect():  # size / width rows
        out[row["part"] * width: (row["part"] + 1) * width] = np.frombuffer(row["counts"], dtype="<i8")
    return out


BROADCAST_ROWS = 1_000_000


def sized(df, rows: int = BROADCAST_ROWS):
    """Marked for broadcast where a count proves it has at most `rows` short rows; else it is
    left to a join by shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if at_most(df, rows) else df
