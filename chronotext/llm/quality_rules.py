"""Quality rules: repetition inside a document, and line frequency across documents.

Lines are normalised (words by single spaces, A-Z lower-cased) and hashed. For each host and
line, distinct documents are counted; lines in more than `max_docs` of them and in more than
`max_percent` of the host's documents are boilerplate and are removed. A document that keeps
less than `min_left_percent` of its words is depleted and rejected, as is one that fails the
base rules (too few words, or too many in repeated 8-word windows).

Documents are counted by the hash of their whole text, lines and hosts alike: exact copies
are one document, so a copied text does not turn its own lines into boilerplate, and near
copies are documents of their own.

Null and empty texts have no words and are rejected; a null host is a host of its own.
Documents are known by (id, hash of the text, host), so repeated rows get equal verdicts each.
Words are runs without space and U+0009 to U+000D; lines end at \\n; all texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import (
    ascii_space, held, mix, slices, span_hashes, table, window_hashes, word_spans,
)
from chronotext.session import materialize

SPACE = ascii_space()
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Fixed value: the characters counted as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW = 8
LINE_HASH = 16  # hex digits kept of a line's md5
LINES = pa.list_(pa.struct([("line", pa.string()), ("n", pa.int64())]))


def line_key(line: bytes) -> str:
    return hashlib.md5(b" ".join(line.split()).translate(LOWER)).hexdigest()[:LINE_HASH]


def _within(rows: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sums of flags over each row's range."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[rows[1:]] - total[rows[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, rows = word_spans(data, offsets, SPACE)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(rows)).astype(np.uint64)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    # Equal lines of one row have equal hashes; lines of other rows are told apart by the row.
    breaks = np.zeros(256, dtype=bool)
    breaks[10] = True
    line_start, line_end, line_rows = word_spans(data, offsets, breaks)
    words_before = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    worded = words_before[1] > words_before[0]
    line_row = np.repeat(np.arange(len(offsets) - 1), np.diff(line_rows))[worded].astype(np.uint64)
    keys = mix(span_hashes(data, line_start[worded], line_end[worded]) + mix(line_row + np.uint64(1)))
    first = np.unique(keys, return_index=True)[1]
    n_lines = np.bincount(line_row.astype(np.int64), minlength=len(offsets) - 1)
    n_first = np.bincount(line_row[first].astype(np.int64), minlength=len(offsets) - 1)
    hashes, window_rows = window_hashes(span_hashes(data, starts, ends), rows, WINDOW)
    counts = np.diff(window_rows)
    own = np.repeat(np.arange(len(counts)), counts)
    keys = mix(hashes + mix(own.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (np.arange(len(keys)) - window_rows[own] + rows[own])[twice]
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return {
        "n_words": np.diff(rows), "word_chars": _within(rows, chars[ends] - chars[starts]),
        "n_symbols": _within(offsets, SYMBOLS[data]), "n_dup_lines": n_lines - n_first,
        "n_repeat_words": _within(rows, np.cumsum(cover[:-1]) > 0),
    }


def lines_of(text: bytes) -> list[dict]:
    """The distinct worded lines with the words in all their copies."""
    words: dict[str, int] = {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            key = line_key(line)
            words[key] = words.get(key, 0) + n
    return [{"line": k, "n": n} for k, n in words.items()]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def profile(docs: DataFrame, doc: str, text: str, host: str) -> DataFrame:
    """doc, host, version (hash of the text), the base counts and the lines of each row."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(host).alias("host"),
                       F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    schema = rows.drop("text").schema
    for name in BASE:
        schema = schema.add(name, "long")
    found = "array<struct<line:string,n:bigint>>"

    def count(batches):
        held()
        for batch in batches:
            data, offsets = table(batch, "text")
            for i, j in slices(offsets):
                own = data[offsets[i]: offsets[j]]
                at = offsets[i: j + 1] - offsets[i]
                counts = base_counts(own, at)
                raw = own.tobytes()
                lines = [lines_of(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
                kept = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(c) for c in ("doc", "host", "version")),
                     *(pa.array(counts[c].astype(np.int64)) for c in BASE), pa.array(lines, LINES)],
                    names=["doc", "host", "version", *BASE, "lines"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(count, f"{fields}, lines {found}")


def judge(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 20,
          max_repeat_percent: int = 30, max_docs: int = 20, max_percent: int = 1, min_left_percent: int = 30) -> DataFrame:
    """doc, host, version, the base counts, base_failed, removed_words, removed_lines (keys of
    the lines removed, null where none) and kept of each row."""
    seen = materialize(profile(docs, doc, text, host).withColumn("nth", F.monotonically_increasing_id()))
    lines = seen.select("nth", "host", "version", F.explode("lines").alias("l")).select("nth", "host", "version", "l.*")
    # Nulls are equal here, so they get a value of their own before the joins.
    known = F.struct(F.col("host").isNull().alias("no"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("name"))
    hosts = seen.groupBy(known.alias("at")).agg(F.count_distinct("version").alias("docs"))
    frequent = (
        lines.select(known.alias("at"), "line", "version").distinct().groupBy("at", "line")
        .agg(F.count(F.lit(1)).alias("in_docs")).filter(F.col("in_docs") > max_docs)
        .join(hosts, "at").filter(F.col("in_docs") * 100 > F.col("docs") * max_percent).select("at", "line")
    )
    removed = (
        lines.withColumn("at", known).join(frequent, ["at", "line"]).groupBy("nth")
        .agg(F.sum("n").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    left = (F.col("n_words") - F.col("removed_words")) * 100
    return (
        seen.drop("lines").join(removed, "nth", "left").drop("nth")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * min_left_percent))
    )


def clean(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", n_chars: str | None = None,
          **limits) -> DataFrame:
    """The kept documents, all columns, without the lines removed; `n_chars` is counted anew."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # no column of the documents can clash with the inner ones
    plain, own = docs.toDF(*names), dict(zip(docs.columns, names))
    d, t, h, chars = own[doc], own[text], own[host], own.get(n_chars)
    verdicts = judge(plain, d, t, h, **limits).filter("kept").select(
        F.col("doc").alias("of_doc"), F.col("host").alias("of_host"), F.col("version").alias("of_version"), "removed_lines"
    ).dropDuplicates(["of_doc", "of_host", "of_version"])
    joined = plain.join(
        verdicts,
        F.col(d).eqNullSafe(F.col("of_doc")) & F.col(h).eqNullSafe(F.col("of_host"))
        & (F.xxhash64(t) == F.col("of_version")),
    ).drop("of_doc", "of_host", "of_version")

    def drop_lines(batches):
        held()
        for batch in batches:
            out = []
            gone_of = batch.column("removed_lines").to_pylist()
            for value, gone in zip(batch.column(t), gone_of):
                if not gone:
                    out.append(value.as_py())
                    continue
                gone = set(gone)
                kept = [x for x in value.as_py().encode().split(b"\n") if not x.split() or line_key(x) not in gone]
                out.append(b"\n".join(kept).decode())
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[t] = pa.array(out, batch.column(t).type)
            if chars:
                columns[chars] = pa.array([None if x is None else len(x) for x in out], pa.int64())
            del columns["removed_lines"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(drop_lines, plain.schema).toDF(*docs.columns)
