"""Quality classifier: naive Bayes support vectors.

Each text is a set of hashed n-gram indicators: byte n-grams, word unigrams and bigrams, and
bigrams of back references (how many words ago the same word stood). Class counts of the
indicators over all labelled texts give log-count ratios r; the indicators are scaled by
them and a linear model with hinge loss is fitted by dual coordinate descent. The fit
reads at most `sample` labelled texts of each class, those of smallest hash; the counts read
all. A fifth of the sample is held back to map margins to scores (a logistic curve).

Null and empty texts have no indicators and get the score of the bias alone. Labels other
than 0 and 1 and null ids are not learnt; where an id has several labels the largest holds. If
one of the classes has no text, every score is the share of the other (0.5 without labels). Rows
are scored one by one; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import (
    U64, ascii_space, held, lower_ascii, mix, sized, slices, span_hashes, sum_parts, table, word_spans,
)

BITS = 18
FOLD, SPACE = lower_ascii(), ascii_space()
BYTE_GRAM = 4
BACK = 8


class Indicators:
    """The distinct hashed features of each row of a batch."""

    def __init__(self):
        held()
        self.mark = np.zeros(1 << BITS, dtype=np.int64)
        self.at = 0

    def distinct(self, features: np.ndarray) -> np.ndarray:
        number = np.arange(self.at, self.at + len(features))
        self.at += len(features)
        self.mark[features] = number
        return features[self.mark[features] == number]

    def rows(self, batch: pa.RecordBatch, text: str):
        data, offsets = table(batch, text)
        for i, j in slices(offsets):
            own, at = FOLD[data[offsets[i]: offsets[j]]], offsets[i: j + 1] - offsets[i]
            grams = np.zeros(max(len(own) - BYTE_GRAM + 1, 0), dtype=np.uint32)
            for k in range(BYTE_GRAM):
                grams = (grams << np.uint32(8)) | own[k: k + len(grams)]
            grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            starts, ends, rows = word_spans(own, at, SPACE)
            words = span_hashes(own, starts, ends)
            pairs = mix(words[:-1] * U64(3) + words[1:])
            back = np.zeros(len(words), dtype=U64)
            place = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
            for k in range(BACK, 0, -1):  # the nearest is set last
                back[k:][(words[k:] == words[:-k]) & (place[k:] >= k)] = k
            refs = mix(back[:-1] * U64(BACK + 1) + back[1:] + U64(77))
            short = [(x >> U64(64 - BITS)).astype(np.int64) for x in (words, pairs, refs)]
            for row in range(j - i):
                a, b = at[row], max(at[row + 1] - BYTE_GRAM + 1, at[row])
                s, e = rows[row], rows[row + 1]
                f = max(e - 1, s)
                yield self.distinct(np.concatenate([grams[a:b].astype(np.int64), short[0][s:e], short[1][s:f], short[2][s:f]]))


def held_out(doc: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc.cast("string").cast("binary")) % folds == fold


def log_count_ratios(labelled: DataFrame, text: str, label: str, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the indicator counts of classes 1 and 0, over all rows."""

    def count(batches):
        seen, counts = Indicators(), np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for y, features in zip(batch.column("label").to_pylist(), seen.rows(batch, "text")):
                counts[y][features] += 1
        yield from counts.reshape(-1, 4096)

    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    q, p = sum_parts(rows, count, 2 << BITS).reshape(2, -1) + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int,
                            cost: float = 1.0, epochs: int = 15) -> np.ndarray:
    """Weights of a hinge-loss linear model; the last one is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([v @ v for v in values]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + w[size]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[x] += step * v
                w[size] += step
    return w


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the curve of label 1 over the margins, with smoothed targets."""
    up, down = max((y > 0).sum(), 1), max((y < 0).sum(), 1)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(p - target) @ margins, (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[h @ margins**2, h @ margins], [h @ margins, h.sum()]]) + np.eye(2) * 1e-6
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def scaled(features: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """A row's indicators times the ratios, to length 1."""
    v = ratios[features]
    return v / max(np.sqrt(v @ v), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = 3000) -> np.ndarray:
    """Weight of each indicator, then bias, slope and shift, then the ratios.

    `labels` has one row (doc, label 0 or 1) for each text to learn from."""
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    labels = labels.toDF("doc", "label")
    ratios = log_count_ratios(texts.join(sized(labels), "doc"), "text", "label")
    known = labels.withColumn("spread", F.xxhash64("doc", F.lit(17)))
    chosen = [known.filter(F.col("label") == y).orderBy("spread", "doc").limit(sample) for y in (0, 1)]
    # At most 2 * sample rows.
    chosen = texts.join(F.broadcast(chosen[0].union(chosen[1]).drop("spread")), "doc")
    size = 1 << BITS

    def features(batches):
        seen = Indicators()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("label"), pa.array([f.astype(np.int32) for f in seen.rows(batch, "text")], pa.list_(pa.int32()))],
                names=["doc", "label", "features"])

    kind = docs.schema[doc].dataType.simpleString()
    sampled = chosen.select("doc", "label", "text").mapInArrow(features, f"doc {kind}, label int, features array<int>")

    def train(batches):
        rows, y = [], []
        for batch in batches:
            ids, own, lists = batch.column("doc").to_pylist(), batch.column("label").to_pylist(), batch.column("features")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in sorted(range(batch.num_rows), key=lambda i: (str(ids[i]), own[i])):
                rows.append(flat[ends[i]: ends[i + 1]].copy())
                y.append(1.0 if own[i] else -1.0)
        y = np.array(y)
        out = np.zeros(size + 3)
        out[size: size + 3] = (0.0, 1.0, 0.0)
        if not len(y) or abs(y.mean()) == 1.0:
            share = 0.5 if not len(y) else (np.count_nonzero(y > 0) + 1) / (len(y) + 2)
            out[size + 2] = np.log(share / (1 - share))
        else:
            values = [scaled(r, ratios) for r in rows]
            held = np.arange(len(rows)) % 5 == 4
            use = [i for i in range(len(rows)) if not held[i]]
            w = dual_coordinate_descent([rows[i] for i in use], [values[i] for i in use], y[use], size)
            margins = np.array([w[r] @ v + w[size] for r, v in zip(rows, values)])
            out[:size], out[size] = w[:size], w[size]
            out[size + 1:] = logistic(margins[held], y[held])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["model"])

    # One task fits at most 2 * sample rows.
    model = sampled.repartition(1).sortWithinPartitions("doc").mapInArrow(train, "model binary").collect()
    if not model:  # nothing is labelled
        return np.concatenate([np.zeros(size + 3), ratios])
    return np.concatenate([np.frombuffer(model[0]["model"]), ratios])


def score(docs: DataFrame, model: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep and score: how likely label 1 is, 0 to 1."""
    size = 1 << BITS
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def judge(batches):
        seen, m = Indicators(), shared.value
        w, (bias, slope, shift), ratios = m[:size], m[size: size + 3], m[size + 3:]
        for batch in batches:
            margins = np.array([w[f] @ scaled(f, ratios) for f in seen.rows(batch, "text")]) + bias
            p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(p, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*keep, F.col(text).alias("text"))
    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(judge, f"{kept}, score double")


def known_labels(labels: DataFrame, doc: str = "doc_id", label: str = "quality", folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc, label) of the ids to learn from: labelled 0 or 1 and not in the held-out fold."""
    return (
        labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(doc), folds, fold))
        .groupBy(doc).agg(F.max(label).cast("int").alias("label"))
    )
