"""Periodic runs in the words of a text, by enumeration of maximal pairs.

A run is a stretch of consecutive words with smallest period q, at least `min_exponent` * q and at
least `min_length` words long, that no neighbouring word extends keeping the period. A maximal
pair is two places i < j whose longest common continuation, of l words, cannot be extended to the
left: the words before them differ. With q = j - i and l >= (min_exponent - 1) * q the two
overlap, and words i to j + l are a stretch of period q that nothing extends: exactly a run, with no
extension step. Multiples of the smallest period give the same stretch; the least one stays.

The places are sorted by their continuations (ranks of 1, 2, 4.. words), common lengths of
neighbours come from the same ranks, and the tree of intervals is walked bottom up on a stack. Each interval
holds its places as one sorted list and as one list for each left word. When two children of an
interval meet, each place of the smaller one looks in the larger one for places near enough,
skipping places of its own left word by comparing the two sorted lists, so that only pairs
that are runs (or multiples of their period) are touched; then the smaller lists join the larger.

Words are `[^\\x20\\x09-\\x0D]+`, known by 64-bit hashes, numbered from 0; texts are read whole. A text is
searched only if some window of the least possible l words stands in it twice. A null or empty text
has no words and no runs; repeated rows get equal results each; an empty table gives no rows; other columns
are kept only where `keep` names them, whatever their names. One text is one task's work.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import ascii_space, held, mix, slices, span_hashes, table, window_hashes, word_spans

SPACE = ascii_space()
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_DDL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def sorted_places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places by continuation, common words of each with the one before it)."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, width = [], 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32))
        if rank.max(initial=0) == n - 1:
            break
        behind = np.full(n, -1, dtype=np.int64)
        behind[: max(n - width, 0)] = rank[width:]
        rank = np.unique(rank * (n + 1) + behind + 1, return_inverse=True)[1]
        width *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    left, right, same = order[:-1], order[1:], np.zeros(max(n - 1, 0), dtype=np.int64)
    for t in range(len(levels) - 1, -1, -1):
        level = levels[t]
        same += (level[left + same] == level[right + same]).astype(np.int64) << t
    common[1:] = same
    return order, common


class Places:
    """The places of one interval: all of them, and those of each left word, both sorted."""

    __slots__ = ("every", "by_left")

    def __init__(self, place: int, left: int):
        self.every, self.by_left = [place], {left: [place]}

    def near(self, place: int, left: int, low: int, high: int):
        """The places from low to high whose left word is another one."""
        every = self.every
        a, b = bisect_left(every, low), bisect_right(every, high)
        if a >= b:
            return
        own = self.by_left.get(left, ())
        c = bisect_left(own, every[a])
        while a < b:
            # every[a:] and own[c:] begin alike exactly as long as all places are of this left word.
            first, last = 0, min(b - a, len(own) - c)
            while first < last:
                middle = (first + last) // 2
                if every[a + middle] == own[c + middle]:
                    first = middle + 1
                else:
                    last = middle
            a, c = a + first, c + first
            if a < b:
                yield every[a]
                a += 1

    def join(self, other: Places) -> None:
        for left, places in other.by_left.items():
            mine = self.by_left.get(left)
            if mine is None:
                self.by_left[left] = places
            else:
                for place in places:
                    insort(mine, place)
        for place in other.every:
            insort(self.every, place)


def find_runs(words: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(words)
    if n < min_length:
        return []
    order, common = sorted_places(words)
    least = least_common(min_length, min_exponent)
    left_words = np.concatenate([[-1], np.unique(words, return_inverse=True)[1][:-1]]).tolist()
    periods: dict[tuple[int, int], int] = {}

    def meet(one: Places, two: Places, length: int) -> Places:
        small, large = (one, two) if len(one.every) < len(two.every) else (two, one)
        nearest, furthest = max(1, min_length - length), length // (min_exponent - 1)
        if nearest <= furthest:
            for left, places in small.by_left.items():
                for place in places:
                    for other in large.near(place, left, place - furthest, place - nearest):
                        note(other, place - other, length)
                    for other in large.near(place, left, place + nearest, place + furthest):
                        note(place, other - place, length)
        large.join(small)
        return large

    def note(start: int, period: int, length: int) -> None:
        at = (start, length + period)
        if period < periods.get(at, n):
            periods[at] = period

    deep = common >= least
    firsts = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]]))
    ends = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]])) + 1
    for first, end in zip(firsts.tolist(), ends.tolist()):
        places, lengths = order[first - 1: end].tolist(), common[first: end].tolist()
        stack: list[list] = []
        held_now = Places(places[0], left_words[places[0]])
        for place, length in zip(places[1:], lengths):
            while stack and stack[-1][0] > length:
                depth, below = stack.pop()
                held_now = meet(below, held_now, depth)
            if stack and stack[-1][0] == length:
                stack[-1][1] = meet(stack[-1][1], held_now, length)
            else:
                stack.append([length, held_now])
            held_now = Places(place, left_words[place])
        while stack:
            depth, below = stack.pop()
            held_now = meet(below, held_now, depth)
    return sorted(((start, length, q) for (start, length), q in periods.items()), key=lambda r: (r[0], r[2]))


def least_common(min_length: int, min_exponent: int) -> int:
    """The least common continuation of a pair that is a run."""
    return -(-min_length * (min_exponent - 1) // min_exponent)


def repeating(hashes: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Which rows have some window of `width` words twice."""
    windows, at = window_hashes(hashes, rows, width)
    out = np.zeros(len(rows) - 1, dtype=bool)
    own = np.repeat(np.arange(len(rows) - 1), np.diff(at))
    keys = mix(windows + mix(own.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    out[own[order[1:][twice]]] = True
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_length: int = 24,
                  min_exponent: int = 3) -> DataFrame:
    """keep, n_words, runs (start, length, period of each, by start, then period) and collapsed (the words
    left when every run keeps its first period, joined by spaces) of every row."""
    names = [f"c{i}" for i in range(len(keep))]  # no kept column can clash with the results
    rows = docs.select(*(F.col(k).alias(c) for k, c in zip(keep, names)), F.col(text).alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    width = least_common(min_length, min_exponent)

    def search(batches):
        held()
        for batch in batches:
            data, offsets = table(batch, "text")
            for i, j in slices(offsets):
                own = data[offsets[i]: offsets[j]]
                at = offsets[i: j + 1] - offsets[i]
                starts, ends, rows_at = word_spans(own, at, SPACE)
                hashes = span_hashes(own, starts, ends)
                found = [[] for _ in range(j - i)]
                for r in np.flatnonzero(repeating(hashes, rows_at, width)).tolist():
                    found[r] = find_runs(hashes[rows_at[r]: rows_at[r + 1]], min_length, min_exponent)
                raw = own.tobytes()
                left = [b" ".join(collapse(raw[a:b].split(), runs)) for a, b, runs in zip(at[:-1], at[1:], found)]
                part = batch.slice(i, j - i)
                listed = [[dict(zip(("start", "length", "period"), run)) for run in runs] for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(np.diff(rows_at).astype(np.int64)), pa.array(listed, RUNS),
                     pa.array(left, pa.binary()).cast(pa.string())],
                    names=[*names, "n_words", "runs", "collapsed"])

    fields = ", ".join(filter(None, [kinds, f"n_words bigint, runs {RUNS_DDL}, collapsed string"]))
    found = rows.mapInArrow(search, fields)
    return found.toDF(*keep, "n_words", "runs", "collapsed")
