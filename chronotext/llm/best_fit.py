"""Best-fit packing by exact complements.

Texts become token ids and an end id; what is longer than a sequence is cut into full pieces.
Packing needs only how many pieces of each length there are, which is at most `capacity`
numbers. On these, `plan_packing` takes the longest length and looks up what fills the gap
exactly: one length, a pair (from an index of pair sums) or a triple (a length and an indexed
pair sum), as often as the counts allow. Where nothing fills a gap, the residuals are
packed best fit, each time trying to complete the new gap exactly.

Pieces then get their places without being gathered: a piece's rank among those of its
length is its number within its task plus the counts of earlier tasks, and ranges of ranks
belong to groups of equal sequences.

A null or empty text is the end id alone. Repeated rows are packed each. Empty tables give
no rows. Other columns are dropped.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import held, slices, span_hashes, table, word_spans
from chronotext.session import materialize

CACHE = 3_000_000  # words of about 40 bytes
SMALL = 100_000
BLANKS = np.isin(np.arange(256), [0x20, 0x0A])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lettered(word: str) -> bool:
    """Whether the word is still all letters as the tokenizer normalises it (NFC, lower case): some
    letters become a letter and a mark, which forms one piece with a point behind it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Shelf:
    """Ids of words by the words' 64-bit hashes: sorted hashes, and where each word's ids lie."""

    def __init__(self):
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, first, size) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys, self.first[at], self.size[at]

    def add(self, keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.first, self.size = (
            np.insert(old, at, new[order]) for old, new in ((self.keys, keys), (self.first, first), (self.size, size)))


class WordIds:
    """Ids of white-space-separated words, remembered (up to CACHE of them) in flat arrays.

    For tokenizers that drop white space and look at nothing beyond it. New words go to a small shelf that
    is put into the large one from time to time."""

    def __init__(self, tokenizer_file: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(tokenizer_file)
        self.closes = np.zeros(self.model.get_vocab_size(), dtype=bool)
        for token, i in self.model.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.large, self.small = Shelf(), Shelf()
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, first, size = self.large.find(keys)
        rest = np.flatnonzero(~known)
        if len(rest):
            also, other, long = self.small.find(keys[rest])
            known[rest], first[rest], size[rest] = also, other, long
        return known, first, size

    def put(self, keys: np.ndarray, coded: list[bytes]) -> None:
        new = np.frombuffer(b"".join(coded), dtype="<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype="<u4")])
        self.ids[self.used: self.used + len(new)] = new
        self.small.add(keys, self.used + np.cumsum(size) - size, size)
        self.used += len(new)
        if len(self.small.keys) > SMALL:
            self.large.add(self.small.keys, self.small.first, self.small.size)
            self.small = Shelf()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(little-endian unsigned 32-bit ids of all rows, where each row's ids begin) of UTF-8 texts."""
        if len(self.large.keys) > CACHE:
            self.clear()
        starts, ends, rows = word_spans(data, offsets, BLANKS)
        keys, at, own = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(~self.find(keys)[0])
        if len(new):
            raw, lo, hi = data.tobytes(), starts[at[new]].tolist(), ends[at[new]].tolist()
            self.learn([raw[i:j].decode() for i, j in zip(lo, hi)], keys[new])
        _, first, size = self.find(keys)
        length = size[own]
        total = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat(first[own] - total[:-1], length) + np.arange(total[-1])
        return self.ids[place], total[rows]

    def learn(self, words: list[str], keys: np.ndarray) -> None:
        """A word of letters and a closing point or comma is the word, then the mark; capitals
        A-Z don't matter. Neither holds inside special tokens, which all begin with `<|`."""
        plain = []
        for word in words:
            base, tail = word, ""
            if "<|" not in word:
                base = word.lower() if word.isascii() else word.translate(LOWER)
                if base[-1] in ".," and lettered(base[:-1]):
                    base, tail = base[:-1], base[-1]
            plain.append((base, tail))
        bases = list(dict.fromkeys([base for base, _ in plain] + [".", ","]))
        base_keys = hashes_of(bases)
        known, first, size = self.find(base_keys)
        coded = {}
        for i in np.flatnonzero(known).tolist():
            coded[bases[i]] = self.ids[first[i]: first[i] + size[i]].tobytes()
        unknown = [w for w in bases if w not in coded]
        letters = [w for w in unknown if lettered(w)]  # each is one word to the tokenizer
        for i in range(0, len(letters), 500):
            some = letters[i: i + 500]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()]
            data = ids.tobytes()
            if len(cuts) == len(some) + 1:
                coded.update((w, data[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
        rest = [w for w in unknown if w not in coded]
        for word, found in zip(rest, self.model.encode_batch(rest, add_special_tokens=False)):
            coded[word] = np.array(found.ids, dtype="<u4").tobytes()
        fresh = np.flatnonzero(~known)
        other = [i for i, (word, (base, _)) in enumerate(zip(words, plain)) if word != base]
        coded[""] = b""
        self.put(
            np.concatenate([base_keys[fresh], keys[other]]),
            [coded[bases[i]] for i in fresh.tolist()] + [coded[plain[i][0]] + coded[plain[i][1]] for i in other])


def hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, doc: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc, piece, start, length, ids_crc32 (and ids), and the piece's number among those of
    its length in its task."""
    kind = docs.schema[doc].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [doc, "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids

    def cut(batches):
        ids, task, seen = held(("words", tokenizer_file), lambda: WordIds(tokenizer_file)), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts, offsets = table(batch, "text")
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                rows, keys = [], []
                flat, at = ids.encode(texts[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                flat, at = flat.tobytes(), (4 * at).tolist()
                for row in range(j - i):
                    data = flat[at[row]: at[row + 1]] + end
                    for n, lo in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[lo: lo + 4 * capacity]
                        size = len(own) // 4
                        rows.append((n, lo // 4, size, zlib.crc32(own), task, seen[size]))
                        keys.append((row, own if with_ids else None))
                        seen[size] += 1
                columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]
                found = part.column("doc").take(pa.array([k for k, _ in keys], pa.int64()))
                more = [pa.array([np.frombuffer(d, "<u4").astype(np.int64) for _, d in keys], pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([found, *columns, *more], names=names)

    fields = f"`{doc}` {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint"
    fields += ", ids array<bigint>" * with_ids
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(cut, fields)


class Stock:
    """Counts of lengths with an index of how many pairs reach each sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        self.pair_sums = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        here = np.flatnonzero(self.left)
        for a in here:
            self._pairs(a, here[here > a], 1)
            if self.left[a] > 1 and 2 * a <= capacity:
                self.pair_sums[2 * a] += 1

    def _pairs(self, a: int, others: np.ndarray, sign: int) -> None:
        sums = a + others
        np.add.at(self.pair_sums, sums[sums <= self.capacity], sign)

    def take(self, pattern: Counter, times: int) -> None:
        for a, m in pattern.items():
            before, after = self.left[a], self.left[a] - m * times
            if before > 1 >= after and 2 * a <= self.capacity:
                self.pair_sums[2 * a] -= 1
            self.left[a] = after
            if after == 0:
                here = np.flatnonzero(self.left)
                self._pairs(a, here[here != a], -1)

    def single(self, gap: int, held: Counter) -> list[int] | None:
        return [gap] if self.left[gap] > held[gap] else None

    def pair(self, gap: int, held: Counter) -> list[int] | None:
        if self.pair_sums[gap] <= 0:
            return None
        free = self.free(held)
        a = np.flatnonzero(free[: gap // 2 + 1] > 0)
        ok = a[np.where(2 * a == gap, free[a] > 1, free[gap - a] > 0)]
        return [int(gap - ok[0]), int(ok[0])] if len(ok) else None

    def triple(self, gap: int, held: Counter) -> list[int] | None:
        free = self.free(held)
        first = np.flatnonzero(free[:gap] > 0)[::-1]
        for a in first[self.pair_sums[gap - first] > 0]:
            more = held + Counter([int(a)])
            rest = self.pair(gap - int(a), more)
            if rest:
                return [int(a), *rest]
        return None

    def free(self, held: Counter) -> np.ndarray:
        free = self.left.copy()
        for a, m in held.items():
            free[a] -= m
        return free

    def complement(self, gap: int, held: Counter) -> list[int] | None:
        return self.single(gap, held) or self.pair(gap, held) or self.triple(gap, held)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, longest first) and how often each is used."""
    stock, plan = Stock(counts, capacity), []

    def use(pattern: list[int]) -> None:
        held = Counter(pattern)
        times = int(min(stock.left[a] // m for a, m in held.items()))
        stock.take(held, times)
        plan.append((pattern, times))

    # Exact complements of each length, longest first.
    for length in range(capacity, 0, -1):
        while stock.left[length]:
            rest = [] if length == capacity else stock.complement(capacity - length, Counter([length]))
            if rest is None:
                break
            use([length, *rest])
    # Residuals: best fit, trying to complete each new gap exactly.
    while stock.left.any():
        pattern, gap = [], capacity
        while gap:
            held = Counter(pattern)
            rest = stock.complement(gap, held) if pattern else None
            if rest:
                pattern += rest
                break
            fit = np.flatnonzero(stock.free(held)[: gap + 1] > 0)
            if not len(fit):
                break
            pattern.append(int(fit[-1]))
            gap -= pattern[-1]
        use(sorted(pattern, reverse=True))
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset, pieces a sequence) by rank."""
    used, sequence, out = Counter(), 0, {}
    for pattern, times in plan:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            m = pattern.count(length)
            out.setdefault(length, []).append((used[length], sequence, at, m))
            used[length] += m * times
            at += m * length
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, doc: str = "doc_id",
         text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc, piece, start, length, ids_crc32 (and ids), sequence_id and offset of every piece."""
    cut = materialize(pieces(docs, tokenizer_file, capacity, end_id, doc, text, with_ids))
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = cut.sparkSession.sparkContext.broadcast(places(plan_packing(counts, capacity)))
    ranked = cut.join(shift, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    out = ranked.select(doc, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[own[0]])
                rows = where.value[size]
                hit = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                n = rank[own] - hit[:, 0]
                sequence[own] = hit[:, 1] + n // hit[:, 3]
                offset[own] = hit[:, 2] + n % hit[:, 3] * size
            kept = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"],
            )

    return out.mapInArrow(place, out.drop("rank").schema.add("sequence_id", "long").add("offset", "long"))
