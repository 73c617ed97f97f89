"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding of a sentence-piece model has one valid last token at each prefix: the
token t that ends there and agrees with the last token of the prefix before t, which is the
case when the pair, encoded alone, stays those two tokens. So one pass over a text fills
count[i] = count[i - len(t)] + 1 for all prefixes, and questions about budgets and
truncation are lookups in that array.

No piece of the vocabulary holds a word mark after another character, nor a line end, so
the pass starts anew at each of those; states of prefixes of words are remembered (up to
`MEMO` of them in a worker) and shared by all words that begin alike.

A null text is empty and has 0 tokens at its one prefix. The count at prefix k is the count
of the first k code points encoded alone, without begin or end tokens. Rows are counted one by
one; repeated rows repeat; other columns are carried on only if named in `keep`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import held

MARK = "▁"
MEMO = 400_000
PAIRS = 1_000_000
LONG = 64
STEP = {n: bytes([n & 255]) for n in range(-128, 128)}
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")


class PrefixCounter:
    """Prefix counts under one sentence-piece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        # For each end of a piece: what may stand before it where it is a piece, else None.
        self.ends: dict[str, dict[str, bool] | None] = {}
        for piece in self.rank:
            for start in range(len(piece)):
                self.ends.setdefault(piece[start:], None)
            self.ends[piece] = {}
        self.agreed = 0
        self.memo: dict[str, tuple[tuple[str, ...], tuple[int, ...], bytes]] = {"": ((), (), b"")}
        whole = re.compile(f"{MARK}*[^{MARK}\n]*")
        if not all(whole.fullmatch(p) for p in self.rank):
            raise ValueError("a piece spans words or lines: this vocabulary can't be cut there")

    def encode(self, text: str) -> list[str]:
        """Merge the best adjacent pair, leftmost first, until none is a piece."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, before: str, token: str, known: dict[str, bool]) -> bool:
        """Whether the pair, encoded alone, stays these two tokens."""
        if self.agreed >= PAIRS:
            for own in self.ends.values():
                if own:
                    own.clear()
            self.agreed = 0
        self.agreed += 1
        fit = known[before] = self.encode(before + token) == ([before, token] if before else [token])
        return fit

    def extend(self, text: str, tokens: list[str], counts: list[int], end: int) -> None:
        """Append the last token and the count of text[:end] to those of shorter prefixes.

        Only one token fits. It is a piece, or a character unknown to the vocabulary, which
        becomes a token for each of its bytes."""
        ends, start = self.ends, end
        while start:
            start -= 1
            token = text[start:end]
            known = ends.get(token)
            if known is None:
                if token in ends:
                    continue  # the end of pieces, but none itself
                break
            before = tokens[start - 1] if start else ""
            fit = known.get(before)
            if fit is None:
                fit = self.agree(before, token, known)
            if fit:
                tokens.append(token)
                counts.append((counts[start - 1] if start else 0) + 1)
                return
        token = text[end - 1: end]  # unknown characters join nothing
        tokens.append(token)
        counts.append((counts[end - 2] if end > 1 else 0) + len(token.encode()))

    def increments(self, chunk: str) -> bytes:
        """Changes of the count from prefix to prefix, one signed byte each."""
        memo = self.memo
        if chunk in memo:
            return memo[chunk][2]
        if len(chunk) > LONG:
            tokens, counts = [], []
            for end in range(1, len(chunk) + 1):
                self.extend(chunk, tokens, counts, end)
            return np.diff(np.array([0, *counts])).astype(np.int8).tobytes()
        if len(memo) > MEMO:
            memo.clear()
            memo[""] = ((), (), b"")
        known = len(chunk) - 1
        while chunk[:known] not in memo:
            known -= 1
        had, sums, steps = memo[chunk[:known]]
        tokens, counts = list(had), list(sums)
        count = counts[-1] if counts else 0
        for end in range(known + 1, len(chunk) + 1):
            self.extend(chunk, tokens, counts, end)
            steps += STEP[counts[-1] - count]
            count = counts[-1]
            memo[chunk[:end]] = (tuple(tokens), tuple(counts), steps)
        return steps

    def counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ... len(text) code points."""
        if not text:
            return np.zeros(1, dtype=np.int64)
        chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
        memo = self.memo
        steps = b"".join([memo[c][2] if c in memo else self.increments(c) for c in chunks])
        counts = np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64)
        counts[0] = 0  # the mark before the first character counts with it
        return counts


def fits(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _counted(docs: DataFrame, model_file: str, keep: tuple[str, ...], text: str, results, fields: str) -> DataFrame:
    own = [f"c{i}" for i in range(len(keep))]  # a kept column may have any name, that of a result too
    rows = docs.select(*(F.col(k).alias(c) for k, c in zip(keep, own)), F.col(text).alias("text"))
    names = [f.split()[0] for f in fields.split(", ")]

    def count(batches):
        counter = held(("prefixes", model_file), lambda: PrefixCounter(model_file))
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                found = [results(t.as_py() or "", counter) for t in part.column("text")]
                columns = [pa.array(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), *columns], names=[*own, *names])

    kept = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in own)
    return rows.mapInArrow(count, kept + fields).toDF(*keep, *names)


def prefix_counts(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep and prefix_tokens: the count at every prefix, for later questions."""
    return _counted(docs, model_file, keep, text, lambda t, c: (c.counts(t),), "prefix_tokens array<bigint>")


def token_counts(docs: DataFrame, model_file: str, limit: int, keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text") -> DataFrame:
    """keep, n_bytes, n_tokens, over_limit and fit_chars: how many code points fit the limit."""

    def results(t: str, counter: PrefixCounter):
        counts = counter.counts(t)
        return len(t.encode()), int(counts[-1]), bool(counts[-1] > limit), fits(counts, limit)

    return _counted(docs, model_file, keep, text, results,
                    "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
