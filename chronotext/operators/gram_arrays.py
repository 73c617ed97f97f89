"""Gram counts and code lengths of whole documents on arrays, a batch of documents at a time.

A gram is a document's number in its batch and its characters' numbers in the batch's alphabet, packed into 63 bits.
Sorted, the grams of a document and of a context lie together, so counts, context totals and document totals
are sums over runs. A reference model is a tree of arrays: the node of a gram hangs on the node of its context.
Rows of one id are one document: counts are summed, no gram crosses from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

BATCH_CHARS = 1 << 20  # characters coded at once; a longer document is a batch of its own
WIDTH = 63  # bits of a packed gram
TABLE_BITS = 22  # up to here grams are numbered by a table, beyond by sorting
MOST_ORDER = 2  # with 21 bits a character the longest grams that always fit


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def n_log_n(n: np.ndarray) -> np.ndarray:
    return n * np.log2(np.maximum(n, 1))


def characters(batches: Iterable[pa.RecordBatch]) -> list[str]:
    """The distinct characters of all texts of a task."""
    found, waiting, chars = np.zeros(1 << 21, dtype=bool), [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            waiting.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                found[code_points("".join(waiting))] = True
                waiting, chars = [], 0
    found[code_points("".join(waiting))] = True
    return [chr(c) for c in np.flatnonzero(found)]


def numbered(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values below 2^bits, and the place of each value among them."""
    if bits > TABLE_BITS:
        return np.unique(values, return_inverse=True)
    found = np.zeros(1 << bits, dtype=bool)
    found[values] = True
    distinct = np.flatnonzero(found)
    place = np.zeros(1 << bits, dtype=np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[values]


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted keys, -1 if it does not."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Tree:
    """Counts of a reference by context length. A node of level j is a gram of j+1 characters, named by the node of
    its first j characters (0 at level 0) times `len(symbols)` plus the number of its last one; `keys[j]` is sorted and `n[j]` its
    counts. T, D, Q and X of a context of length j stand at its node of level j-1, or at 0 for the empty context."""

    symbols: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    n: list[np.ndarray] = field(default_factory=list)
    T: list[np.ndarray] = field(default_factory=list)
    D: list[np.ndarray] = field(default_factory=list)
    Q: list[np.ndarray] = field(default_factory=list)
    X: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, grams: pa.Table, order: int) -> Tree:
        """From (level, g, n) of all levels 0..order."""
        level, n = grams["level"].to_numpy(), grams["n"].to_numpy()
        points = [code_points("".join(grams["g"].filter(pa.array(level == j)).to_pylist())).reshape(-1, j + 1)
                  for j in range(order + 1)]
        tree = cls(np.sort(points[0][:, 0]))
        size, shorter = max(1, len(tree.symbols)), np.zeros(1, dtype=np.int64)
        for j, rows in enumerate(points):
            numbers = np.searchsorted(tree.symbols, rows).astype(np.int64)
            context = np.zeros(len(rows), dtype=np.int64)
            for i in range(j):
                context = np.searchsorted(tree.keys[i], context * size + numbers[:, i])
            key = context * size + numbers[:, j]
            order_of = np.argsort(key)
            key, count = key[order_of], n[level == j][order_of]
            context, symbol = key // size, key % size
            nodes = len(tree.keys[-1]) if j else 1
            # The gram without its first character: the tail of the context, then the symbol.
            tail = np.searchsorted(tree.keys[-1], shorter[context] * size + symbol) if j else np.zeros(len(key), dtype=np.int64)
            below = np.bincount(context, tree.n[-1][tail], nodes) if j else np.zeros(1)
            tree.T.append(np.bincount(context, count, nodes))
            tree.D.append(np.bincount(context, minlength=nodes).astype(float))
            tree.Q.append(np.bincount(context, n_log_n(count), nodes))
            tree.X.append(below)
            tree.keys.append(key)
            tree.n.append(count)
            shorter = tail
        return tree

    def nodes(self, alphabet: np.ndarray, grams: list[Grams]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each distinct gram by level: its node and its context's, -1 if the reference has none."""
        size, number, out = max(1, len(self.symbols)), places(self.symbols, alphabet), []
        for j, g in enumerate(grams):
            context = out[-1][0][g.context] if j else np.zeros(len(g.distinct), dtype=np.int64)
            symbol = number[g.distinct & ((1 << g.bits) - 1)]
            known = (context >= 0) & (symbol >= 0)
            out.append((np.where(known, places(self.keys[j], np.where(known, context * size + symbol, -1)), -1), context))
        return out

    def at(self, values: list[np.ndarray], j: int, context: np.ndarray) -> np.ndarray:
        """A total of contexts of length j by their nodes, 0 where the reference has none."""
        return np.where(context >= 0, values[j][context], 0.0) if len(values[j]) else np.zeros(len(context))

    def costs(self, grams: list[Grams], nodes: list[tuple[np.ndarray, np.ndarray]], alphabet_size: int) -> list[np.ndarray]:
        """Bits of each distinct gram's symbol after its context, by level; see `ngrams.price_grams`."""
        out, nowhere = [], np.log2(max(1.0, alphabet_size - self.D[0][0]))
        for top, (node, context) in enumerate(nodes):
            seen = np.log2(self.at(self.T, top, context) + self.at(self.D, top, context)) - np.log2(
                np.where(node >= 0, self.n[top][node] if len(self.n[top]) else 0.0, 1.0))
            new = np.flatnonzero(node < 0)
            chain = {top: new}
            for j in range(top, 0, -1):  # the same gram without its first characters
                chain[j - 1] = grams[j].tail[chain[j]]
            cost = np.full(len(new), nowhere)
            for j in range(top + 1):
                node_j, context_j = (x[chain[j]] for x in nodes[j])
                T, D = self.at(self.T, j, context_j), self.at(self.D, j, context_j)
                reached = T > 0
                if j < top:  # what the next longer context has already excluded
                    longer = nodes[j + 1][1][chain[j + 1]]
                    T, D = T - self.at(self.X, j + 1, longer), D - self.at(self.D, j + 1, longer)
                cost = np.where(reached & (D > 0), np.log2(T + D) - np.log2(D) + cost, cost)
                if j < top and len(self.n[j]):
                    cost = np.where(node_j >= 0, np.log2(T + D) - np.log2(np.where(node_j >= 0, self.n[j][node_j], 1)), cost)
            seen[new] = cost
            out.append(seen)
        return out


@dataclass
class Grams:
    """The grams of one level: a run of equal keys is a gram of a document."""

    bits: int  # of a character
    keys: np.ndarray  # (document, gram) packed, sorted, each once
    n: np.ndarray  # counts inside the texts
    joint: np.ndarray  # the same, and windows that end in the tail
    heads: np.ndarray  # places of grams that open a text
    distinct: np.ndarray  # the grams of all documents, sorted
    which: np.ndarray  # place of each key's gram among the distinct ones
    starts: np.ndarray  # where a context's run begins
    of: np.ndarray  # each run's document
    context: np.ndarray | None = None  # of each distinct gram: its first characters, its last ones, one level down
    tail: np.ndarray | None = None


def count_grams(codes: np.ndarray, doc: np.ndarray, lengths: np.ndarray, tail: int, order: int) -> tuple[np.ndarray, list[Grams]] | None:
    """The batch's alphabet and its grams by level. `codes` has each text with `tail` characters after it, `doc` each
    text's document in ascending numbers, `lengths` the texts' own characters. None if a gram has no room."""
    alphabet, symbol = numbered(codes, 21) if len(codes) > 1 << 16 else np.unique(codes, return_inverse=True)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if int(doc[-1]).bit_length() + (order + 1) * bits > WIDTH:
        return None
    ends = np.cumsum(lengths + tail)
    left = np.repeat(ends, lengths + tail) - np.arange(len(codes)) - tail  # own characters from here on
    first, key, out = ends - lengths - tail, np.repeat(doc, lengths + tail), []
    for j in range(order + 1):
        size = (j + 1) * bits
        key = (key[:len(key) - (j > 0)] << bits) | symbol[j:]
        own = left[:len(key)]
        keys = np.sort(key[(own > 0) & (own + tail > j)])
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        joint = np.diff(np.append(new, len(keys)))
        keys, n = keys[new], joint
        if tail and j:
            n = joint.copy()
            np.subtract.at(n, np.searchsorted(keys, key[(own > 0) & (own <= j) & (own + tail > j)]), 1)
        heads = np.searchsorted(keys, np.unique(key[first[lengths + tail > j]]))
        distinct, which = numbered(keys & ((1 << size) - 1), size)
        run = keys >> bits
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, dtype=np.int64)
        grams = Grams(bits, keys, n, joint, heads, distinct, which, starts, run[starts] >> (j * bits))
        if j:
            shorter = out[-1].distinct  # a tail may begin outside the texts; then it is asked for by nothing
            grams.context = np.searchsorted(shorter, distinct >> bits)
            grams.tail = np.minimum(np.searchsorted(shorter, distinct & ((1 << (size - bits)) - 1)), len(shorter) - 1)
        out.append(grams)
    return alphabet, out


def _runs(values: np.ndarray, g: Grams) -> np.ndarray:
    return np.add.reduceat(values, g.starts) if len(g.starts) else np.zeros(0)


def _opening(counts: np.ndarray, g: Grams, heads: np.ndarray) -> np.ndarray:
    """Of each context the largest count of a gram that opens a text, or 0."""
    out = np.zeros(len(g.starts))
    np.maximum.at(out, np.searchsorted(g.starts, heads, "right") - 1, counts[heads])
    return out


def code(grams: list[Grams], docs: int, order: int, alphabet: np.ndarray, model: Tree | None, alphabet_size: int,
         joint: Tree | None, body: dict[int, float]) -> list[np.ndarray]:
    """The columns of `ngrams.document_code` of each document."""
    def by_doc(of, values):
        return np.bincount(of, values, docs)

    with np.errstate(divide="ignore", invalid="ignore"):
        ends, opens = [], []  # by level: bits of all symbols, and of those that open a text
        ref_ends, ref_opens, joint_ends, joint_opens = [], [], [], []
        nodes = model.nodes(alphabet, grams) if model is not None else []
        costs = model.costs(grams, nodes, alphabet_size) if model is not None else []
        known = nodes if joint is model else joint.nodes(alphabet, grams) if joint is not None else []
        for j, g in enumerate(grams):
            T, D, Q = _runs(g.n, g), _runs((g.n > 0).astype(np.int64), g), _runs(n_log_n(g.n), g)
            own = g.heads[g.n[g.heads] > 0]
            opening = _opening(g.n, g, own)
            total = np.log2(np.maximum(T + D, 1))
            ends.append(by_doc(g.of, T * total - Q))
            opens.append(by_doc(g.of, np.where(opening > 0, total - np.log2(np.maximum(opening, 1)), 0.0)))
            if not j:
                chars, h = by_doc(g.of, T), np.log2(T) - Q / T
                entropy = by_doc(g.of, np.where(D > 1, h, 0.0))
            if model is not None:
                bits, of = costs[j][g.which], g.keys >> ((j + 1) * g.bits)
                ref_ends.append(by_doc(of, np.where(g.n > 0, g.n * bits, 0.0)))
                ref_opens.append(by_doc(of[own], bits[own]))
            if joint is not None:
                node, context = (x[g.which] for x in known[j])
                before = np.where(node >= 0, joint.n[j][node] if len(joint.n[j]) else 0, 0)
                after = before + g.joint
                context = context[g.starts]
                T0, D0, Q0 = (joint.at(x, j, context) for x in (joint.T, joint.D, joint.Q))
                T1, D1 = T0 + _runs(g.joint, g), D0 + _runs((before == 0).astype(np.int64), g)
                rise = _runs(n_log_n(after) - n_log_n(before), g)
                total = np.log2(T1 + D1)
                was = np.where(T0 > 0, T0 * np.log2(np.maximum(T0 + D0, 1)) - Q0, 0.0)
                opening = _opening(after, g, g.heads)
                joint_ends.append(by_doc(g.of, T1 * total - (Q0 + rise) - was))
                joint_opens.append(by_doc(g.of, np.where(opening > 0, total - np.log2(np.maximum(opening, 1)), 0.0)))
    orders, out = range(1, order + 1), [chars.astype(np.int64), entropy]
    out += [ends[k] + sum(opens[:k]) for k in orders]
    if model is not None:
        out += [ref_ends[k] + sum(ref_opens[:k]) for k in orders]
    if joint is not None:
        out += [body[k] + joint_ends[k] + sum(joint_opens[:k]) for k in orders]
    return out


def code_texts(ids: list, texts: list[str], order: int, tail: str, *models) -> list[tuple[list, list[np.ndarray]]]:
    """(ids, columns) of texts that lie together by id; in parts where the packed grams have no room."""
    change = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    doc = np.zeros(len(ids), dtype=np.int64)
    doc[change[1:]] = 1
    doc = np.cumsum(doc)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    found = count_grams(code_points("".join(t + tail for t in texts)), doc, lengths, len(tail), order)
    if found is None:
        half = change[len(change) // 2]
        return code_texts(ids[:half], texts[:half], order, tail, *models) + code_texts(ids[half:], texts[half:], order, tail, *models)
    alphabet, grams = found
    return [([ids[i] for i in change], code(grams, len(change), order, alphabet, *models))]


def documents(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of whole documents, from batches in which the texts of an id follow each other."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if chars >= most and key != ids[-1]:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(key)
            texts.append(text)
            chars += len(text)
    if ids:
        yield ids, texts


def window_counts(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """(grams, counts) of the windows of order+1 characters of batches (opens, text), with
    the prefixes of 1..order characters of texts that open."""
    def counted(texts: list[str]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        found = count_grams(code_points("".join(texts)), np.zeros(len(texts), dtype=np.int64), lengths, 0, order)
        if found is None:  # only beyond MOST_ORDER
            raise ValueError("grams too long to be packed")
        alphabet, g = found[0], found[1][order]
        points = alphabet[np.stack([(g.keys >> ((order - i) * g.bits)) & ((1 << g.bits) - 1) for i in range(order + 1)], axis=1)]
        whole = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[i:i + order + 1] for i in range(0, len(whole), order + 1)], g.n

    texts, chars = [], 0
    for batch in batches:
        for opens, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if opens:
                heads = [text[:k] for k in range(1, min(order, len(text)) + 1)]
                yield heads, np.ones(len(heads), dtype=np.int64)
            texts.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield counted(texts)
                texts, chars = [], 0
    if texts:
        yield counted(texts)
