"""N-gram Jaccard join with adaptive multi-match prefixes, to near-duplicate components.

A document is the set of its distinct word shingles. All sets are put in one global order,
rare shingles first. Of two sets with Jaccard similarity of at least t, each shares at least
l shingles among its first n - ceil(t n) + l with such a prefix of the other. Each document
picks its own l: the estimated candidates of a longer prefix, each of which then needs more
shared shingles before it is verified, against those of a shorter one. A pair is judged by the
smaller l of the two.

Frequencies for the order come from counts in `SKETCH` hash buckets over all documents. They
decide the order and l, never whether a pair is found: any order gives the same links.

Equal sets are one node from the start, so copies are never compared. Candidates are verified
in two steps, so that a group of n near copies needs about n comparisons, not n * n:
  1. in every posting list, the node whose match comes first in its order leads; each node is
     verified with the leader it meets most often. Lists expected to be very long are dealt in
     parts with a leader each, whose components then meet the leader of the whole list;
  2. in lists that still hold several components, all pairs of different components that match
     often enough are verified. Pairs within a component can't change it.
So components are those of all links, whichever step finds them.

A node is the 64-bit hash of its set. Null and empty texts and texts without words have empty sets
and are linked with nothing. Texts of fewer words than a shingle are one shingle. Repeated rows are
copies. Null ids never name a component unless all its ids are null. Other columns are not read.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import (
    BASE, U64, ascii_space, held, lower_ascii, mix, sized, slices, span_hashes, table, window_hashes, word_spans,
)
from chronotext.session import materialize

SHINGLE = 5
SKETCH_BITS = 22
PART = 4096
MATCHES = 6           # longest l
VERIFY_COST = 8.0     # of a candidate, in postings
LIST_LIMIT = 50_000   # estimated postings of a shingle beyond which its list is dealt in parts
BLOCK = 512           # nodes compared with others at once
BROADCAST_ROWS = 500_000
PAIRS = 200_000       # pairs of a list held at once
SEEN = 1_000_000
PLACES = (1 << 28) - 1
SPACE, FOLD = ascii_space(), lower_ascii()


class Sets:
    """Shingle sets of the rows of a batch: sorted distinct hashes."""

    def __init__(self, size: int = SHINGLE):
        held()
        self.size = size

    def __call__(self, batch: pa.RecordBatch, text: str):
        data, offsets = table(batch, text)
        for i, j in slices(offsets):
            own, at = FOLD[data[offsets[i]: offsets[j]]], offsets[i: j + 1] - offsets[i]
            starts, ends, rows = word_spans(own, at, SPACE)
            words = span_hashes(own, starts, ends)
            shingles, where = window_hashes(words, rows, self.size)
            for r in range(j - i):
                n = rows[r + 1] - rows[r]
                if n >= self.size:
                    yield np.unique(shingles[where[r]: where[r + 1]])
                elif n:
                    few = words[rows[r]: rows[r + 1]]
                    yield window_hashes(few, np.array([0, n]), int(n))[0]
                else:
                    yield few_none


few_none = np.zeros(0, dtype=U64)


def node(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    total = (int(np.add.reduce(mix(shingles))) + len(shingles) * BASE) % (1 << 64)
    return int(mix(np.array([total], dtype=U64)).astype(np.int64)[0])


class Seen:
    """Nodes met in a task. Forgetting some only repeats work."""

    def __init__(self):
        self.nodes: set[int] = set()

    def first(self, key: int) -> bool:
        if key in self.nodes:
            return False
        if len(self.nodes) >= SEEN:
            self.nodes.clear()
        self.nodes.add(key)
        return True


def batch_of(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def profile(docs: DataFrame, kind: str) -> DataFrame:
    """doc, version, n, node of each row (node null for an empty set), and parts of the sketch."""

    def count(batches):
        sets, seen, sketch = Sets(), Seen(), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["doc", "version", "n", "node", "part", "counts"]
        for batch in batches:
            n, nodes, waiting, size = [], [], [], 0
            for s in sets(batch, "text"):
                key = node(s) if len(s) else None
                n.append(len(s))
                nodes.append(key)
                if key is not None and seen.first(key):
                    waiting.append((s >> U64(64 - SKETCH_BITS)).astype(np.int64))
                    size += len(s)
                    if size > 1 << 20:
                        sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
                        waiting, size = [], 0
            if waiting:
                sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield batch_of(names, batch.column("doc"), batch.column("version"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), *none)
        parts = [(i, p) for i, p in enumerate(sketch.reshape(-1, PART)) if p.any()]
        packed = pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for _, p in parts], pa.binary())
        none = pa.nulls(len(parts), pa.int64())
        yield batch_of(names, none.cast(types["doc"]), none, none, none, pa.array([i for i, _ in parts], pa.int32()), packed)

    from pyspark.sql.pandas.types import to_arrow_type

    types = {"doc": to_arrow_type(docs.schema["doc"].dataType)}
    return docs.mapInArrow(count, f"doc {kind}, version bigint, n bigint, node bigint, part int, counts binary")


def frequency_levels(profiled: DataFrame) -> np.ndarray:
    """Quarter powers of two of the counts of all buckets: four megabytes, whatever the input."""

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                own = np.frombuffer(zlib.decompress(counts.as_py()), dtype="<i8")
                totals[i] = totals[i] + own if i in totals else own
        yield batch_of(["part", "levels"], pa.array(list(totals), pa.int32()), pa.array(
            [np.round(4 * np.log2(np.maximum(t, 1))).astype(np.uint8).tobytes() for t in totals.values()], pa.binary()))

    parts = profiled.filter("part IS NOT NULL").select("part", "counts").repartition("part")
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in parts.mapInArrow(add, "part int, levels binary").collect():  # 1,024 rows
        levels[row["part"] * PART: (row["part"] + 1) * PART] = np.frombuffer(row["levels"], dtype=np.uint8)
    return levels


def base_prefix(n, top: int, bottom: int):
    """n - ceil(t n) + 1 for t = top / bottom."""
    return n - -(-n * top // bottom) + 1


def ordered_prefix(s: np.ndarray, levels: np.ndarray, typical: float, top: int, bottom: int):
    """(shingles of the prefix in order, their estimated lists, l) of one set."""
    n = len(s)
    level = levels[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")  # s is sorted, so ties are in order of the hash
    base = base_prefix(n, top, bottom)
    most = min(MATCHES, n - base + 1)
    pick = order[: base + most - 1]
    lists = np.maximum(np.exp2(level[pick] / 4.0) - typical, 0.0) + 1.0
    reach = np.cumsum(lists - 1.0)[base - 1:]
    # Longer prefixes cost their own postings too, and divide the candidates.
    wanted = np.arange(1, most + 1)
    best = int(np.argmin(reach * (1 + VERIFY_COST / wanted) + wanted))
    return s[pick[: base + best]], lists[: base + best], best + 1


def postings(docs: DataFrame, levels: np.ndarray, top: int, bottom: int) -> DataFrame:
    """token, salt, parts, node and info (n, place in the prefix and l) of each node's prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    typical = float(np.exp2(np.median(levels) / 4.0)) if levels.any() else 0.0

    def emit(batches):
        sets, seen, lv = Sets(), Seen(), shared.value
        for batch in batches:
            out, size = [], 0
            for s in sets(batch, "text"):
                if not len(s) or not seen.first(key := node(s)):
                    continue
                tokens, lists, wanted = ordered_prefix(s, lv, typical, top, bottom)
                parts = np.ceil(lists / LIST_LIMIT).astype(np.int64)
                info = (np.int64(len(s)) << 32) | (np.arange(len(tokens), dtype=np.int64) << 4) | wanted
                out.append((tokens.astype(np.int64), parts, np.full(len(tokens), key), info))
                size += len(tokens)
                if size > 50_000:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

    def pack(out):
        token, parts, key, info = (np.concatenate(c) for c in zip(*out))
        salt = np.where(parts > 1, np.abs(key) % parts, 0)
        return batch_of(["token", "salt", "node", "info"], token, ((parts << 32) | salt), key, info)

    return docs.mapInArrow(emit, "token bigint, salt bigint, node bigint, info bigint")


def runs(batches, key: list[str]):
    """Concatenated columns, cut so that rows of equal key stay together. The input is sorted by
    key; a run has a bounded number of rows."""
    held = None
    for batch in batches:
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            own = {c: np.concatenate([held[c], own[c]]) for c in own}
        n = len(own[key[0]])
        if not n:
            continue
        differs = np.zeros(n, dtype=bool)
        for c in key:
            differs |= own[c] != own[c][-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        held = {c: a[cut:] for c, a in own.items()}
        if cut:
            yield {c: a[:cut] for c, a in own.items()}
    if held is not None and len(held[key[0]]):
        yield held


def shared_postings(found: DataFrame) -> DataFrame:
    """Postings of tokens that more than one node has, each (token, node) once, with the leader of
    the list: the node whose match has the first place in its own order (lead, lead_n), and the
    number of parts the list is dealt in."""

    def keep(batches):
        for own in runs(batches, ["token", "salt"]):
            token, salt, key = own["token"], own["salt"], own["node"]
            new = np.ones(len(token), dtype=bool)  # rows are sorted by node within a list
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (key[1:] != key[:-1])
            token, salt, key, info = (own[c][new] for c in ("token", "salt", "node", "info"))
            begins = np.ones(len(token), dtype=bool)
            begins[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            begins = np.flatnonzero(begins)
            sizes = np.diff(np.append(begins, len(token)))
            place = (info >> 4) & PLACES
            first = np.lexsort((key, place, np.repeat(np.arange(len(sizes)), sizes)))[begins]
            lead, parts = np.repeat(first, sizes), salt >> 32
            several = (np.repeat(sizes, sizes) > 1) | (parts > 1)
            yield batch_of(
                ["token", "node", "info", "lead", "lead_n", "parts"], token[several], key[several], info[several],
                key[lead][several], (info >> 32)[lead][several], parts[several])

    dealt = found.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return dealt.mapInArrow(keep, "token bigint, node bigint, info bigint, lead bigint, lead_n bigint, parts bigint")


def n_of(info):
    return F.shiftrightunsigned(info, 32)


def near_sizes(a, b, top: int, bottom: int):
    return (F.least(a, b) * bottom) >= (F.greatest(a, b) * top)


def best_leader(met: DataFrame, top: int, bottom: int) -> DataFrame:
    """(a, b): each component's node with the leader that it meets most often.

    `met` has comp, a and a_n (the leader), b and b_n (the node), a row for each meeting."""
    met = met.filter(near_sizes(F.col("a_n"), F.col("b_n"), top, bottom))
    counted = met.groupBy("comp", "a", "b").agg(F.count(F.lit(1)).alias("times"))
    best = counted.groupBy("comp").agg(F.max(F.struct("times", "a", "b")).alias("best"))
    return best.select("best.a", "best.b")


def first_leaders(lists: DataFrame, top: int, bottom: int) -> DataFrame:
    """Pairs of the nodes with leaders of their lists."""
    met = lists.filter("node <> lead").select(
        F.col("node").alias("comp"), F.col("lead").alias("a"), F.col("lead_n").alias("a_n"), F.col("node").alias("b"),
        n_of(F.col("info")).alias("b_n"))
    return best_leader(met, top, bottom)


def leaders_of_parts(lists: DataFrame, top: int, bottom: int) -> DataFrame:
    """The same over whole lists that were dealt in parts, and their components."""
    split = lists.filter("parts > 1")
    place = F.shiftrightunsigned("info", 4).bitwiseAND(F.lit(PLACES))
    one = F.struct(place.alias("place"), "node", "comp", "info")
    lead = split.groupBy("token").agg(F.min(one).alias("lead")).select(
        "token", F.col("lead.node").alias("a"), F.col("lead.comp").alias("a_comp"), n_of(F.col("lead.info")).alias("a_n"))
    members = split.select("token", "comp", F.col("node").alias("b"), n_of(F.col("info")).alias("b_n"))
    return best_leader(members.join(lead, "token").filter("comp <> a_comp"), top, bottom)


def cross_pairs(left, right, own, limits, top: int, bottom: int, twice: bool):
    """(a, b) of rows of `left` and `right` (places in the columns `own`) of different components
    that meet within the first n - o + 1 shingles of both, where o is the least overlap for their
    two sizes. With `twice` each pair is met in both orders."""
    n, place, least, most = limits
    right = right[np.argsort(n[right], kind="stable")]
    sizes = n[right]
    first = np.searchsorted(sizes, least[left], side="left")
    count = np.maximum(np.searchsorted(sizes, most[left], side="right") - first, 0)
    # As many rows at once as have PAIRS partners together, or one row.
    total, lo = np.cumsum(count), 0
    while lo < len(left):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        some = count[lo:hi]
        i = np.repeat(left[lo:hi], some)
        j = right[np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(first[lo:hi], some)]
        lo = hi
        past = -(-(n[i] + n[j]) * top // (top + bottom)) - 1
        ok = (own["comp"][i] != own["comp"][j]) & (place[i] < n[i] - past) & (place[j] < n[j] - past)
        a, b = own["node"][i], own["node"][j]
        if twice:
            ok &= a < b
        if ok.any():
            yield np.minimum(a, b)[ok], np.maximum(a, b)[ok]


def in_batches(pairs):
    """Batches of about PAIRS (a, b) rows, so that no task holds all pairs of a list."""
    held, size = [], 0
    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size >= PAIRS:
            yield batch_of(["a", "b"], *(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0
    if held:
        yield batch_of(["a", "b"], *(np.concatenate(c) for c in zip(*held)))


def pair_limits(own, top: int, bottom: int):
    """Sizes and places of postings, and the sizes a partner may have: near the own, and such that
    this shingle lies in the prefix of a pair, which is the shorter the larger the overlap that
    the sizes ask for."""
    n, place = own["info"] >> 32, (own["info"] >> 4) & PLACES
    most = np.minimum(n * bottom // top, (n - place) * (top + bottom) // top - n)
    return n, place, -(-n * top // bottom), most


def starts(own, key: list[str]) -> list[int]:
    change = np.ones(len(own[key[0]]), dtype=bool)
    change[1:] = np.any([own[c][1:] != own[c][:-1] for c in key], axis=0)
    return [*np.flatnonzero(change), len(change)]


def different_components(lists: DataFrame, top: int, bottom: int) -> DataFrame:
    """(a, b): all pairs of nodes of different components that match often enough.

    Pairs first have to meet within the shortest prefix that their sizes allow, where shingles are
    rarest; of those pairs the l-prefixes are compared (see `matched`). In a list the rows outside its largest component meet all rows. Lists dealt in parts are
    compared block by block, so no task holds one."""

    def compare(batches):
        for own in runs(batches, ["token"]):
            limits, edges = pair_limits(own, top, bottom), starts(own, ["token"])

            def pairs():
                for lo, hi in zip(edges, edges[1:]):
                    comps, sizes = np.unique(own["comp"][lo:hi], return_counts=True)
                    if len(comps) > 1:
                        at, main = np.arange(lo, hi), own["comp"][lo:hi] == comps[np.argmax(sizes)]
                        yield from cross_pairs(at[~main], at[main], own, limits, top, bottom, False)
                        yield from cross_pairs(at[~main], at[~main], own, limits, top, bottom, True)

            yield from in_batches(pairs())

    fields = "a bigint, b bigint"
    whole = lists.filter("parts = 1").select("token", "node", "info", "comp").repartition("token").sortWithinPartitions("token")
    met = whole.mapInArrow(compare, fields).unionByName(in_blocks(lists.filter("parts > 1"), top, bottom, fields))
    return matched(materialize(met.distinct()), lists, top, bottom)


def matched(pairs: DataFrame, lists: DataFrame, top: int, bottom: int) -> DataFrame:
    """The pairs (a, b) with l matches within both l-prefixes, l being the smaller of the two, or
    more where their sizes need it: beyond the prefix that ends first there are only
    ceil(t n) - l shingles."""
    one = lists.select("node", "token", n_of(F.col("info")).alias("n"), F.expr("info & 15").alias("l"),
                       F.expr(f"shiftrightunsigned(info, 4) & {PLACES}").alias("place"))
    one = one.withColumn("level", F.expr(f"greatest(place - (n - ((n * {top} + {bottom - 1}) div {bottom}) + 1) + 2, 1)"))
    ends = sized(pairs, BROADCAST_ROWS)
    a, b = (
        one.join(ends.withColumnRenamed(side, "node"), "node").select(
            F.col("node").alias(side), other, "token", *(F.col(c).alias(f"{side}_{c}") for c in ("n", "l", "level")))
        for side, other in (("a", "b"), ("b", "a"))
    )
    met = a.join(b, ["a", "b", "token"]).withColumn("l", F.least("a_l", "b_l"))
    met = met.filter(F.greatest("a_level", "b_level") <= F.col("l")).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("times"), F.max("l").alias("l"), F.max("a_n").alias("x"), F.max("b_n").alias("y"))
    need = (f"greatest(l, ((x + y) * {top} + {top + bottom - 1}) div {top + bottom}"
            f" - ((greatest(x, y) * {top} + {bottom - 1}) div {bottom} - l))")
    return met.filter(F.col("times") >= F.expr(need)).select("a", "b")


def in_blocks(lists: DataFrame, top: int, bottom: int, fields: str) -> DataFrame:
    """Meetings of different components in lists of any length: blocks of the rows outside the
    largest component meet all blocks."""
    sizes = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    mixed = sizes.groupBy("token").agg(
        F.max(F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("comps")
    ).filter("comps > 1").select(
        "token", F.col("main.comp").alias("main"),
        F.ceil(F.col("main.rows") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("all") - F.col("main.rows")) / BLOCK).cast("int").alias("other_blocks"),
    )
    rows = lists.join(mixed, "token").withColumn("is_main", F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    rows = rows.withColumn("own", own)

    def group(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # Group (x, y) with y >= 0: other block x with main block y; (x, -1 - y): other blocks x <= y.
    with_main = F.transform(upto(F.col("other_blocks")), lambda x: group(x, F.col("own")))
    as_other = F.concat(
        F.transform(upto(F.col("main_blocks")), lambda y: group(F.col("own"), y)),
        F.transform(upto(F.col("other_blocks")), lambda y: group(F.least(F.col("own"), y), -1 - F.greatest(F.col("own"), y))),
    )
    dealt = rows.withColumn("g", F.explode(F.when(F.col("is_main"), with_main).otherwise(as_other)))
    dealt = dealt.select("token", "g.x", "g.y", "is_main", "own", "node", "info", "comp")
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")

    def compare_blocks(batches):
        for own in runs(batches, ["token", "x", "y"]):
            limits, edges = pair_limits(own, top, bottom), starts(own, ["token", "x", "y"])

            def pairs():
                for lo, hi in zip(edges, edges[1:]):
                    at, main, x, y = np.arange(lo, hi), own["is_main"][lo:hi], own["x"][lo], own["y"][lo]
                    block = own["own"][lo:hi]
                    if y >= 0:
                        left, right = at[~main], at[main]
                    else:
                        left, right = at[block == x], at[block == -1 - y]
                    yield from cross_pairs(left, right, own, limits, top, bottom, x == -1 - y)

            yield from in_batches(pairs())

    return dealt.mapInArrow(compare_blocks, fields)


def set_table(docs: DataFrame, first_ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted shingles (bytes), of the given nodes at least, from their texts."""
    ids = materialize(first_ids.join(nodes, "node", "left_semi").select("doc"))
    wanted = docs.join(sized(ids, BROADCAST_ROWS), "doc", "left_semi")
    wanted = wanted.union(docs.filter("doc IS NULL"))

    def emit(batches):
        sets, seen = Sets(), Seen()
        for batch in batches:
            rows = [(key, s.tobytes()) for s in sets(batch, "text") if len(s) and seen.first(key := node(s))]
            for some in (rows[i: i + 1000] for i in range(0, len(rows), 1000)):
                yield batch_of(["node", "shingles"], pa.array([k for k, _ in some], pa.int64()),
                               pa.array([b for _, b in some], pa.binary()))

    return wanted.select("text").mapInArrow(emit, "node bigint, shingles binary")


def verified(pairs: DataFrame, docs: DataFrame, first_ids: DataFrame, top: int, bottom: int) -> DataFrame:
    """The pairs (a, b) of Jaccard similarity at least top / bottom."""
    sets = {c: set_table(docs, first_ids, pairs.select(F.col(c).alias("node")).distinct()).toDF(c, f"{c}_set") for c in "ab"}
    both = sets["a"].join(sized(pairs, BROADCAST_ROWS), "a").join(sets["b"], "b")

    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int(np.count_nonzero(y[at] == x))
                keep.append(bottom * shared >= top * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.select("a", "b", "a_set", "b_set").mapInArrow(judge, "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node reachable) of all linked nodes, by alternating stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        edges = materialize(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("comp", F.col("node"))
    return lists.join(sized(labels, BROADCAST_ROWS), "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.75) -> DataFrame:
    """doc, version (hash of the text), n_shingles and component_id (the smallest id reachable by links) of each row."""
    share = Fraction(str(threshold))
    top, bottom = share.numerator, share.denominator
    docs = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    kind = docs.schema["doc"].dataType.simpleString()
    profiled = materialize(profile(docs, kind))
    lists = materialize(shared_postings(postings(docs, frequency_levels(profiled), top, bottom)))
    rows = profiled.filter("part IS NULL").select("doc", "version", "n", "node")
    first_ids = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"))
    docs = docs.select("doc", "text")
    links = labels = None
    for step in (first_leaders, leaders_of_parts, different_components):
        pairs = materialize(step(labelled(lists, labels), top, bottom))
        if pairs.isEmpty():
            continue
        found = verified(pairs, docs, first_ids, top, bottom)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = materialize(components(links))
    ids = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least"))
    named = labelled(ids, labels)
    # Only components of several nodes need another shuffle to find their least id.
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(least, "comp").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        F.col("doc").alias(doc), "version", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.75) -> DataFrame:
    """One document of each component, all columns: that of the smallest id. Documents without
    words are in no group and stay. An id that several rows have stays once for each text."""
    found = near_duplicates(docs, doc, text, threshold)
    gone = found.filter(~F.col(doc).eqNullSafe(F.col("component_id"))).select(
        F.col(doc).alias("__doc"), F.col("version").alias("__version")).distinct()
    left = docs.join(
        gone, F.col(doc).eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__version")), "left_anti")
    repeated = found.groupBy(doc).count().filter(F.col("count") > 1).select(F.col(doc).alias("__doc"))
    repeated = materialize(repeated)
    if repeated.isEmpty():
        return left
    again = F.col(doc).eqNullSafe(F.col("__doc"))
    return left.join(repeated, again, "left_anti").unionByName(
        left.join(repeated, again, "left_semi").dropDuplicates([doc, text]))
