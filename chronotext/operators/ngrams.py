"""Compression features as n-gram counting.

The model is prediction by partial matching, method C with exclusion (Moffat 1990;
Begleiter, El-Yaniv and Yona 2004). After a context c seen T times with D distinct
next symbols, a seen symbol costs -log2(N / (T + D)) bits and falling to the next
shorter context costs -log2(D / (T + D)); symbols of the longer context are excluded
below it, and below the empty context the code is uniform over the rest of the
alphabet.

A gram is a context and its symbol in one string. The text travels once, hashed on
the document key; counting grams, context totals and document totals then all stay
inside that partitioning, for the text's own code, the code under a reference and the
code of text and reference joined. Each text is cut into overlapping spans before it is
taken apart, so a long document never becomes one huge array. The spans of a document
longer than LONG are dealt to tasks of their own, and its counts are summed by gram.

Codes up to order 2 of documents that a task takes whole are sums over sorted arrays (`gram_arrays`), with a small
reference model in arrays too. Long documents, larger models and longer grams go by DataFrame sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from chronotext.operators import gram_arrays
from chronotext.operators.ordering import hash_rank
from chronotext.session import at_most, find_package, materialize, text_partitions, text_sizes

SPAN = 16_384
LONG = 1 << 20  # characters a task takes of one document


def _windows(text: Column, size: int) -> Column:
    """All character windows of a size, by code point, in order."""
    pattern = rf"(?s)(?=(.{{{size}}}))." if size > 1 else "(?s)(.)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def by_length(texts: DataFrame, longest: int | None = None) -> list[tuple[DataFrame, bool]]:
    """The texts that one task takes whole, and, where there are any, the long ones, whose spans are dealt to many."""
    longest, long = text_sizes(texts)[1] if longest is None else longest, F.length("text") > LONG
    if longest <= LONG:
        return [(texts, False)]
    return [(texts.filter(~long), False), (texts.filter(long), True)]


def document_sizes(texts: DataFrame, id_col: str = "file_name") -> tuple[int, int]:
    """Characters of all texts, and of the longest document; texts of one id are one document."""
    row = _sizes(texts, id_col).agg(F.sum("_chars"), F.max("_chars")).first()
    return row[0] or 0, row[1] or 0


def _sizes(texts: DataFrame, id_col: str) -> DataFrame:
    return texts.groupBy(id_col).agg(F.sum(F.length("text").cast("bigint")).alias("_chars"))


def by_document(texts: DataFrame, longest: int, id_col: str = "file_name") -> list[tuple[DataFrame, bool]]:
    """As `by_length`, by the documents' characters."""
    if longest <= LONG:
        return [(texts, False)]
    long = materialize(_sizes(texts, id_col).filter(F.col("_chars") > LONG).select(F.col(id_col).alias("_long")))
    same = F.col(id_col).eqNullSafe(F.col("_long"))
    return [(texts.join(long, same, "left_anti"), False), (texts.join(long, same, "left_semi"), True)]


def placed(texts: DataFrame, partitions: int, id_col: str = "file_name") -> DataFrame:
    """(id, text) of the texts that are not empty, dealt by document."""
    return texts.select(id_col, "text").filter(F.length("text") > 0).repartition(partitions, id_col)


def raw_grams(
    texts: DataFrame, order: int, id_col: str = "file_name", tail: str = "", dealt: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Counts (id, gram, n) of each window of order+1 characters, and of the prefixes of
    1..order characters: they are the symbols at the start of a text, where the context is shorter.

    With a `tail`, the windows of 2..order+1 characters that start in the text and end in the tail
    following it are added, in rows with a `joint` of 1, or 2 where one opens the text; others have 0. `dealt`
    spreads each document's spans over the tasks.
    """
    size, text = order + 1, F.col("text")
    rows, n = texts.select(id_col, "text").filter(F.length("text") > 0), partitions or text_partitions(texts)
    if not dealt:
        rows = rows.repartition(n, id_col)
    last = F.length("text") - 1
    spans = rows.select(
        id_col, F.explode(F.sequence(F.lit(0), last, F.lit(SPAN))).alias("_from"), "text"
    ).select(
        id_col, "_from", F.expr(f"substring(text, _from + 1, {SPAN + order})").alias("_s"),
        # The text's end is carried by the span that holds its last character.
        F.when(F.col("_from") + SPAN > last, F.right(text, F.lit(size))).alias("_end"),
    )
    if dealt:
        spans = spans.repartition(n, id_col, "_from")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(order), F.length("_s"))),
        lambda j: F.left(F.col("_s"), j),
    )
    grams = _windows(F.col("_s"), size)
    grams = F.when(F.col("_from") == 0, F.concat(prefixes, grams)).otherwise(grams)
    if not tail:
        return spans.select(id_col, F.explode(grams).alias("gram")).groupBy(id_col, "gram").agg(
            F.count(F.lit(1)).alias("n"))
    crossing = [
        F.when(F.length("_end") >= k, F.struct(
            F.concat(F.right(F.col("_end"), F.lit(k)), F.lit(tail[:m - k])).alias("gram"),
            F.when((F.col("_from") == 0) & (F.length("_end") == k), 2).otherwise(1).alias("joint")))
        for k in range(1, size) for m in range(k + 1, size + 1) if m - k <= len(tail)
    ]
    grams = F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(0).alias("joint")))
    return (
        spans.select(id_col, F.inline(F.concat(grams, F.array_compact(F.array(*crossing)))))
        .groupBy(id_col, "gram", "joint")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_gram(grams: DataFrame) -> DataFrame:
    """(.., gram, n) as (.., ctx, sym, n)."""
    size = F.length("gram")
    return grams.select(
        *[c for c in grams.columns if c not in ("gram", "n")],
        F.left(F.col("gram"), size - 1).alias("ctx"), F.right(F.col("gram"), F.lit(1)).alias("sym"),
        "n",
    )


def char_ngrams(texts: DataFrame, order: int, id_col: str = "file_name") -> DataFrame:
    chars, longest = text_sizes(texts)
    n = text_partitions(texts, chars)
    counted = [raw_grams(part, order, id_col, dealt=dealt, partitions=n) for part, dealt in by_length(texts, longest)]
    return split_gram(reduce(DataFrame.unionByName, counted))


def gram_levels(grams: DataFrame, order: int, keys: list[str]) -> DataFrame:
    """Counts at each context length 0..order from the longest grams.

    Every occurrence at length j ends some longest gram or prefix, so the shorter
    counts are sums over suffixes. `head` marks the gram that opens the text at
    its own level. Windows that end in a tail count at their own level only, in
    `joint_n`, which has the text's own count `n` in it.
    """
    size = F.length("gram")
    opens = (size <= order) & (F.col("level") + 1 == size)
    count, levels, counts = F.col("n"), F.sequence(F.lit(0), size - 1), [F.sum("n").alias("n")]
    columns = []
    if "joint" in grams.columns:
        crosses = F.col("joint") > 0
        levels = F.when(crosses, F.array(size - 1)).otherwise(levels)
        opens = F.when(crosses, F.col("joint") == 2).otherwise(opens)
        count = F.when(crosses, 0).otherwise(count)
        columns, counts = [F.col("n").alias("joint_n")], [*counts, F.sum("joint_n").alias("joint_n")]
    return (
        grams.withColumn("level", F.explode(levels))
        .select(
            *keys, "level", F.right(F.col("gram"), F.col("level") + 1).alias("g"), count.alias("n"),
            opens.alias("head"), *columns,
        )
        .groupBy(*keys, "level", "g")
        .agg(*counts, F.max("head").alias("head"))
    )


def n_log_n(n: Column) -> Column:
    return n * F.log2(n)


def _sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def context_totals(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Per context: T occurrences, D distinct symbols, Q = sum of n log2 n, and the
    count of the opening gram where the text starts in this context. With a `cost`
    per gram also R, the bits of all symbols, and O, those of the opening one. With
    `joint_n` and the reference's `ref_n` also what the context is after text and reference: Tx
    further occurrences, Dx symbols new to the reference, the rise Qx, the opening gram's count."""
    own = F.col("n") > 0
    opens = own & F.col("head")
    columns = [
        F.sum("n").alias("T"), F.sum(F.when(own, 1).otherwise(0)).alias("D"),
        F.sum(F.when(own, n_log_n(F.col("n"))).otherwise(0.0)).alias("Q"),
        F.max(F.when(opens, F.col("n"))).alias("opening"),
    ]
    if "cost" in levels.columns:
        columns += [
            F.sum(F.when(own, F.col("n") * F.col("cost"))).alias("R"),
            F.sum(F.when(opens, F.col("cost"))).alias("O"),
        ]
    if "ref_n" in levels.columns:
        before = F.coalesce("ref_n", F.lit(0))
        after = before + F.col("joint_n")
        columns += [
            F.sum("joint_n").alias("Tx"), F.sum(F.when(before > 0, 0).otherwise(1)).alias("Dx"),
            F.sum(n_log_n(after) - F.when(before > 0, n_log_n(before)).otherwise(0.0)).alias("Qx"),
            F.max(F.when(F.col("head"), after)).alias("joint_opening"),
        ]
    return levels.groupBy(
        *keys, "level", F.left(F.col("g"), F.col("level")).alias("ctx")
    ).agg(*columns)


def document_code(
    texts: DataFrame, order: int, id_col: str = "file_name",
    model: ReferenceModel | None = None, alphabet_size: int | None = None,
    joint: ReferenceModel | None = None, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Code lengths of each text in one pass over its grams. `sizes` are its `document_sizes`, where known.

    Columns: chars, entropy (bits per character over single characters),
    bits_1 .. bits_order under the text's own model, with a reference model
    ref_bits_1 .. ref_bits_order under that one, and with `joint` joint_bits_1 ..
    joint_bits_order of the text followed by that reference. In its own model a text never
    meets an unseen symbol, so a context costs T log2(T + D) - Q as a whole. Of the joint text
    only contexts that the text touches differ from the reference's totals, so those are
    patched and the rest of the reference enters as one constant.
    """
    chars, longest = sizes or document_sizes(texts, id_col)
    n = text_partitions(texts, chars)
    return reduce(DataFrame.unionByName, [
        _code(part, order, id_col, model, alphabet_size, joint, dealt, n)
        for part, dealt in by_document(texts, longest, id_col)
    ])


def _array_code(
    texts: DataFrame, order: int, id_col: str, model: ReferenceModel | None, alphabet_size: int | None,
    joint: ReferenceModel | None, partitions: int,
) -> DataFrame:
    """The code of documents that a task takes whole, on arrays."""
    find_package(texts.sparkSession)
    rows = placed(texts, partitions, id_col).sortWithinPartitions(id_col).select(id_col, F.make_valid_utf8("text").alias("text"))
    names = ["bits", *["ref_bits"] * (model is not None), *["joint_bits"] * (joint is not None)]
    names = ["chars", "entropy", *[f"{name}_{k}" for name in names for k in range(1, order + 1)]]
    trees = [None if m is None else m.tree for m in (model, joint)]
    tail, body = (joint.opening[:order], joint.body) if joint is not None else ("", {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = (None if tree is None else tree.value for tree in trees)
        batches = iter(batches)
        for first in batches:
            kind = first.schema.field(0).type
            for ids, found in gram_arrays.documents(chain([first], batches), gram_arrays.BATCH_CHARS):
                for keys, columns in gram_arrays.code_texts(ids, found, order, tail, own, alphabet_size, other, body):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, kind), *map(pa.array, columns)], [id_col, *names])

    fields = [StructField(id_col, texts.schema[id_col].dataType), StructField("chars", LongType())]
    return rows.mapInArrow(run, StructType([*fields, *[StructField(n, DoubleType()) for n in names[1:]]]))


def _code(
    texts: DataFrame, order: int, id_col: str, model: ReferenceModel | None, alphabet_size: int | None,
    joint: ReferenceModel | None, dealt: bool, partitions: int | None = None,
) -> DataFrame:
    small = all(m is None or m.small for m in (model, joint))
    if not dealt and small and order <= gram_arrays.MOST_ORDER:
        return _array_code(texts, order, id_col, model, alphabet_size, joint, partitions or text_partitions(texts))
    grams = raw_grams(texts, order, id_col, joint.opening[:order] if joint else "", dealt, partitions)
    levels = gram_levels(grams, order, [id_col])
    if model is not None:
        levels = priced_levels(levels, model, order, alphabet_size)
    if joint is not None:
        if "joint_n" not in levels.columns:  # nothing follows the text
            levels = levels.withColumn("joint_n", F.col("n"))
        known = joint.lookup(joint.grams.withColumnRenamed("n", "ref_n"))
        levels = levels.join(known, ["level", "g"], "left")
    totals = context_totals(levels, [id_col])
    level, T, D, Q = F.col("level"), F.col("T"), F.col("D"), F.col("Q")

    def bits(k: int) -> Column:
        body = _sum_if((level == k) & (T > 0), T * F.log2(T + D) - Q)
        opening = F.sum(
            F.when((level < k) & F.col("opening").isNotNull(),
                   F.log2(T + D) - F.log2(F.col("opening")))
        )
        return (body + opening).alias(f"bits_{k}")

    def ref_bits(k: int) -> Column:
        return F.sum(
            F.when(level == k, F.col("R")).when(level < k, F.coalesce("O", F.lit(0.0)))
        ).alias(f"ref_bits_{k}")

    def joint_bits(k: int) -> Column:
        T0, D0, Q0 = (F.coalesce(F.col(c), F.lit(0)) for c in ("ref_T", "ref_D", "ref_Q"))
        T1, D1 = T0 + F.col("Tx"), D0 + F.col("Dx")
        before = F.when(T0 > 0, T0 * F.log2(T0 + D0) - Q0).otherwise(0.0)
        body = _sum_if(level == k, T1 * F.log2(T1 + D1) - (Q0 + F.col("Qx")) - before)
        opening = F.sum(F.when((level < k) & F.col("joint_opening").isNotNull(),
                               F.log2(T1 + D1) - F.log2("joint_opening")))
        return (F.lit(joint.body[k]) + body + opening).alias(f"joint_bits_{k}")

    orders = range(1, order + 1)
    if joint is not None:
        known = joint.contexts.select("level", "ctx", *[F.col(c).alias(f"ref_{c}") for c in "TDQ"])
        totals = totals.join(joint.lookup(known), ["level", "ctx"], "left")
    return totals.groupBy(id_col).agg(
        F.max(F.when(level == 0, T)).alias("chars"),
        F.max(F.when(level == 0, F.log2(T) - Q / T)).alias("entropy"),
        *[bits(k) for k in orders],
        *([ref_bits(k) for k in orders] if model is not None else []),
        *([joint_bits(k) for k in orders] if joint is not None else []),
    )


def self_code(texts: DataFrame, order: int, id_col: str = "file_name") -> DataFrame:
    return document_code(texts, order, id_col)


def character_entropy(texts: DataFrame, id_col: str = "file_name") -> DataFrame:
    """(id, entropy) in bits per character. Characters are counted where the text is read;
    only tens of counts for each text are shuffled."""
    spans = texts.select(id_col, F.col("text").alias("_t")).filter(F.length("_t") > 0).select(
        id_col, F.explode(F.expr(
            f"transform(sequence(0, length(_t) - 1, {SPAN}), p -> substring(_t, p + 1, {SPAN}))"
        )).alias("_s")
    )
    counted = spans.select(id_col, F.explode(F.split("_s", "")).alias("_c")).groupBy(id_col, "_c").agg(
        F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    return counted.groupBy(id_col).agg(
        (F.log2(total) - F.sum(n_log_n(F.col("_n"))) / total).alias("entropy"))


def self_columns(orders: list[int]) -> list[Column]:
    """Entropy, compression ratio and entropy ratio from code lengths."""
    columns = [F.col("entropy").alias("Shannon_Entropy")]
    for k in orders:
        rate = F.col(f"bits_{k}") / F.col("chars")
        columns += [
            (rate / 8).alias(f"Compression_Ratio_Order_{k}"),
            F.when(F.col("entropy") > 0, rate / F.col("entropy")).otherwise(F.lit(0.0))
            .alias(f"Entropy_Ratio_Order_{k}"),
        ]
    return columns


def alphabet(texts: DataFrame, lowercase: bool = True) -> DataFrame:
    """The distinct characters of a corpus, one per row."""
    text = F.lower("text") if lowercase else F.col("text")
    find_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(gram_arrays.characters(batches), pa.string())], ["char"])

    valid = texts.select(F.make_valid_utf8(text).alias("_t")).filter(F.length("_t") > 0)
    return valid.mapInArrow(run, "char string").distinct()


# --- reference model ---------------------------------------------------------


def concatenated(texts: DataFrame, order: int, seed: int = 42, id_col: str = "file_name") -> DataFrame:
    """Each text ended by a line break, with the next characters of the
    concatenation beside it, so that windows across a boundary are counted.

    Texts follow each other in hash order. A piece has at least two characters,
    so order/2 pieces are enough to look ahead; the places are found by an
    equi-join on the position.
    """
    placed = hash_rank(texts.select(id_col, "text"), seed, id_col).select(
        id_col, "hash_pos", F.concat("text", F.lit("\n")).alias("text")
    )
    starts = placed.select("hash_pos", F.left(F.col("text"), F.lit(order)).alias("_start"))
    out = placed.withColumn("ahead", F.lit(""))
    for step in range(1, (order + 1) // 2 + 1):
        nxt = starts.select((F.col("hash_pos") - step).alias("hash_pos"), "_start")
        out = out.join(nxt, "hash_pos", "left").select(
            id_col, "hash_pos", "text",
            F.left(F.concat("ahead", F.coalesce("_start", F.lit(""))), F.lit(order)).alias("ahead"),
        )
    return out


@dataclass
class ReferenceModel:
    """Counts of a reference text at each context length.

    grams: (level, g, n); costs: (g, bits), the bits of a symbol after its context;
    contexts: (level, ctx, T, D, Q, X), where X is the count that the symbols of ctx
    have after the next shorter context. All are written out once. `opening` holds the
    first characters, `bits` the self code length per order, `length` and `distinct`
    the characters and distinct characters: a handful of scalars.
    """

    order: int
    grams: DataFrame
    costs: DataFrame
    contexts: DataFrame
    length: int
    distinct: int
    opening: str
    bits: dict[int, float]
    body: dict[int, float]

    @property
    def small(self) -> bool:
        if not hasattr(self, "_small"):
            self._small = at_most(self.grams)
        return self._small

    @property
    def tree(self) -> Broadcast:
        """The counts as arrays for the tasks; asked for only where the model is small."""
        if not hasattr(self, "_tree"):
            counts = self.grams.select("level", "g", "n").toArrow()
            self._tree = self.grams.sparkSession.sparkContext.broadcast(gram_arrays.Tree.of(counts, self.order))
        return self._tree

    def lookup(self, table: DataFrame) -> DataFrame:
        """Broadcast a model table only when its size has been checked."""
        return F.broadcast(table) if self.small else table


def _reference_windows(spans: DataFrame, order: int) -> DataFrame:
    """(gram, n) of the windows of spans (first, _s), with the prefixes of the first one."""
    if order <= gram_arrays.MOST_ORDER:
        find_package(spans.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for grams, n in gram_arrays.window_counts(batches, order):
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

        valid = spans.select("first", F.make_valid_utf8("_s").alias("_s"))
        return valid.mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(order), F.length("_s"))),
        lambda j: F.left(F.col("_s"), j),
    )
    windows = _windows(F.col("_s"), order + 1)
    grams = F.explode(F.when(F.col("first"), F.concat(prefixes, windows)).otherwise(windows))
    return spans.select(grams.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def reference_model(
    texts: DataFrame, order: int, seed: int = 42, id_col: str = "file_name"
) -> ReferenceModel:
    pieces = concatenated(texts, order, seed, id_col)
    body = F.concat("text", "ahead")
    spans = pieces.select(
        (F.col("hash_pos") == 0).alias("first"), body.alias("_t"), F.length("text").alias("_n")
    ).withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(SPAN))))
    spans = spans.withColumn(
        "_s", F.expr(f"substring(_t, _from + 1, least({SPAN}, _n - _from) + {order})")
    )
    longest = _reference_windows(spans.select((F.col("first") & (F.col("_from") == 0)).alias("first"), "_s"), order)
    grams = materialize(gram_levels(longest, order, []))
    totals = context_totals(grams, [])
    # X of a context: counts of its symbols one level down.
    lower = grams.select((F.col("level") + 1).alias("level"), F.col("g").alias("_tail"),
                         F.col("n").alias("_n"))
    below = (
        grams.filter("level > 0")
        .select("level", "g", F.right(F.col("g"), F.col("level")).alias("_tail"))
        .join(lower, ["level", "_tail"])
        .groupBy("level", F.left(F.col("g"), F.col("level")).alias("ctx"))
        .agg(F.sum("_n").alias("X"))
    )
    contexts = materialize(totals.join(below, ["level", "ctx"], "left"))
    level, T, D, Q = F.col("level"), F.col("T"), F.col("D"), F.col("Q")
    costs = materialize(
        grams.select("level", "g", "n", F.left(F.col("g"), level).alias("ctx"))
        .join(contexts.select("level", "ctx", "T", "D"), ["level", "ctx"])
        .select("g", (F.log2(T + D) - F.log2("n")).alias("bits"))
    )
    orders = range(1, order + 1)
    sums = contexts.agg(
        F.max(F.when(level == 0, T)).alias("length"), F.max(F.when(level == 0, D)).alias("distinct"),
        *[F.coalesce(F.sum(F.when(level == k, T * F.log2(T + D) - Q)), F.lit(0.0)).alias(f"b{k}")
          for k in orders],
        *[F.coalesce(F.sum(F.when((level < k) & F.col("opening").isNotNull(),
                                  F.log2(T + D) - F.log2("opening"))), F.lit(0.0)).alias(f"o{k}")
          for k in orders],
    ).first()
    opening = grams.filter("head").agg(F.max_by("g", "level")).first()[0] or ""
    return ReferenceModel(
        order,
        grams.select("level", "g", "n"),
        costs,
        contexts.select("level", "ctx", "T", "D", "Q", "X"),
        sums["length"] or 0,
        sums["distinct"] or 0,
        opening,
        {k: sums[f"b{k}"] + sums[f"o{k}"] for k in orders},
        {k: sums[f"b{k}"] for k in orders},
    )


def price_grams(grams: DataFrame, model: ReferenceModel, order: int, alphabet_size: int) -> DataFrame:
    """Add `cost`, the bits of each gram's symbol under the reference model.

    A gram the reference holds has its cost in the model. Only for the others does the
    chain of shorter contexts matter; their lookups get null keys for all other rows.
    From the longest context down: an unseen context falls at no cost, a seen one
    without the symbol pays for the escape, unless nothing is left after exclusion.
    """
    size = F.length("gram")
    costs = model.costs.select(F.col("g").alias("gram"), F.col("bits").alias("_bits"))
    priced = grams.join(model.lookup(costs), "gram", "left")
    unseen = F.col("_bits").isNull()
    for j in range(order, 0, -1):
        if j < order:
            g = model.grams.filter(F.col("level") == j).select(
                F.col("g").alias(f"_g{j}"), F.col("n").alias(f"_N{j}")
            )
            key = F.when(unseen & (size > j + 1), F.right(F.col("gram"), F.lit(j + 1)))
            priced = priced.withColumn(f"_g{j}", key).join(model.lookup(g), f"_g{j}", "left")
        c = model.contexts.filter(F.col("level") == j).select(
            F.col("ctx").alias(f"_c{j}"), F.col("T").alias(f"_T{j}"), F.col("D").alias(f"_D{j}"),
            F.col("X").alias(f"_X{j}"),
        )
        key = F.when(unseen & (size > j), F.left(F.right(F.col("gram"), F.lit(j + 1)), F.lit(j)))
        priced = priced.withColumn(f"_c{j}", key).join(model.lookup(c), f"_c{j}", "left")
    single = model.grams.filter("level = 0").select(F.col("g").alias("_g0"), F.col("n").alias("_N0"))
    key = F.when(unseen & (size > 1), F.right(F.col("gram"), F.lit(1)))
    priced = priced.withColumn("_g0", key).join(model.lookup(single), "_g0", "left")

    nothing = F.lit(None).cast("bigint")
    cost = F.log2(F.lit(float(max(1, alphabet_size - model.distinct))))
    for j in range(0, order + 1):
        N = F.col(f"_N{j}") if j < order else nothing
        if j:
            T, D, seen = F.col(f"_T{j}"), F.col(f"_D{j}"), F.col(f"_T{j}").isNotNull()
        else:
            T, D, seen = F.lit(model.length), F.lit(model.distinct), F.lit(model.length > 0)
        if j < order:  # what the next longer context has already excluded
            T = T - F.coalesce(F.col(f"_X{j + 1}"), F.lit(0))
            D = D - F.coalesce(F.col(f"_D{j + 1}"), F.lit(0))
        cost = (
            F.when(N.isNotNull(), F.log2(T + D) - F.log2(N))
            .when(seen & (D > 0), F.log2(T + D) - F.log2(D) + cost)
            .otherwise(cost)
        )
    return priced.select(*grams.columns, F.coalesce("_bits", cost).alias("cost"))


def priced_levels(
    levels: DataFrame, model: ReferenceModel, order: int, alphabet_size: int
) -> DataFrame:
    """Gram levels with the cost of each gram under the reference model."""
    named = levels.withColumnRenamed("g", "gram")
    if model.small:
        priced = price_grams(named, model, order, alphabet_size)
    else:
        # Large alphabets: price each distinct gram once, then join back.
        costs = materialize(
            price_grams(named.select("gram").distinct(), model, order, alphabet_size)
        )
        priced = named.join(F.broadcast(costs) if at_most(costs) else costs, "gram")
    return priced.withColumnRenamed("gram", "g")


def reference_code(
    texts: DataFrame, model: ReferenceModel, order: int, alphabet_size: int,
    id_col: str = "file_name",
) -> DataFrame:
    """(id, chars, bits): code length of each text under the reference model."""
    code = document_code(texts, order, id_col, model, alphabet_size)
    return code.select(id_col, "chars", F.col(f"ref_bits_{order}").alias("bits"))


def nrc_column(bits: Column, chars: Column, order: int, alphabet_size: int) -> Column:
    """Bits over L log2 A."""
    most = chars * F.log2(F.lit(float(alphabet_size)))
    return F.when(most > 0, bits / most).alias(f"NRC_Order_{order}")


def nrc(
    texts: DataFrame, model: ReferenceModel | None, order: int, alphabet_size: int,
    id_col: str = "file_name",
) -> DataFrame:
    """NRC under the reference model, or the text's own model without one."""
    code = document_code(texts, order, id_col, model, alphabet_size)
    bits = F.col(f"bits_{order}" if model is None else f"ref_bits_{order}")
    return code.select(id_col, nrc_column(bits, F.col("chars"), order, alphabet_size))


def joint_code(
    texts: DataFrame, model: ReferenceModel, order: int, id_col: str = "file_name"
) -> DataFrame:
    """(id, joint_bits): self code length of text followed by the reference."""
    code = document_code(texts, order, id_col, joint=model)
    return code.select(id_col, F.col(f"joint_bits_{order}").alias("joint_bits"))


def ncd_column(model: ReferenceModel, order: int) -> Column:
    """The distance from the columns of `document_code` with this model as `joint`, in [0, 1]."""
    own, ref = F.col(f"bits_{order}"), F.lit(model.bits[order])
    largest = F.greatest(own, ref)
    distance = (F.col(f"joint_bits_{order}") - F.least(own, ref)) / largest
    return F.when(largest == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance))
    ).alias(f"NCD_Order_{order}")


def ncd(
    texts: DataFrame, model: ReferenceModel, order: int, id_col: str = "file_name"
) -> DataFrame:
    """Normalized compression distance of each text to the reference, in [0, 1]."""
    return document_code(texts, order, id_col, joint=model).select(id_col, ncd_column(model, order))
