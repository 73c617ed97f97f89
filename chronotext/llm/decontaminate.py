"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters; A-Z are lower-cased. A window is
`size` consecutive words of a benchmark item; an item of fewer words is one window. Every
`stride`-th short gram of a document is looked up in a broadcast set of the hashed grams
at the first `stride` places of all windows, so each place where a window could start has exactly
one gram to vouch for it. The windows around a hit are then compared word for word.

Null texts and texts without words have no windows. Documents are known by (id, hash of the
text): repeated rows get one result each. Where the gram set or the windows have more than
`BROADCAST_ROWS` rows they are joined by a shuffle. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.session import at_most, materialize

# Fixed value: the characters between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BETWEEN_EXCEPT_CAPITALS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3
BROADCAST_ROWS = 500_000  # of hashes or of windows of some ten words


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in their own case (lower-casing A-Z joins or parts no words)."""
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN_EXCEPT_CAPITALS + "+")
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")).cast("int")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def gram_key(ws: Column, start: Column, n: int) -> Column:
    """Hash of the n words from `start` (counted from 0)."""
    return F.xxhash64(F.lower(F.array_join(F.slice(ws, start + 1, n), " ")))


def sized(df: DataFrame) -> DataFrame:
    """Broadcast where the row count proves it small."""
    return F.broadcast(df) if at_most(df, BROADCAST_ROWS) else df


def windows_of(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct (item, k words, window text) of a benchmark."""
    parts = items.select(F.col(item).alias("item"), words(F.col(text)).alias("ws"))
    parts = parts.withColumn("n", F.size("ws")).filter("n > 0").withColumn("k", F.least("n", F.lit(size)))
    starts = F.sequence(F.lit(0), F.col("n") - F.col("k"))
    at = parts.withColumn("s", F.explode(starts))
    own = F.slice("ws", F.col("s") + 1, F.col("k"))
    return at.select("item", "k", fold(F.array_join(own, " ")).alias("window")).distinct()


def contamination(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", size: int = 10) -> DataFrame:
    """doc, version (hash of the text), n_words, n_hit, items (sorted ids as strings) and spans (start word, words)
    of each document; spans may overlap."""
    windows = materialize(windows_of(items, item, item_text, size))
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most `size` numbers
    shortest = lengths[0] if lengths else size
    gram = min(GRAM, shortest)
    stride = shortest - gram + 1
    texts = windows.select("k", "window").distinct()
    split = F.split("window", " ")
    grams = materialize(texts.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda o: gram_key(split, o, gram))).alias("key")
    ).distinct())

    ws = F.col("ws")
    source = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("version"), words(F.col(text)).alias("ws"))
    source = source.withColumn("n", F.size("ws"))
    reach = size - 1
    # The first anchor is there even without words, so that every row goes on.
    anchors = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - gram, F.lit(0)), F.lit(stride)),
        lambda p: F.struct(
            p.alias("p"), gram_key(ws, p, gram).alias("key"), F.greatest(p - (stride - 1), F.lit(0)).alias("from"),
            F.slice(ws, F.greatest(p - (stride - 1), F.lit(0)) + 1, F.lit(stride + reach)).alias("around"),
        ),
    )
    placed = source.select("doc", "version", "n", F.explode(anchors).alias("a")).select("doc", "version", "n", "a.*")
    met = placed.join(sized(grams.withColumn("hit", F.lit(True))), "key", "left")
    met = materialize(
        met.filter(F.col("hit") | (F.col("p") == 0))
        .select("doc", "version", "n", "p", "from", F.when(F.col("hit"), F.col("around")).alias("around"))
    )

    # Windows that start at most stride - 1 words before the gram, of each length.
    options = F.array(*[
        F.struct(F.lit(o).alias("o"), F.lit(k).alias("k")) for o in range(stride) for k in lengths
    ]) if lengths else F.array().cast("array<struct<o:int,k:int>>")
    tries = met.filter("around IS NOT NULL").withColumn("t", F.explode(options)).select(
        "doc", "version", (F.col("p") - F.col("t.o")).alias("start"), F.col("t.k").alias("k"), "n", "from", "around"
    ).filter((F.col("start") >= 0) & (F.col("start") + F.col("k") <= F.col("n")))
    own = F.slice("around", F.col("start") - F.col("from") + 1, F.col("k"))
    tries = tries.select("doc", "version", "start", "k", fold(F.array_join(own, " ")).alias("window"))
    hits = tries.join(sized(texts), ["k", "window"])
    by_doc = hits.groupBy("doc", "version").agg(
        F.array_sort(F.collect_set(F.struct("start", "k"))).alias("spans"), F.collect_set("window").alias("windows")
    )
    by_doc = materialize(by_doc)
    names = (
        by_doc.select("doc", "version", F.explode("windows").alias("window"))
        .join(sized(windows.select("window", "item")), "window").select("doc", "version", F.col("item").cast("string").alias("item"))
        .groupBy("doc", "version").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    rows = met.filter("p = 0").groupBy("doc", "version").agg(F.max("n").alias("n_words"), F.count(F.lit(1)).alias("rows"))
    same = ["doc", "version"]
    whole = rows.select(F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("d"), "*")
    found = by_doc.drop("windows").join(
        names.select(*(F.col(c).alias(f"_{c}") for c in same), "items"),
        F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left",
    ).select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), "spans", "items")
    joined = whole.drop("d").join(
        found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left"
    )
    none = F.array().cast("array<string>")
    covered = F.aggregate(  # of sorted spans: words past the furthest end so far
        F.coalesce("spans", F.array().cast("array<struct<start:int,k:int>>")),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["k"]).alias("end"),
            (acc["sum"] + F.greatest(s["start"] + s["k"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return joined.select(
        F.col("doc").alias(doc), "version", F.col("n_words").cast("bigint").alias("n_words"), covered.alias("n_hit"),
        F.coalesce("items", none).alias("items"), "spans",
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    ).drop("copy")


def without_documents(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without hits, all columns."""
    rows, d, t = plain(docs, doc, text)
    bad = found.filter("n_hit > 0").select(F.col(doc).alias("hit_doc"), F.col("version").alias("hit_version"))
    left = rows.join(bad, F.col(d).eqNullSafe(F.col("hit_doc")) & (F.xxhash64(t) == F.col("hit_version")), "left_anti")
    return left.toDF(*docs.columns)


def plain(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, str, str]:
    """The documents with columns c0.., which clash with nothing, and the names of two of them."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(doc)], names[docs.columns.index(text)]


def without_spans(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, all columns, the words of hits cut out with what stands before them."""
    rows, d, t = plain(docs, doc, text)
    bad = found.filter("n_hit > 0").select(
        F.col(doc).alias("hit_doc"), F.col("version").alias("hit_version"), F.col("spans").alias("hit_spans")
    ).dropDuplicates(["hit_doc", "hit_version"])
    joined = rows.join(bad, F.col(d).eqNullSafe(F.col("hit_doc")) & (F.xxhash64(t) == F.col("hit_version")), "left")
    word = "[^" + BETWEEN_EXCEPT_CAPITALS[1:]
    pieces = F.regexp_extract_all(F.col(t), F.lit(f"{BETWEEN_EXCEPT_CAPITALS}*{word}+"), F.lit(0))
    tail = F.regexp_extract(F.col(t), f"{BETWEEN_EXCEPT_CAPITALS}*\\z", 0)
    hit = F.array_distinct(F.flatten(F.transform(
        "hit_spans", lambda s: F.sequence(s["start"], s["start"] + s["k"] - 1))))
    gone = F.map_from_arrays(hit, F.array_repeat(F.lit(True), F.size(hit)))
    left = F.filter(pieces, lambda piece, i: ~F.map_contains_key("hit_gone", i))
    cut = joined.withColumn("hit_gone", gone)
    cut = cut.withColumn(t, F.when(F.col("hit_spans").isNotNull(), F.concat(F.array_join(left, ""), tail)).otherwise(F.col(t)))
    return cut.select(*rows.columns).toDF(*docs.columns)
