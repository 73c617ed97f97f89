"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased letters with single spaces between words. For each language all n-grams
of the training texts are counted; the longest keep their counts, shorter ones count the
distinct characters before them, and each order is discounted and interpolated with the one below.
A model is a sorted array of n-gram hashes with log-probabilities and one of context hashes with
back-off weights. A text gets the language of the lowest cross-entropy per character.

Limits for rejection come from unseen texts: models of all but one fold of the training texts
score that fold, and a language's limit is the mean and `tolerance` standard deviations of its
cross-entropies there; texts above it are marked rejected. A language with fewer than two
texts in the fold has no limit and rejects nothing. Folds go by the hash of the text, so exact
copies are in one fold.

Hashes have 64 bits, so different n-grams stay apart and the models grow with the text they
saw. Models of up to `MODEL_ROWS` rows together are broadcast. Larger ones stay a table: the
distinct n-grams of slices of the texts are priced order by order by joins, and each slice meets the
sorted prices of its own n-grams only. Both ways give the same figures.

Null texts and texts without letters are `und` with score 0. Rows are judged one by one;
repeated rows repeat; other columns are not read. Without training texts everything is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StringType, StructField, StructType

from chronotext.llm.common import MIX_2, U64, held, mix
from chronotext.session import materialize

ORDER = 4
MODEL_ROWS = 4_000_000  # of all languages; 64 MB as arrays
SLICE_CHARS = 1 << 18
SLICE_TEXT = 1 << 24  # characters of the texts that meet their prices together
FOLDS = 5
UNKNOWN = np.log(1e-7)  # of a character never seen in any language
GRAMS = [f"g{k}" for k in range(1, ORDER + 1)] + [f"h{k}" for k in range(2, ORDER + 1)]


class Symbols:
    """Texts to symbols: letters lower-cased, every run of others one space."""

    def __init__(self):
        held()
        self.letter = np.array([chr(i).isalpha() for i in range(0x110000)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, row offsets); a row with letters begins and ends with a space."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letters = self.letter[codes]
        rows = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
        # A space is kept at the end of a word; one more stands before the first word of a row.
        ends = np.zeros(len(codes), dtype=bool)
        ends[1:] = letters[:-1] & ~letters[1:]
        keep = letters | ends
        total = np.concatenate([[0], np.cumsum(keep)])
        lengths = total[rows[1:]] - total[rows[:-1]]
        full = lengths > 0
        offsets = np.concatenate([[0], np.cumsum(lengths + full)])
        out = np.full(offsets[-1], 32, dtype=np.uint64)
        body = np.ones(offsets[-1], dtype=bool)
        body[offsets[:-1][full]] = False
        out[body] = np.where(letters, codes, 32)[keep]
        return out, offsets


def windows(symbols: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The symbol at each place and the 1, 2, ... ORDER - 1 before it; spaces stand before a row."""
    begins, sizes, out = offsets[:-1], np.diff(offsets), []
    for k in range(ORDER):
        before = np.empty_like(symbols)
        before[k:] = symbols[: max(len(symbols) - k, 0)]
        for j in range(k):  # the first places of a row look back beyond it
            before[begins[sizes > j] + j] = 32
        out.append(before)
    return out


def hashes(backwards: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last 1, 2, ... symbols, which are given from the last one on."""
    total, out = np.zeros(len(backwards[0]), dtype=U64), []
    for k, before in enumerate(backwards):
        total = (total + before + U64(1)) * U64(MIX_2)
        total = total ^ (total >> U64(29))
        out.append(mix(total + U64(k)))
    return out


def gram_hashes(symbols: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the 1, 2, ... ORDER symbols that end at each place, and of the 0, 1, ...
    ORDER - 1 symbols before it; spaces stand before a row."""
    begins, sizes = offsets[:-1], np.diff(offsets)
    grams, blanks = hashes(windows(symbols, offsets)), hashes([np.full(1, 32, dtype=U64)] * ORDER)
    contexts = [np.zeros(len(symbols), dtype=U64)]
    for k in range(ORDER - 1):
        moved = np.empty_like(grams[k])
        moved[1:] = grams[k][:-1]
        moved[begins[sizes > 0]] = blanks[k][0]
        contexts.append(moved)
    return grams, contexts


def chunks(texts: list[str], limit: int = SLICE_CHARS):
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, counts n of the longest n-grams and n_seen of those outside the held-out fold, each with
    the hashes g1.. of its ends and h2.. of its contexts (h of order k is the k - 1 symbols before its last).

    Counts travel beside the symbols, two to a number and in order, so that they compress; hashes come after."""
    def count(batches):
        split = Symbols()
        held: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("out").to_pylist()))
            for i, j in chunks(texts):
                for key in set(keys[i:j]):
                    symbols, offsets = split([t for t, k in zip(texts[i:j], keys[i:j]) if k == key])
                    if not len(symbols):
                        continue
                    window = windows(symbols, offsets)
                    # The longest end tells the rows apart.
                    whole, first, n = np.unique(hashes(window)[-1], return_index=True, return_counts=True)
                    s = [w[first] for w in reversed(window)]
                    rows = np.stack([whole, s[0] << U64(21) | s[1], s[2] << U64(21) | s[3]])
                    old = held.get(key)
                    if old is not None:
                        rows, n = np.concatenate([old[0], rows], axis=1), np.concatenate([old[1], n])
                        if len(n) > 1 << 19:
                            rows, n = merge(rows, n)
                    held[key] = rows, n
                    if len(n) > 1 << 21:
                        yield from emit(key, *held.pop(key))
        for key, (rows, n) in held.items():
            yield from emit(key, *merge(rows, n))

    def merge(rows, n):
        _, first, back = np.unique(rows[0], return_index=True, return_inverse=True)
        return rows[:, first], np.bincount(back, weights=n).astype(np.int64)

    def emit(key, rows, n):
        order = np.lexsort((rows[2], rows[1]))
        high, low, n = rows[1][order].astype(np.int64), rows[2][order].astype(np.int64), n[order]
        for i in range(0, len(n), 100_000):
            counts = n[i: i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(counts), pa.string()), pa.array(high[i: i + 100_000]), pa.array(low[i: i + 100_000]),
                 pa.array(counts), pa.array(counts * (not key[1]))],
                names=["lang", "high", "low", "n", "n_seen"])

    def named(batches):
        for batch in batches:
            high, low = (batch.column(c).to_numpy().astype(U64) for c in ("high", "low"))
            mask = U64((1 << 21) - 1)
            backwards = [low & mask, low >> U64(21), high & mask, high >> U64(21)]
            found = [*hashes(backwards), *hashes(backwards[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), *(pa.array(x.astype(np.int64)) for x in found), batch.column("n"), batch.column("n_seen")],
                names=["lang", *GRAMS, "n", "n_seen"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), held_fold(text).alias("out"))
    counted = rows.mapInArrow(count, "lang string, high bigint, low bigint, n bigint, n_seen bigint").groupBy("lang", "high", "low").agg(
        F.sum("n").alias("n"), F.sum("n_seen").alias("n_seen"))
    fields = ", ".join(f"{c} bigint" for c in GRAMS)
    return counted.mapInArrow(named, f"lang string, {fields}, n bigint, n_seen bigint")


def held_fold(text: str):
    """Whether a text is in the fold that gives the limits."""
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0, F.lit(False))


def gram_levels(grams: DataFrame) -> DataFrame:
    """A row for each n-gram of order k (kind k) and each context (-k) of a language, with its hash, its count n (of a context:
    the kinds of n-grams in it), the total of its context, and both without the held-out fold (n_seen, total_seen).

    An order needs a shuffle by n-gram and one by context. A context has at most as many rows as there are characters."""
    out, level = None, materialize(grams)
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # each distinct n-gram is one more character before its end
            ends = [f"g{i}" for i in range(1, k + 1)] + [f"h{i}" for i in range(2, k + 1)]
            level = materialize(level.groupBy("lang", *ends).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_seen") > 0).alias("n_seen")))
        context = F.col(f"h{k}") if k > 1 else F.lit(0).cast("bigint")
        own = Window.partitionBy("lang", context).orderBy(f"g{k}")
        same = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        counts = level.select(
            "lang", F.col(f"g{k}").alias("g"), context.alias("h"), "n", "n_seen",
            F.sum("n").over(same).alias("total"), F.sum("n_seen").over(same).alias("total_seen"),
            F.count(F.lit(1)).over(same).alias("kinds"), F.count_if(F.col("n_seen") > 0).over(same).alias("kinds_seen"),
            F.row_number().over(own).alias("place"))
        gram, start = (
            F.struct(F.lit(kind).alias("kind"), F.col(key).alias("hash"), F.col(n).alias("n"), "total",
                     F.col(f"{n}_seen").alias("n_seen"), "total_seen")
            for kind, key, n in ((k, "g", "n"), (-k, "h", "kinds")))
        rows = counts.select("lang", F.inline(F.when(F.col("place") == 1, F.array(gram, start)).otherwise(F.array(gram))))
        out = rows if out is None else out.unionByName(rows)
    return materialize(out)


def kneser_ney(levels: DataFrame, part: str = "") -> DataFrame:
    """lang, kind (order k for an n-gram, -k for the context of order k), hash and value: what an
    n-gram adds before interpolation, and the weight a context gives to the order below; of all
    texts, or of those outside the held-out fold (`part` is _seen).

    Order 1 is interpolated with the same share for each character of the language."""
    own = levels.select("lang", "kind", "hash", F.col(f"n{part}").alias("n"), F.col(f"total{part}").alias("total")).filter("n > 0")
    few = own.filter("kind > 0").groupBy("lang", "kind").agg(
        F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    cut = few.select("lang", F.col("kind").alias("order"), F.when(
        (F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
    rows = cut.collect()  # a row for each order of a language
    cut = levels.sparkSession.createDataFrame(rows, cut.schema)
    value = F.when(F.col("kind") > 0, (F.col("n") - F.col("d")) / F.col("total")).otherwise(F.col("d") * F.col("n") / F.col("total"))
    return own.withColumn("order", F.abs("kind")).join(F.broadcast(cut), ["lang", "order"]).select("lang", "kind", "hash", value.alias("value"))


class Scorer:
    """Log-probabilities of n-grams under several languages, from sorted hash arrays."""

    def __init__(self, models: list[dict[int, tuple[np.ndarray, np.ndarray]]]):
        self.models = models
        self.keys = np.zeros(0, dtype=U64)
        self.values = np.zeros((0, len(models)), dtype=np.float32)
        self.split = Symbols()

    def price(self, ends: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Rows of log-probabilities; ends[k] and contexts[k] hash order k + 1."""
        out = np.empty((len(ends[0]), len(self.models)), dtype=np.float32)
        for m, model in enumerate(self.models):
            kinds = max(len(model[1][0]), 1)
            p = np.full(len(ends[0]), 1.0 / kinds)
            for k in range(1, ORDER + 1):
                add, found = look(model[k], ends[k - 1])
                share, seen = look(model[-k], contexts[k - 1])
                p = np.where(seen, add * found + share * p, p)
            out[:, m] = np.maximum(np.log(np.maximum(p, 1e-30)), UNKNOWN)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character under each language, number of symbols) of each text."""
        sums, sizes = [], []
        for i, j in chunks(texts):
            symbols, offsets = self.split(texts[i:j])
            sizes.append(np.diff(offsets))
            if not len(symbols):
                sums.append(np.zeros((j - i, len(self.models))))
                continue
            grams, contexts = gram_hashes(symbols, offsets)
            distinct, first, back = np.unique(grams[-1], return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, distinct)
            at[at == len(self.keys)] = 0
            new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), dtype=bool)
            if new.any():
                here = first[new]
                if len(self.keys) > 1 << 21:
                    self.keys, self.values = distinct[~new], self.values[at[~new]]
                keys = np.concatenate([self.keys, distinct[new]])
                values = np.concatenate([self.values, self.price([g[here] for g in grams], [c[here] for c in contexts])])
                order = np.argsort(keys, kind="stable")
                self.keys, self.values = keys[order], values[order]
                at = np.searchsorted(self.keys, distinct)
            priced = self.values[at]
            total = np.zeros((len(symbols) + 1, len(self.models)))
            for m in range(len(self.models)):
                np.cumsum(priced[back, m], dtype=np.float64, out=total[1:, m])
            sums.append(total[offsets[1:]] - total[offsets[:-1]])
        sums, sizes = np.concatenate(sums), np.concatenate(sizes)
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def look(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value or 0, whether found) of each key in a sorted hash array."""
    hashes, values = arrays
    if not len(hashes):
        return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(hashes, keys.astype(np.int64))
    at[at == len(hashes)] = 0
    found = hashes[at] == keys.astype(np.int64)
    return np.where(found, values[at], 0.0), found


class Model:
    """Language names, the table of all models with its number of rows, and limits for rejection."""

    def __init__(self, table: DataFrame):
        sizes = table.groupBy("lang").agg(  # a row a language
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == 1).alias("letters"),
            F.max(F.when(F.col("kind") == -1, F.col("value"))).alias("share")).collect()
        sizes.sort(key=lambda r: r["lang"])
        self.names = [r["lang"] for r in sizes]
        self.rows = sum(r["rows"] for r in sizes)
        self.letters = [r["letters"] for r in sizes]
        self.shares = [r["share"] for r in sizes]
        self.table = table
        self.limits: dict[str, float] = {}

    def arrays(self) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Sorted hash arrays of every language; for models of at most MODEL_ROWS rows."""
        rows, out = self.table.toArrow(), []
        for name in self.names:
            own, model = rows.filter(pc.equal(rows.column("lang"), name)), {}
            kind, key, value = (own.column(c).to_numpy() for c in ("kind", "hash", "value"))
            for k in [*range(1, ORDER + 1), *range(-ORDER, 0)]:
                pick = kind == k
                order = np.argsort(key[pick])
                model[k] = key[pick][order], value[pick][order]
            out.append(model)
        return out

    def by_hash(self, kind: int) -> DataFrame:
        """key and vals: the value under each language, null where it has none."""
        values = [F.max(F.when(F.col("lang") == n, F.col("value"))) for n in self.names]
        return self.table.filter(F.col("kind") == kind).groupBy(F.col("hash").alias("key")).agg(F.array(*values).alias("vals"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", tolerance: float = 6.0) -> Model:
    """Models of every language of the given texts (rows of null language are not learnt)."""
    docs = docs.filter(F.col(lang).isNotNull())
    levels = gram_levels(count_grams(docs, text, lang))
    model = Model(kneser_ney(levels))
    if model.names:
        unseen = docs.filter(held_fold(text)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        scored = entropies(unseen, Model(kneser_ney(levels, "_seen")), "text")
        own = scored.filter("n_symbols > 0").select("lang", F.col("entropies")[F.col("lang")].alias("e"))
        for r in own.groupBy("lang").agg(F.count("e").alias("n"), F.avg("e").alias("m"), F.stddev_pop("e").alias("s")).collect():
            if r["n"] > 1:
                model.limits[r["lang"]] = r["m"] + tolerance * r["s"]
    return model


def entropies(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """The rows without the text, with n_symbols and a map of cross-entropies by language."""
    kept = [f for f in rows.schema if f.name != text]
    schema = StructType([*kept, StructField("n_symbols", LongType()), StructField("entropies", MapType(StringType(), DoubleType()))])
    names = model.names

    def judged(scorer: Scorer, batch):
        found, sizes = scorer.entropies([t or "" for t in batch.column(text).to_pylist()])
        maps = pa.array([list(zip(names, row)) for row in found.tolist()], pa.map_(pa.string(), pa.float64()))
        columns = [batch.column(f.name) for f in kept]
        return type(batch).from_arrays([*columns, pa.array(sizes.astype(np.int64)), maps], names=schema.names)

    if model.rows <= MODEL_ROWS:
        shared = rows.sparkSession.sparkContext.broadcast(model.arrays())

        def judge(batches):
            scorer = Scorer(shared.value)
            for batch in batches:
                yield judged(scorer, batch)

        return rows.mapInArrow(judge, schema)

    def meet(docs: pa.Table, priced: pa.Table) -> pa.Table:
        scorer, keys = Scorer([{}] * len(names)), priced.column("g").to_numpy().astype(U64)
        order = np.argsort(keys)
        scorer.keys = keys[order]
        scorer.values = priced.column("price").combine_chunks().flatten().to_numpy().reshape(-1, len(names))[order]
        return judged(scorer, docs)

    # A slice goes by content, so that a task that runs again deals its rows as before.
    chars = rows.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    hashed = [f.name for f in rows.schema if not isinstance(f.dataType, MapType)]
    place = "__slice" + "_" * max(len(c) for c in rows.columns)  # longer than any name here
    dealt = rows.withColumn(place, F.pmod(F.xxhash64(*hashed), F.lit(chars // SLICE_TEXT + 1)))
    grams = materialize(slice_grams(dealt.select(F.col(place).alias("slice"), F.col(text).alias("text"))))
    priced = grams.select("slice", F.col(f"g{ORDER}").alias("g")).join(prices(grams, model), "g")
    return dealt.groupBy(place).cogroup(priced.groupBy("slice")).applyInArrow(meet, schema)


def slice_grams(rows: DataFrame) -> DataFrame:
    """The distinct longest n-grams of each slice of texts, with the hashes of their ends and contexts."""

    def distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        split, texts = Symbols(), [t or "" for t in table.column("text").to_pylist()]
        found = np.zeros((len(GRAMS), 0), dtype=np.int64)
        waiting = [found]
        for i, j in chunks(texts):
            symbols, offsets = split(texts[i:j])
            if len(symbols):
                grams, contexts = gram_hashes(symbols, offsets)
                _, first = np.unique(grams[-1], return_index=True)
                waiting.append(np.stack([x[first] for x in (*grams, *contexts[1:])]).astype(np.int64))
            if j == len(texts) or sum(w.shape[1] for w in waiting[1:]) > max(1 << 19, waiting[0].shape[1]):
                found = np.concatenate(waiting, axis=1)
                found = found[:, np.unique(found[ORDER - 1], return_index=True)[1]]
                waiting = [found]
        place = pa.array(np.full(found.shape[1], key[0].as_py(), dtype=np.int64))
        return pa.Table.from_arrays([place, *map(pa.array, found)], names=["slice", *GRAMS])

    return rows.groupBy("slice").applyInArrow(distinct, "slice bigint, " + ", ".join(f"{c} bigint" for c in GRAMS))


def prices(grams: DataFrame, model: Model) -> DataFrame:
    """g (hash of a longest n-gram) and its log-probability under each language, lowest order first.

    An n-gram has at most as many longer ones as there are characters before it, so no key of a join is hot."""
    before = [1.0 / max(n, 1) for n in model.letters]
    last = None
    for k in range(1, ORDER + 1):
        links = [f"g{k - 1}", f"h{k}"] if k > 1 else []
        # All else follows from the hash of order k.
        level = grams.groupBy(F.col(f"g{k}").alias("g")).agg(*[F.min(c).alias(c) for c in links or ["g1"]])
        level = level.join(model.by_hash(k).withColumnRenamed("vals", "adds"), F.col("g") == F.col("key"), "left").drop("key")
        if k == 1:
            shares, lower = [F.lit(s) for s in model.shares], [F.lit(p) for p in before]
        else:
            level = level.join(model.by_hash(-k).withColumnRenamed("vals", "shares"), F.col(f"h{k}") == F.col("key"), "left")
            level = level.drop("key").join(last.toDF(f"g{k - 1}", "lower"), f"g{k - 1}")
            shares, lower = ([F.col(c)[i] for i in range(len(before))] for c in ("shares", "lower"))
        p = [F.when(s.isNull(), q).otherwise(F.coalesce(F.col("adds")[i], F.lit(0.0)) + s * q)
             for i, (s, q) in enumerate(zip(shares, lower))]
        last = level.select("g", F.array(*p).alias("p"))
    logs = F.transform("p", lambda x: F.greatest(F.log(F.greatest(x, F.lit(1e-30))), F.lit(float(UNKNOWN))).cast("float"))
    return last.select("g", logs.alias("price"))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, lang_pred, score, cross_entropy and rejected (above the limit of its language)."""
    scored = entropies(docs.select(*keep, F.col(text).alias("__text")), model, "__text")
    pairs = F.transform(F.map_entries("entropies"), lambda e: F.struct(e["value"].alias("h"), e["key"].alias("lang")))
    best = F.array_min(pairs)  # ties go to the first name
    # Odds of the best against the others, at most 50 characters' worth.
    weight = F.least(F.col("n_symbols"), F.lit(50))
    odds = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.exp((best["h"] - p["h"]) * weight))
    limits = F.create_map(*[F.lit(x) for pair in (model.limits or {"": 0.0}).items() for x in pair])
    none = (F.col("n_symbols") == 0) | F.lit(not model.names)
    return scored.select(
        *keep, F.when(none, "und").otherwise(best["lang"]).alias("lang_pred"),
        F.when(none, 0.0).otherwise(1.0 / odds).alias("score"),
        F.when(~none, best["h"]).alias("cross_entropy"),
        (~none & F.coalesce(best["h"] > limits[best["lang"]], F.lit(False))).alias("rejected"),
    )
