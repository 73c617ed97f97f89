"""Sources, preparation and text features over the given documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import text as X
from chronotext.functions.vocabulary import (
    DEPRECATED_FEATURES, DISTANCE_FEATURES, LEXICAL_FEATURES, MODERN_PERIODS, HISTORICAL_PERIODS,
    NEOLOGISMS, NEOLOGISM_FEATURES, NEOLOGISM_PERIODS, OPTIMAL_FEATURES, READABILITY_FEATURES,
    SUBSET_FEATURES, TARGET_WORDS,
)
from chronotext.operators import lexical, ngrams, prepare
from chronotext.plans import views as V
from chronotext.plans.registry import cte, query, rounded, stored
from chronotext.session import staging_path
from chronotext.sources import corpus as S
from chronotext.sources import sinks
from chronotext.streaming.incremental import incremental_extract


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def name(column: str) -> str:
    return f'"{column}"'


# --- shared SQL ------------------------------------------------------------------

cte("tok", r"""
SELECT file_name, doc_id, lang, split, year, decade, century, text,
  list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words
FROM corpus""", ("corpus",))

cte("tokpos", """
SELECT file_name, lang, unnest(words) AS w, unnest(range(len(words))) AS p FROM tok""", ("tok",))

cte("gaps", """
SELECT file_name, w, count(*) AS n, avg(d) AS mean_gap, median(d) AS median_gap FROM (
  SELECT file_name, w, p - lag(p) OVER (PARTITION BY file_name, w ORDER BY p) AS d FROM tokpos)
GROUP BY file_name, w""", ("tokpos",))


STOP = quoted(X.stop_words("english"))
SYLLABLES = r"""list_sum(list_transform(words, lambda w: greatest(1,
    len(regexp_extract_all(w, '[aeiouy]+'))
    - CASE WHEN regexp_matches(w, '[aeiouy][^aeiouy\s]+e[^\p{L}\s]*$') THEN 1 ELSE 0 END)))"""

cte("lexical", rf"""
SELECT file_name, split, year, decade, century,
  CASE WHEN len(words) = 0 THEN 0 ELSE list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / len(words) END AS "Avg_Word_Length",
  CASE WHEN len(words) = 0 THEN 0 ELSE len(list_distinct(words))::DOUBLE / len(words) END AS "Lexical_Richness",
  list_sum(list_transform(string_split(text, '. '),
    lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))))::DOUBLE
    / len(string_split(text, '. ')) AS "Avg_Sentence_Length",
  len(regexp_extract_all(text, '[[:punct:]]'))::DOUBLE / length(text) AS "Punctuation_Density",
  CASE WHEN len(words) = 0 THEN 0 ELSE {SYLLABLES}::DOUBLE / len(words) END AS "Syllable_Per_Word",
  len(regexp_extract_all(text, '[\p{{Nd}}²³¹]'))::DOUBLE / length(text) AS "Digit_Ratio",
  CASE WHEN len(words) > 0 THEN 206.835::DOUBLE
    - 1.015::DOUBLE * (len(words)::DOUBLE / greatest(1, len(regexp_extract_all(text, '[.!?]+(\s|$)'))))
    - 84.6::DOUBLE * ({SYLLABLES}::DOUBLE / len(words)) END AS "Flesch_Readability",
  CASE WHEN len(words) = 0 THEN 0 ELSE
    len(list_filter(words, lambda w: w IN ({STOP})))::DOUBLE / len(words) END AS "Stopword_Ratio"
FROM tok""", ("tok",))

# Words holding a letter outside a-z, a digit or an underscore are blanked first; what
# is left are whole ASCII words, joined by single hyphens or apostrophes.
cte("compounds", r"""
SELECT file_name, text, regexp_extract_all(
  regexp_replace(text, '[a-zA-Z]*[0-9_À-ÖØ-öø-ɏ][\p{L}\p{N}_]*', ' ', 'g'),
  '[a-zA-Z]+(?:[-''][a-zA-Z]+)*') AS found
FROM corpus""", ("corpus",))


def flag_sql(terms: list[str]) -> str:
    single = [t for t in terms if " " not in t]
    phrases = [t.replace(" ", r"\s+") for t in terms if " " in t]
    parts = ["false"]
    if single:
        parts.append(f"list_has_any(found, [{quoted(single)}])")
    if phrases:
        parts.append(
            rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(phrases)})($|[^\p{{L}}\p{{N}}_])')"
        )
    return "(" + " OR ".join(parts) + ")"


FLAGS = ",\n".join(f'{flag_sql(t)} AS "contains_{p}_words"' for p, t in V.terms().items())


def any_flag(periods) -> str:
    return "(" + " OR ".join(f"contains_{p}_words" for p in periods) + ")"


cte("flags", f"""
SELECT *, {any_flag(MODERN_PERIODS)} AS contains_modern_vocabulary,
  {any_flag(HISTORICAL_PERIODS)} AS contains_historical_vocabulary,
  ({' + '.join(f'contains_{p}_words::INTEGER' for p in MODERN_PERIODS)})::DOUBLE / 3 AS vocabulary_modernity_score
FROM (SELECT file_name, {FLAGS} FROM compounds)""", ("compounds",))

cte("gap_columns", "SELECT file_name, " + ", ".join(
    f"max(mean_gap) FILTER (w = '{w}') AS \"{w}\"" for w in DISTANCE_FEATURES
) + " FROM gaps GROUP BY file_name", ("gaps",))

WORDS = ", ".join(f'g."{w}"' for w in DISTANCE_FEATURES)
cte("raw_features", f"""
SELECT l.*, {WORDS}, f.* EXCLUDE (file_name)
FROM lexical l LEFT JOIN gap_columns g USING (file_name) JOIN flags f USING (file_name)""",
    ("lexical", "gap_columns", "flags"))


def filled(column: str, where: str) -> str:
    c = name(column)
    return f"coalesce(nullif({c}, 0), (SELECT max(nullif({c}, 0)) FROM raw_features WHERE {where}), -1.0)::DOUBLE"


def imputed(column: str, everywhere: bool = True) -> str:
    inside = filled(column, "split <> 'gutenberg'") if everywhere else name(column)
    outside = filled(column, "split = 'gutenberg'")
    return f"CASE split WHEN 'gutenberg' THEN {outside} ELSE {inside} END AS {name(column)}"


cte("model_table", f"""
SELECT file_name, split, year, decade, century,
  dense_rank() OVER (ORDER BY decade) - 1 AS y_decades,
  dense_rank() OVER (ORDER BY century) - 1 AS y_centuries,
  {', '.join(imputed(c, False) for c in LEXICAL_FEATURES)}, {imputed('Flesch_Readability')}, {imputed('Stopword_Ratio', False)},
  {', '.join(imputed(w) for w in DISTANCE_FEATURES)},
  {', '.join(f'{name(c)}::DOUBLE AS {name(c)}' for c in NEOLOGISM_FEATURES[:-1])}, {imputed(NEOLOGISM_FEATURES[-1], False)}
FROM raw_features""", ("raw_features",))


@query("model_table", "SELECT file_name, split, year::BIGINT AS year, decade::BIGINT AS decade, century::BIGINT AS century, "
       "y_decades, y_centuries, " + ", ".join(
           f"round({name(c)}, 6) + 0.0 AS {name(c)}" for c in V.MODEL_FEATURES) + " FROM model_table", ("model_table",))
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all models are fitted on: cleaned features and the classes of both time scales."""
    return rounded(V.model_table(spark, sf_dir).select(
        "file_name", "split", "year", "decade", "century", "y_decades", "y_centuries", *V.MODEL_FEATURES))


def r6(column: str) -> str:
    return f"round({name(column)}, 6) + 0.0 AS {name(column)}"


# --- A: sources and sinks ------------------------------------------------------------


@query("src_corpus", """
SELECT 'doc_' || doc_id || '.txt' AS file_name, length(text)::BIGINT AS chars, md5(text) AS digest
FROM documents WHERE length(text) > 0""")
def src_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "corpus")
    named = V.corpus(spark, sf_dir, lowercase=False).withColumn(
        "file_name", F.concat("file_name", F.lit(".txt"))
    )
    sinks.write_text_files(named, path)
    read = S.read_text_files(spark, path)
    return read.select("file_name", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("src_metadata", """
SELECT file_name, year::BIGINT AS year, decade::BIGINT AS decade, century::BIGINT AS century FROM corpus""",
       ("corpus",))
def src_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "metadata")
    sinks.write_csv(
        V.corpus(spark, sf_dir).select("lang", "file_name", "century", "decade", "year"), path
    )
    return rounded(S.read_metadata(spark, path))


TARGET_VALUES = ", ".join(f"('{lang}', '{w}')" for lang, ws in TARGET_WORDS.items() for w in ws)
LANG_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.LANGUAGES.items()) + " END"


@query("src_dictionary", f"""
SELECT d.lang, d.word, count(t.w) AS occurrences
FROM (VALUES {TARGET_VALUES}) d(lang, word)
LEFT JOIN (SELECT {LANG_CASE} AS lang, w FROM tokpos) t ON t.lang = d.lang AND t.w = d.word
GROUP BY d.lang, d.word""", ("tokpos",))
def src_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word lists from JSON, with their occurrences in the corpus."""
    path = staging_path(spark, "dictionary")
    body = {**TARGET_WORDS, "neologisms": NEOLOGISMS,
            "neologism_periods": {k: list(v) for k, v in NEOLOGISM_PERIODS.items()}}
    spark.createDataFrame([(json.dumps(body, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    listed, _, _ = S.read_dictionary(spark, path)
    codes = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in V.LANGUAGES.items()])
    tokens = V.corpus(spark, sf_dir).select(
        codes.alias("lang"), F.explode(X.words(F.col("text"))).alias("word")
    ).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(tokens, ["lang", "word"], "left").select(
        "lang", "word", F.coalesce("n", F.lit(0)).cast("bigint").alias("occurrences")
    )


NUMBERS = [*LEXICAL_FEATURES, *READABILITY_FEATURES, *V.DISTANCE_FEATURES, NEOLOGISM_FEATURES[-1]]
FLAGS = NEOLOGISM_FEATURES[:-1]
SHOWN = [*NUMBERS, *FLAGS]


@query("src_features_nulls", f"""
SELECT file_name, {', '.join(r6(c) for c in NUMBERS)},
  {', '.join(f'{name(c)}::INTEGER::DOUBLE AS {name(c)}' for c in FLAGS)} FROM raw_features""", ("raw_features",))
def src_features_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature CSV in which missing cells are written as None or left empty."""
    path = staging_path(spark, "features")
    raw = V.raw_features(spark, sf_dir).select("file_name", *SHOWN)
    cells = raw.select(
        "file_name", *[F.col(f"`{c}`").cast("string").alias(c) for c in SHOWN if c != "the"],
        F.coalesce(F.col("the").cast("string"), F.lit("None")).alias("the"),
    )
    sinks.write_csv(cells, path)
    return rounded(S.read_features(spark, path).select("file_name", *SHOWN))


@query("sink_features", f"""
SELECT file_name, split, {', '.join(r6(c) for c in NUMBERS)}, {', '.join(map(name, FLAGS))} FROM raw_features""", ("raw_features",))
def sink_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "sink")
    table = V.raw_features(spark, sf_dir).select("file_name", "split", *SHOWN)
    sinks.write_features(table, path)
    sinks.write_features(table.filter("split = 'test'"), path)  # a re-run replaces its split
    return rounded(spark.read.parquet(path).select("file_name", "split", *SHOWN))


@query("incremental_extract", f"""
SELECT file_name, {', '.join(r6(c) for c in LEXICAL_FEATURES)} FROM lexical""", ("lexical",))
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a growing folder; the second sees only the new files."""
    source, target, marks = (staging_path(spark, n) for n in ("stream-in", "stream-out", "stream-marks"))
    docs = V.corpus(spark, sf_dir).select("file_name", "text", "split")
    for part in ("split = 'train'", "split <> 'train'"):
        docs.filter(part).select("file_name", "text").write.mode("append").parquet(source)
        incremental_extract(
            spark, source, "file_name STRING, text STRING", lexical.lexical_features, target, marks
        )
    return rounded(spark.read.parquet(target).select("file_name", *LEXICAL_FEATURES))


@query("quarantine", """
SELECT file_name, CASE WHEN doc_id % 97 = 0 THEN 'unreadable' WHEN doc_id % 89 = 0 THEN 'empty' ELSE 'usable' END AS state
FROM corpus""", ("corpus",))
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.when(F.col("doc_id") % 97 == 0, None).when(F.col("doc_id") % 89 == 0, "").otherwise(F.col("text"))
    good, bad = S.quarantine(V.corpus(spark, sf_dir).select("file_name", damaged.alias("text")))
    return good.select("file_name", F.lit("usable").alias("state")).unionByName(
        bad.select("file_name", F.col("reason").alias("state"))
    )


@query("latest_run", """
SELECT file_name, lang, year::BIGINT AS run_id FROM corpus c
WHERE year = (SELECT max(year) FROM corpus d WHERE d.lang = c.lang)""", ("corpus",))
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction runs keyed by year; the newest of each language is kept."""
    runs = V.corpus(spark, sf_dir).select("file_name", "lang", F.col("year").cast("bigint").alias("run_id"))
    return S.latest_run(runs, ["lang"]).select("file_name", "lang", "run_id")


# --- B: preparation -------------------------------------------------------------------


@query("lowercase", "SELECT file_name, md5(text) AS digest FROM corpus", ("corpus",))
def lowercase(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("file_name", F.md5("text").alias("digest"))


@query("alphabet_size", """
SELECT count(DISTINCT ch) AS alphabet_size FROM (
  SELECT unnest(string_split(text, '')) AS ch FROM corpus WHERE split <> 'gutenberg')""", ("corpus",))
def alphabet_size(spark, sf_dir):
    texts = V.corpus(spark, sf_dir).filter("split <> 'gutenberg'")
    return ngrams.alphabet(texts).agg(F.count(F.lit(1)).alias("alphabet_size"))


@query("reference_sample_stratified", "SELECT file_name, decade::BIGINT AS decade FROM ref_ids", ("ref_ids",))
def reference_sample_stratified(spark, sf_dir):
    return rounded(V.reference_ids(spark, sf_dir))


@query("reference_sample_uniform", f"""
SELECT file_name FROM (
  SELECT file_name, row_number() OVER (ORDER BY md5('42:' || file_name), file_name) AS r, count(*) OVER () AS n
  FROM corpus WHERE split = 'validation') WHERE r <= greatest(1, floor(n * 0.5))""", ("corpus",))
def reference_sample_uniform(spark, sf_dir):
    return prepare.reference_sample_uniform(V.corpus(spark, sf_dir).filter("split = 'validation'"), 0.5)


@query("exclude_reference", """
SELECT file_name, split FROM corpus WHERE file_name NOT IN (SELECT file_name FROM ref_ids)""",
       ("corpus", "ref_ids"))
def exclude_reference(spark, sf_dir):
    return V.processed(spark, sf_dir).select("file_name", "split")


META = "file_name, year::BIGINT AS year, decade::BIGINT AS decade, century::BIGINT AS century"


@query("join_metadata", f"""SELECT {META}, {', '.join(r6(c) for c in READABILITY_FEATURES)} FROM lexical""",
       ("lexical",))
def join_metadata(spark, sf_dir):
    features = V.raw_features(spark, sf_dir).select("file_name", *READABILITY_FEATURES)
    return rounded(prepare.join_metadata(features, V.metadata(spark, sf_dir)))


def damaged_periods(spark, sf_dir) -> DataFrame:
    """Feature side with missing years, missing and fractional decades, and metadata
    that lacks some documents."""
    d = F.col("doc_id")
    return V.corpus(spark, sf_dir).select(
        "file_name", F.when(d % 13 != 0, F.col("year")).cast("double").alias("year"),
        F.when(d % 17 == 0, None).when(d % 19 == 0, F.col("decade") + 0.5).otherwise(F.col("decade"))
        .cast("double").alias("decade"),
        F.when(d % 11 != 0, F.col("century")).cast("double").alias("century"),
    )


def partial_metadata(spark, sf_dir) -> DataFrame:
    return V.corpus(spark, sf_dir).filter("doc_id % 23 <> 0").select("file_name", "year", "decade", "century")


REPAIRED = """
SELECT file_name,
  CASE WHEN doc_id % 13 = 0 AND doc_id % 23 = 0 THEN NULL ELSE year END::DOUBLE AS year,
  CASE WHEN (doc_id % 17 = 0 OR doc_id % 19 = 0) AND doc_id % 23 = 0 THEN NULL ELSE decade END::DOUBLE AS decade,
  CASE WHEN doc_id % 11 = 0 AND doc_id % 23 = 0 THEN NULL ELSE century END::DOUBLE AS century
FROM corpus"""


@query("repair_temporal", REPAIRED, ("corpus",))
def repair_temporal(spark, sf_dir):
    return prepare.repair_temporal(damaged_periods(spark, sf_dir), partial_metadata(spark, sf_dir))


@query("repair_unresolved", f"""
SELECT file_name, unnest(list_filter([CASE WHEN year IS NULL THEN 'year' END, CASE WHEN decade IS NULL THEN 'decade' END,
  CASE WHEN century IS NULL THEN 'century' END], lambda c: c IS NOT NULL)) AS "column" FROM ({REPAIRED})""", ("corpus",))
def repair_unresolved(spark, sf_dir):
    return prepare.unresolved(repair_temporal(spark, sf_dir))


@query("repair_decade", f"SELECT file_name, decade FROM ({REPAIRED})", ("corpus",))
def repair_decade(spark, sf_dir):
    side = damaged_periods(spark, sf_dir).select("file_name", "decade")
    return prepare.repair_decade(side, partial_metadata(spark, sf_dir))


@query("impute_word_max", f"""
SELECT file_name, split, {', '.join(r6(w) for w in DISTANCE_FEATURES)} FROM (
  SELECT file_name, split, {', '.join(imputed(w) for w in DISTANCE_FEATURES)} FROM raw_features
  WHERE split <> 'gutenberg')""", ("raw_features",))
def impute_word_max(spark, sf_dir):
    raw = V.raw_features(spark, sf_dir).select("file_name", "split", *DISTANCE_FEATURES)
    splits = {s: raw.filter(F.col("split") == s) for s in V.SPLITS[:3]}
    return rounded(prepare.union_splits(prepare.impute_word_max(splits, DISTANCE_FEATURES)))


IMPUTED_ALL = LEXICAL_FEATURES + READABILITY_FEATURES + DISTANCE_FEATURES


def imputed_own(column: str) -> str:
    c = name(column)
    return f"round(coalesce(nullif({c}, 0), max(nullif({c}, 0)) OVER (), -1.0)::DOUBLE, 6) + 0.0 AS {c}"


@query("impute_all_max", f"""
SELECT file_name, {', '.join(imputed_own(c) for c in IMPUTED_ALL)} FROM raw_features WHERE split = 'gutenberg'""",
       ("raw_features",))
def impute_all_max(spark, sf_dir):
    side = V.raw_features(spark, sf_dir).filter("split = 'gutenberg'").select("file_name", *IMPUTED_ALL)
    return rounded(prepare.impute_all_max(side))


@query("exclude_classes", """
SELECT file_name, decade::BIGINT AS decade FROM corpus WHERE decade NOT IN (1600, 1980) AND century <> 18""", ("corpus",))
def exclude_classes(spark, sf_dir):
    kept = prepare.exclude_classes(V.corpus(spark, sf_dir), "decade", [1600, 1980])
    return rounded(prepare.exclude_classes(kept, "century", [18]).select("file_name", "decade"))


def _register_subset(subset: str) -> None:
    """One query per named subset: the mean of each column it keeps, over all rows of
    the cleaned features."""
    available = [c for c in V.MODEL_FEATURES if c in SUBSET_FEATURES[subset]]
    if subset == "compression":
        return  # registered with the n-gram queries
    sql = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({name(c)}), 6) + 0.0 AS mean FROM model_table" for c in available
    )

    @query(f"feature_subset_{subset}", sql, ("model_table",))
    def run(spark, sf_dir, subset=subset):
        table = V.model_table(spark, sf_dir).drop("split", "y_decades", "y_centuries")
        kept = prepare.feature_subset(table, subset)
        means = kept.agg(*[F.avg(f"`{c}`").alias(c) for c in kept.columns])
        return rounded(means.unpivot([], kept.columns, "feature", "mean"))


for _subset in SUBSET_FEATURES:
    _register_subset(_subset)


@query("common_features", f"""
SELECT file_name, split, {', '.join(r6(c) for c in NUMBERS)}, {', '.join(map(name, FLAGS))} FROM raw_features
WHERE split IN ('train', 'validation')""", ("raw_features",))
def common_features(spark, sf_dir):
    """Each side lacks a column of its own and orders the others its own way."""
    raw = V.raw_features(spark, sf_dir)
    train = raw.filter("split = 'train'").select("file_name", "split", *SHOWN, F.lit(1).alias("only_train"))
    valid = raw.filter("split = 'validation'").select(F.lit(1).alias("only_validation"), "split", *reversed(SHOWN), "file_name")
    names = prepare.common_features(train, valid)
    return rounded(prepare.union_splits(
        {"train": prepare.align(train, names), "validation": prepare.align(valid, names)}
    ))


@query("drop_deprecated", f"""
SELECT file_name, {', '.join(r6(c) for c in NUMBERS)}, {', '.join(map(name, FLAGS))} FROM raw_features""", ("raw_features",))
def drop_deprecated(spark, sf_dir):
    table = V.raw_features(spark, sf_dir).select("file_name", *SHOWN)
    return rounded(prepare.drop_deprecated(table.withColumns({c: F.lit(0.0) for c in DEPRECATED_FEATURES})))


@query("label_encode", """
SELECT file_name, decade::BIGINT AS decade, dense_rank() OVER (ORDER BY decade) - 1 AS y FROM corpus""", ("corpus",))
def label_encode(spark, sf_dir):
    docs = V.corpus(spark, sf_dir).select("file_name", "decade", "split")
    classes = prepare.class_index(docs.filter("split = 'train'"), "decade")
    return rounded(prepare.label_encode(docs, classes, "decade").drop("split"))


@query("label_decode", """
SELECT file_name, dense_rank() OVER (ORDER BY century) - 1 AS y, century::BIGINT AS century FROM corpus""", ("corpus",))
def label_decode(spark, sf_dir):
    docs = V.corpus(spark, sf_dir).select("file_name", "century", "split")
    classes = prepare.class_index(docs.filter("split = 'train'"), "century")
    coded = prepare.label_encode(docs, classes, "century").select("file_name", "y")
    return rounded(prepare.label_decode(coded, classes, "y", "century"))


@query("union_splits", f"""
SELECT file_name, split AS dataset, {r6('Lexical_Richness')},
  CASE WHEN split <> 'gutenberg' THEN round("Stopword_Ratio", 6) + 0.0 END AS "Stopword_Ratio" FROM lexical""", ("lexical",))
def union_splits(spark, sf_dir):
    raw = V.raw_features(spark, sf_dir)
    sets = {}
    for s in V.SPLITS:
        columns = ["Lexical_Richness"] + ([] if s == "gutenberg" else ["Stopword_Ratio"])
        sets[s] = raw.filter(F.col("split") == s).select("file_name", *columns)
    return rounded(prepare.union_splits(sets, "dataset"))


@query("validate_table", """
SELECT * FROM (
  SELECT split AS dataset, 'target is all null' AS violation FROM corpus WHERE split = 'test' GROUP BY split
  UNION ALL SELECT 'gutenberg', 'target column not found'
  UNION ALL SELECT 'gutenberg', 'no numeric columns'
  UNION ALL SELECT 'none', 'empty' WHERE NOT EXISTS (SELECT 1 FROM corpus WHERE split = 'none')
  UNION ALL SELECT 'none', 'target is all null' WHERE NOT EXISTS (SELECT 1 FROM corpus WHERE split = 'none'))""", ("corpus",))
def validate_table(spark, sf_dir):
    """A sound set beside three damaged ones."""
    docs = V.corpus(spark, sf_dir).select("file_name", "split", "year", "decade")
    return prepare.validate_table({
        "train": docs.filter("split = 'train'"),
        "test": docs.filter("split = 'test'").withColumn("decade", F.lit(None).cast("int")),
        "gutenberg": docs.filter("split = 'gutenberg'").select("file_name"),
        "none": docs.filter("split = 'none'"),
    }, "decade")


# --- C: text features -----------------------------------------------------------------


@query("tokenize", "SELECT file_name, len(words)::BIGINT AS n, md5(array_to_string(words, ' ')) AS digest FROM tok", ("tok",))
def tokenize(spark, sf_dir):
    tokens = lexical.tokenize(V.corpus(spark, sf_dir))
    return tokens.select("file_name", F.size("words").cast("bigint").alias("n"),
                         F.md5(F.array_join("words", " ")).alias("digest"))


def _register_feature(key: str, column: str, expression) -> None:
    @query(key, f"SELECT file_name, {r6(column)} FROM lexical", ("lexical",))
    def run(spark, sf_dir):
        return rounded(V.corpus(spark, sf_dir).select("file_name", expression(F.col("text")).alias(column)))


def _n(text):
    return F.size(X.words(text))


_register_feature("avg_word_length", "Avg_Word_Length", lambda t: X.avg_word_length(X.words(t)))
_register_feature("lexical_richness", "Lexical_Richness", lambda t: X.lexical_richness(X.words(t)))
_register_feature("avg_sentence_length", "Avg_Sentence_Length", lambda t: X.avg_sentence_length(t, _n(t)))
_register_feature("punctuation_density", "Punctuation_Density", X.punctuation_density)
_register_feature("digit_ratio", "Digit_Ratio", X.digit_ratio)
_register_feature("stopword_ratio", "Stopword_Ratio", lambda t: X.stopword_ratio(X.words(t)))
_register_feature("syllable_per_word", "Syllable_Per_Word", lambda t: X.syllable_per_word(X.syllables(t), _n(t)))
_register_feature("flesch_readability", "Flesch_Readability",
                  lambda t: X.flesch_readability(t, X.syllables(t), _n(t)))


def _gap_query(kind: str):
    def run(spark, sf_dir):
        hits = X.target_hits(X.words(F.col("text")), DISTANCE_FEATURES)
        placed = V.corpus(spark, sf_dir).select("file_name", hits.alias("_hits"))
        return rounded(placed.select("file_name", *X.word_gap_columns(F.col("_hits"), "english", kind)))

    return run


for _kind in ("mean", "median"):
    query(f"word_gap_{_kind}", "SELECT c.file_name, " + ", ".join(
        f"round(max({_kind}_gap) FILTER (w = '{w}'), 6) + 0.0 AS \"{w}\"" for w in DISTANCE_FEATURES
    ) + " FROM corpus c LEFT JOIN gaps g USING (file_name) GROUP BY c.file_name", ("corpus", "gaps"))(_gap_query(_kind))


@query("target_words_by_lang", f"""
SELECT c.file_name, c.lang, g.w AS word, g.n AS occurrences, round(mean_gap, 6) + 0.0 AS mean_gap,
  round(median_gap, 6) + 0.0 AS median_gap
FROM gaps g JOIN (SELECT file_name, lang, {LANG_CASE} AS language FROM corpus) c USING (file_name)
JOIN (VALUES {TARGET_VALUES}) d(lang, word) ON d.lang = c.language AND d.word = g.w""", ("corpus", "gaps"))
def target_words_by_lang(spark, sf_dir):
    return rounded(lexical.word_gaps_long(V.corpus(spark, sf_dir), V.LANGUAGES))


@query("neologism_flags", f"SELECT file_name, {', '.join(NEOLOGISM_FEATURES[:8])} FROM flags", ("flags",))
def neologism_flags(spark, sf_dir):
    text = F.col("text")
    docs = V.corpus(spark, sf_dir).select(
        "file_name", "text", X.folded(text).alias("_low"), X.listed_words(text, V.terms()).alias("_found")
    )
    return docs.select("file_name", *X.neologism_columns(text, F.col("_low"), F.col("_found"), V.terms()))


@query("neologism_aggregates", f"""
SELECT file_name, contains_modern_vocabulary, contains_historical_vocabulary, {r6('vocabulary_modernity_score')} FROM flags""",
       ("flags",))
def neologism_aggregates(spark, sf_dir):
    return rounded(neologism_flags(spark, sf_dir).select("file_name", *X.neologism_aggregates()))
