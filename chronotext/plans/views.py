"""The pipeline's tables as views over the given documents.

source srcK gives the period (20 decades in four centuries); the sets follow from
the document number, so every set holds every class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.operators import lexical, ngrams, prepare
from chronotext.operators.prepare import class_index, label_encode
from chronotext.functions.vocabulary import (
    DISTANCE_FEATURES, LEXICAL_FEATURES, METADATA_COLUMNS, NEOLOGISM_FEATURES, READABILITY_FEATURES,
)
from chronotext.plans.registry import cte, source_state, stored
from chronotext.session import at_most, text_sizes, text_tasks

LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
SPLITS = ["train", "validation", "test", "gutenberg"]
SHARE = 0.05
SEED = 42


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread out where the files split into fewer pieces than there
    are cores (a single small file); a large table is read as it lies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def corpus(spark: SparkSession, sf_dir: str, lowercase: bool = True) -> DataFrame:
    """(file_name, text, lang, doc_id, year, decade, century, split)."""
    step = (F.floor(F.col("doc_id") / 20) % 10).cast("int")
    decade = (1600 + 20 * F.substring("source", 4, 10).cast("int")).cast("int")
    split = (
        F.when(step <= 5, "train").when(step <= 7, "validation").when(step == 8, "test")
        .otherwise("gutenberg")
    )
    docs = documents(spark, sf_dir).filter(F.length("text") > 0).select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("file_name"), "text", "lang", "doc_id",
        (decade + step).alias("year"), decade.alias("decade"),
        (F.floor(decade / 100) + 1).cast("int").alias("century"), split.alias("split"),
    )
    return lexical.lowercase(docs) if lowercase else docs


cte("corpus", """
SELECT 'doc_' || doc_id AS file_name, lower(text) AS text, lang, doc_id,
  1600 + 20 * CAST(substr(source, 4) AS INTEGER) + CAST((doc_id // 20) % 10 AS INTEGER) AS year,
  1600 + 20 * CAST(substr(source, 4) AS INTEGER) AS decade,
  (1600 + 20 * CAST(substr(source, 4) AS INTEGER)) // 100 + 1 AS century,
  CASE WHEN (doc_id // 20) % 10 <= 5 THEN 'train' WHEN (doc_id // 20) % 10 <= 7 THEN 'validation'
       WHEN (doc_id // 20) % 10 = 8 THEN 'test' ELSE 'gutenberg' END AS split
FROM documents WHERE length(text) > 0""")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("file_name", "year", "decade", "century")


def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = corpus(spark, sf_dir).filter("split = 'train'")
    return prepare.reference_sample_stratified(train, SHARE, SEED)


cte("ref_ids", f"""
SELECT file_name, decade FROM (
  SELECT file_name, decade,
    row_number() OVER (PARTITION BY decade ORDER BY md5('{SEED}:' || file_name), file_name) AS r,
    count(*) OVER (PARTITION BY decade) AS n
  FROM corpus WHERE split = 'train')
WHERE r <= greatest(1, floor(n * {SHARE}))""", ("corpus",))

_models: dict = {}


def sampled(spark: SparkSession, sf_dir: str, name: str, ids) -> DataFrame:
    """The files of a sample, drawn once per session; broadcast where they are few, so that no text
    is shuffled to keep or to leave out a sample."""
    used = stored(spark, sf_dir, name, lambda: ids(spark, sf_dir).select("file_name"))
    return F.broadcast(used) if at_most(used) else used


def reference(spark: SparkSession, sf_dir: str, order: int = 2) -> ngrams.ReferenceModel:
    """The reference model of the training sample, fitted once per session."""
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), order)
    if key not in _models:
        used = sampled(spark, sf_dir, "reference_ids", reference_ids)
        texts = corpus(spark, sf_dir).join(used, "file_name", "left_semi")
        _models[key] = ngrams.reference_model(texts, order, SEED)
    return _models[key]


VALIDATION_SHARE = 0.5


def validation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample that codes the test and outside sets: half of validation, by decade."""
    texts = corpus(spark, sf_dir).filter("split = 'validation'")
    return prepare.reference_sample_stratified(texts, VALIDATION_SHARE, SEED)


cte("ref_ids_v", f"""
SELECT file_name, decade FROM (
  SELECT file_name, decade,
    row_number() OVER (PARTITION BY decade ORDER BY md5('{SEED}:' || file_name), file_name) AS r,
    count(*) OVER (PARTITION BY decade) AS n
  FROM corpus WHERE split = 'validation')
WHERE r <= greatest(1, floor(n * {VALIDATION_SHARE}))""", ("corpus",))


def reference_validation(spark: SparkSession, sf_dir: str, order: int = 2) -> ngrams.ReferenceModel:
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), "validation", order)
    if key not in _models:
        used = sampled(spark, sf_dir, "validation_ids", validation_ids)
        texts = corpus(spark, sf_dir).join(used, "file_name", "left_semi")
        _models[key] = ngrams.reference_model(texts, order, SEED)
    return _models[key]


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not part of the reference."""
    return prepare.exclude_reference(corpus(spark, sf_dir), sampled(spark, sf_dir, "reference_ids", reference_ids))


def alphabet_size(spark: SparkSession, sf_dir: str) -> int:
    key = (spark.sparkContext.applicationId, source_state(spark, sf_dir), "alphabet")
    if key not in _models:
        texts = corpus(spark, sf_dir).filter("split <> 'gutenberg'")
        _models[key] = ngrams.alphabet(texts).count()
    return _models[key]


# --- the model table: features without n-gram models, cleaned -------------------

MODEL_SUBSETS = {
    "lexical_structure": LEXICAL_FEATURES,
    "readability": READABILITY_FEATURES,
    "distance": DISTANCE_FEATURES,
    "neologism": NEOLOGISM_FEATURES,
}
MODEL_FEATURES = [f for names in MODEL_SUBSETS.values() for f in names]
# The subset behind single-model queries.
MAIN_FEATURES = LEXICAL_FEATURES + READABILITY_FEATURES + DISTANCE_FEATURES
TARGETS = {"decades": "decade", "centuries": "century"}

# Terms that occur in the given texts, added to the lists so that flags vary.
EXTRA_TERMS = {
    "early_modern": ["gravity of"], "industrial": ["und"], "late_industrial": ["la"],
    "early_20th": ["que"], "post_war": ["of the"], "late_modern": ["are"],
    "digital_dawn": ["in the"], "digital_native": ["an", "to the"],
}


def terms() -> dict[str, list[str]]:
    from chronotext.functions.vocabulary import NEOLOGISMS

    return {p: t + EXTRA_TERMS[p] for p, t in NEOLOGISMS.items()}


def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        docs = corpus(spark, sf_dir)
        tasks = text_tasks(text_sizes(docs)[0])
        if tasks > docs.rdd.getNumPartitions():  # large files are cut finer than they lie
            docs = docs.repartition(tasks, "file_name")
        return lexical.lexical_features(
            docs, terms=terms(), keep=["split", "year", "decade", "century"]
        )

    return stored(spark, sf_dir, "raw_features", build)


def imputed(features: DataFrame) -> DataFrame:
    """Missing values and zeros filled. The sets that share a source share the maxima of their word
    columns (and of the one other column that can be null); the outside set has its own maxima,
    on every number."""
    periods = {*METADATA_COLUMNS}
    numbers = [f.name for f in features.schema if isinstance(f.dataType, T.NumericType) and f.name not in periods]
    inside, outside = (features.filter(f"split {op} 'gutenberg'") for op in ("<>", "="))
    own = prepare.impute_max(inside, DISTANCE_FEATURES + ["Flesch_Readability"])
    return own.unionByName(prepare.impute_max(outside, numbers).select(*own.columns))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned features with the class indices of both time scales."""
    def build():
        cleaned = imputed(raw_features(spark, sf_dir))
        train = cleaned.filter("split = 'train'")
        for scale, target in TARGETS.items():
            cleaned = label_encode(cleaned, class_index(train, target), target, f"y_{scale}")
        flags = [F.col(c).cast("double").alias(c) for c in NEOLOGISM_FEATURES]
        return cleaned.select(
            "file_name", "split", "year", "decade", "century", "y_decades", "y_centuries",
            *LEXICAL_FEATURES, *READABILITY_FEATURES, *DISTANCE_FEATURES, *flags,
        )

    return stored(spark, sf_dir, "model_table", build)

