"""Per-document feature rows built from the text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions import text as X
from chronotext.functions.vocabulary import NEOLOGISMS, TARGET_WORDS
from chronotext.operators import ngrams
from chronotext.session import text_partitions


def lowercase(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    return corpus.withColumn(text_col, F.lower(text_col))


def tokenize(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("words", X.words(F.col("text")))


def lexical_features(
    corpus: DataFrame,
    language: str = "english",
    gap: str = "mean",
    terms: dict[str, list[str]] | None = None,
    id_col: str = "file_name",
    keep: list[str] | None = None,
) -> DataFrame:
    """Lexical, readability, word-gap and vocabulary columns: a narrow pass."""
    text, tokens, n = F.col("text"), F.col("_words"), F.size("_words")
    keep, terms = keep or [], terms or NEOLOGISMS
    prepared = (
        corpus.select(id_col, *keep, "text")
        .withColumn("_words", X.words(text))
        .withColumns({
            "_hits": X.target_hits(tokens, TARGET_WORDS[language]),
            "_found": X.listed_words(text, terms),
            "_low": X.folded(text),
            "_syllables": X.syllables(text),
        })
    )
    flags = X.neologism_columns(text, F.col("_low"), F.col("_found"), terms)
    columns = [
        X.avg_word_length(tokens).alias("Avg_Word_Length"),
        X.lexical_richness(tokens).alias("Lexical_Richness"),
        X.avg_sentence_length(text, n).alias("Avg_Sentence_Length"),
        X.punctuation_density(text).alias("Punctuation_Density"),
        X.syllable_per_word(F.col("_syllables"), n).alias("Syllable_Per_Word"),
        X.digit_ratio(text).alias("Digit_Ratio"),
    ]
    if language == "english":
        columns.append(X.flesch_readability(text, F.col("_syllables"), n).alias("Flesch_Readability"))
    if X.stop_words(language):
        columns.append(X.stopword_ratio(tokens, language).alias("Stopword_Ratio"))
    columns += X.word_gap_columns(F.col("_hits"), language, gap)
    rows = prepared.select(id_col, *keep, *columns, *flags)
    return rows.select("*", *X.neologism_aggregates())


def by_language(corpus: DataFrame, languages: dict[str, str], expression) -> list:
    """Pick an expression by the row's language code; null for other codes."""
    branches = [
        F.when(F.col("lang") == code, expression(name)) for code, name in languages.items()
    ]
    return F.coalesce(*branches)


def word_gaps_long(
    corpus: DataFrame, languages: dict[str, str], id_col: str = "file_name"
) -> DataFrame:
    """(id, lang, word, occurrences, mean_gap, median_gap) for the target words of
    each row's own language."""
    hits = by_language(
        corpus, languages, lambda name: X.target_hits(F.col("_words"), TARGET_WORDS[name])
    )
    places = (
        corpus.withColumn("_words", X.words(F.col("text")))
        .select(id_col, "lang", hits.alias("_hits"))
        .withColumn("word", F.explode(F.array_distinct(F.transform("_hits", lambda h: h["w"]))))
    )
    word = F.col("word")
    return places.select(
        id_col, "lang", "word",
        F.size(X.positions(F.col("_hits"), word)).cast("bigint").alias("occurrences"),
        X.mean_gap(F.col("_hits"), word).alias("mean_gap"),
        X.median_gap(F.col("_hits"), word).alias("median_gap"),
    )


def documented_extras(corpus: DataFrame, id_col: str = "file_name") -> DataFrame:
    """Documented ratios outside the standard row."""
    text, parts = F.col("text"), text_partitions(corpus)
    counted = (
        corpus.select(id_col, "text", X.words(text).alias("_words"))
        .repartition(parts, id_col)
        .select(id_col, "text", F.size("_words").alias("_n"), F.explode_outer("_words").alias("_w"))
        .groupBy(id_col, "_n", "_w")
        .agg(F.count("_w").alias("_c"))
        .groupBy(id_col, "_n")
        .agg(
            F.sum(F.when(F.col("_c") == 1, 1).otherwise(0)).alias("_hapax"),
            F.count("_w").alias("_types"),
        )
    )
    own = corpus.select(
        id_col,
        X.uppercase_ratio(text).alias("Uppercase_Ratio"),
        X.special_character_ratio(text).alias("Special_Character_Ratio"),
    ).repartition(parts, id_col)
    entropy = ngrams.character_entropy(corpus, id_col)
    n = F.col("_n")
    return (
        own.join(counted, id_col)
        .join(entropy, id_col, "left")
        .select(
            id_col, "Uppercase_Ratio", "Special_Character_Ratio",
            X.ratio(F.col("entropy"), n).alias("Entropy_Per_Word"),
            X.ratio(F.col("_hapax"), n).alias("Hapax_Ratio"),
            X.ratio(F.col("_types"), n).alias("Type_Token_Ratio"),
        )
    )


def feature_row(
    corpus: DataFrame,
    model: ngrams.ReferenceModel | None,
    alphabet_size: int,
    order: int = 2,
    language: str = "english",
    use_ncd: bool = False,
    gap: str = "mean",
    terms: dict[str, list[str]] | None = None,
    id_col: str = "file_name",
) -> DataFrame:
    """The wide feature row of texts that are not empty. The distances come from the grams of the other codes."""
    orders = sorted({1, order})
    sizes = ngrams.document_sizes(corpus, id_col)
    placed = ngrams.placed(corpus, text_partitions(corpus, sizes[0]), id_col)  # the code reads the same exchange
    joint = model if use_ncd else None
    code = ngrams.document_code(corpus, order, id_col, model, alphabet_size, joint, sizes)
    bits = "bits_{}" if model is None else "ref_bits_{}"
    columns = [
        ngrams.nrc_column(F.col(bits.format(k)), F.col("chars"), k, alphabet_size) for k in orders
    ]
    if joint is not None:
        columns += [ngrams.ncd_column(joint, k) for k in orders]
    return lexical_features(placed, language, gap, terms, id_col).join(
        code.select(id_col, *ngrams.self_columns(orders), *columns), id_col)
