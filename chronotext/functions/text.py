"""Lexical, readability, spacing and vocabulary expressions over one text column.

Each expression reads the whole text of its own row, so a feature table is one
narrow pass without a shuffle. Ratios are 0 when their denominator is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotext.functions.vocabulary import (
    ENGLISH_STOP_WORDS, HISTORICAL_PERIODS, MODERN_PERIODS, NEOLOGISMS, TARGET_WORDS,
)

# Unicode white space plus the four separator controls that also end a word.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
# Digits outside the decimal-number class that still count as digits.
DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)
# An ASCII character settles on the first branch; only others reach the long class.
DIGIT = rf"[0-9]|(?=[^\x00-\x7F]){DIGIT}"
# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_CHAR = r"[\p{L}\p{N}_]"
COMPOUND = rf"(?<!{WORD_CHAR})[a-zA-Z]+(?:[-'][a-zA-Z]+)*(?!{WORD_CHAR})"


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    """Tokens between runs of white space; punctuation stays attached."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return count_matches(text, NOT_SPACE + "+")


def avg_word_length(tokens: Column) -> Column:
    return ratio(F.length(F.array_join(tokens, "")), F.size(tokens))


def lexical_richness(tokens: Column) -> Column:
    return ratio(F.size(F.array_distinct(tokens)), F.size(tokens))


def avg_sentence_length(text: Column, n_words: Column) -> Column:
    """Mean words per piece between '. ' marks; empty pieces count. Splitting there
    loses only the words that are a single full stop."""
    without = F.length(F.replace(text, F.lit(". "), F.lit("")))
    pieces = (F.length(text) - without) / 2 + 1
    lone = count_matches(text, rf"\.(?<!{NOT_SPACE[4:]}\.) ")
    return (n_words - lone) / pieces


def punctuation_density(text: Column) -> Column:
    others = F.length(F.translate(text, PUNCTUATION, ""))
    return ratio(F.length(text) - others, F.length(text))


def digit_ratio(text: Column) -> Column:
    return ratio(count_matches(text, DIGIT), F.length(text))


def stop_words(language: str) -> list[str]:
    """The English list is a fixed value; other lists are the ones Spark ML ships."""
    if language == "english":
        return sorted(ENGLISH_STOP_WORDS)
    from pyspark.errors import IllegalArgumentException
    from pyspark.ml.feature import StopWordsRemover

    try:
        return sorted(set(StopWordsRemover.loadDefaultStopWords(language)))
    except IllegalArgumentException:  # no list for this language
        return []


def stopword_ratio(tokens: Column, language: str = "english") -> Column:
    listed = stop_words(language)
    if not listed:
        return F.lit(0.0)
    return ratio(F.size(F.filter(tokens, lambda w: F.lower(w).isin(listed))), F.size(tokens))


def syllables(text: Column) -> Column:
    """Estimated syllables of all words: vowel groups, less a silent final e,
    at least one for each word."""
    low = F.lower(text)
    groups = count_matches(low, "[aeiouy]+")
    silent = count_matches(low, r"(?U)[aeiouy][^aeiouy\s]+e[^\p{L}\s]*(?!\S)")
    without_vowel = count_matches(low, r"(?U)(?<!\S)[^aeiouy\s]+(?!\S)")
    return groups - silent + without_vowel


def syllable_per_word(n_syllables: Column, n_words: Column) -> Column:
    return ratio(n_syllables, n_words)


def flesch_readability(text: Column, n_syllables: Column, n_words: Column) -> Column:
    """Reading ease on the estimated syllables; null without words."""
    sentences = F.greatest(F.lit(1), count_matches(text, r"(?U)[.!?]+(?!\S)"))
    score = 206.835 - 1.015 * (n_words / sentences) - 84.6 * (n_syllables / n_words)
    return F.when(n_words > 0, score)


def target_hits(tokens: Column, targets: Iterable[str]) -> Column:
    """Array of (w, p): each target word met and its position."""
    wanted = list(targets)
    placed = F.transform(
        tokens, lambda w, i: F.struct(F.lower(w).alias("w"), i.cast("bigint").alias("p"))
    )
    return F.filter(placed, lambda h: h["w"].isin(wanted))


def positions(hits: Column, word: str) -> Column:
    return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["p"])


def mean_gap(hits: Column, word: str) -> Column:
    """Mean distance of successive places; the sum of steps is last minus first."""
    places = positions(hits, word)
    steps = F.size(places) - 1
    return F.when(steps > 0, (F.element_at(places, -1) - F.element_at(places, 1)) / steps)


def median_gap(hits: Column, word: str) -> Column:
    places = positions(hits, word)
    steps = F.size(places) - 1
    gaps = F.array_sort(
        F.zip_with(F.slice(places, F.lit(2), steps), F.slice(places, F.lit(1), steps),
                   lambda b, a: b - a)
    )
    middle = (
        F.element_at(gaps, F.floor((steps + 1) / 2).cast("int"))
        + F.element_at(gaps, F.floor((steps + 2) / 2).cast("int"))
    ) / 2.0
    return F.when(steps > 0, middle)


def word_gap_columns(
    hits: Column, language: str = "english", kind: str = "mean"
) -> list[Column]:
    gap = {"mean": mean_gap, "median": median_gap}[kind]
    return [gap(hits, w).alias(w) for w in TARGET_WORDS[language]]


def compound_words(text: Column) -> Column:
    """ASCII words of a text, hyphen and apostrophe compounds kept whole."""
    return F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case with the long s as s: what a case-blind match compares."""
    return F.translate(F.lower(text), "\u017f", "s")


def contains_phrase(text: Column, low: Column, phrase: str) -> Column:
    """A phrase in any case, with any white space between its words. The plain search
    for its words settles nearly every text before the pattern is tried."""
    parts = phrase.split(" ")
    pattern = r"(?U:\s+)".join(map(re.escape, parts))
    hit = F.rlike(text, F.lit(rf"(?iu)(?<!{WORD_CHAR}){pattern}(?!{WORD_CHAR})"))
    for part in sorted(set(parts), key=len):
        hit = F.contains(low, F.lit(part)) & hit
    return hit


def listed_words(text: Column, terms: dict[str, list[str]]) -> Column:
    """The compound words of a text that any period lists."""
    every = sorted({t for listed in terms.values() for t in listed if " " not in t})
    return F.array_distinct(F.filter(compound_words(text), lambda w: w.isin(every)))


def contains_terms(text: Column, low: Column, found: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms: single words as members of the
    compound-word set, phrases as such."""
    single = [t for t in terms if " " not in t]
    hit = F.lit(False)
    if single:
        hit = hit | F.arrays_overlap(found, F.array(*[F.lit(t) for t in single]))
    for phrase in (t for t in terms if " " in t):
        hit = hit | contains_phrase(text, low, phrase)
    return hit


def neologism_columns(
    text: Column, low: Column, found: Column, terms: dict[str, list[str]] | None = None
) -> list[Column]:
    """Period flags; `low` is the folded text and `found` its listed words."""
    terms = terms or NEOLOGISMS
    return [
        contains_terms(text, low, found, t).alias(f"contains_{p}_words") for p, t in terms.items()
    ]


def neologism_aggregates() -> list[Column]:
    """Summary columns over the period flags already present in the frame."""
    def any_of(periods: list[str]) -> Column:
        return F.greatest(*[F.col(f"contains_{p}_words") for p in periods])

    score = sum(F.col(f"contains_{p}_words").cast("int") for p in MODERN_PERIODS)
    return [
        any_of(MODERN_PERIODS).alias("contains_modern_vocabulary"),
        any_of(HISTORICAL_PERIODS).alias("contains_historical_vocabulary"),
        (score / F.lit(float(len(MODERN_PERIODS)))).alias("vocabulary_modernity_score"),
    ]


def uppercase_ratio(text: Column) -> Column:
    return ratio(count_matches(text, r"\p{Lu}"), count_matches(text, r"\p{L}"))


def special_character_ratio(text: Column) -> Column:
    """Characters that are neither letter, number, ASCII punctuation nor space."""
    plain = r"(?U)[^\p{L}\p{N}\s\x1c-\x1f!-/:-@\[-`{-~]"
    return ratio(count_matches(text, plain), F.length(text))
