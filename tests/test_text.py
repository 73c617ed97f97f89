"""Hand-made golden rows for the text expressions and sources."""

import json
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from chronotext.functions import text as X
from chronotext.functions import vocabulary as voc
from chronotext.operators import lexical
from chronotext.sources import corpus as S
from chronotext.sources import sinks


def one(spark, text, column):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(column(F.col("text")).alias("v")).first().v


def test_words_and_space(spark):
    assert one(spark, " a b ", lambda T: X.words(T)) == ["a", "b"]
    assert one(spark, "a b\x1cc d", lambda T: X.words(T)) == "a b\x1cc d".split()
    assert one(spark, "", lambda T: X.words(T)) == []


@pytest.mark.parametrize("text", ["A b. C. ", "", ". . a . b", "x. y", "a.. b. \n. c", "one.two. three"])
def test_sentence_length(spark, text):
    pieces = text.split(". ")
    want = sum(len(p.split()) for p in pieces) / len(pieces)
    assert one(spark, text, lambda T: X.avg_sentence_length(T, F.size(X.words(T)))) == pytest.approx(want)


def test_character_ratios(spark):
    text = "a1²٣ (x)! é" + "".join(chr(c) for c in range(33, 127))
    import string

    assert one(spark, text, lambda T: X.punctuation_density(T)) == pytest.approx(
        sum(c in string.punctuation for c in text) / len(text))
    assert one(spark, text, lambda T: X.digit_ratio(T)) == pytest.approx(sum(c.isdigit() for c in text) / len(text))


def test_digit_class_is_complete(spark):
    digits = [c for c in map(chr, range(sys.maxunicode + 1))
              if c.isdigit() and unicodedata.unidata_version]
    known = one(spark, "".join(digits), lambda T: X.count_matches(T, X.DIGIT))
    # A newer Unicode table may know decimal digits the Java runtime does not.
    other = [c for c in digits if unicodedata.category(c) != "Nd"]
    assert one(spark, "".join(other), lambda T: X.count_matches(T, X.DIGIT)) == len(other)
    assert known >= len(digits) * 0.85


def test_word_measures(spark):
    text = "The cat the DOG"
    assert one(spark, text, lambda T: X.avg_word_length(X.words(T))) == 3.0
    assert one(spark, text, lambda T: X.lexical_richness(X.words(T))) == 1.0
    assert one(spark, text, lambda T: X.stopword_ratio(X.words(T))) == 0.5
    assert one(spark, "horse made tree b the", lambda T: X.syllables(T)) == 1 + 1 + 1 + 1 + 1
    assert one(spark, "   ", lambda T: X.flesch_readability(T, X.syllables(T), F.size(X.words(T)))) is None


def test_gaps(spark):
    def hits(T):
        return X.target_hits(X.words(T), ["the", "x"])

    row = "The x the y y the"
    assert one(spark, row, lambda T: X.mean_gap(hits(T), "the")) == 2.5
    assert one(spark, row, lambda T: X.median_gap(hits(T), "the")) == 2.5
    assert one(spark, row, lambda T: X.mean_gap(hits(T), "x")) is None
    assert one(spark, "the, the", lambda T: X.mean_gap(hits(T), "the")) is None
    assert one(spark, "the the a the a a a a the", lambda T: X.median_gap(hits(T), "the")) == 2.0


@pytest.mark.parametrize("text,flags", [
    ("Steam\nEngine", {"industrial"}), ("a cd-rom here", {"digital_dawn"}), ("cdrom", set()),
    ("cd-romé", set()), ("x-radio", set()), ("radio's", set()), ("my radio.", {"early_20th"}),
    ("caféradio", set()), ("é-radio", {"early_20th"}), ("Radio", set()), ("personal computers", set()),
    ("ſteam ENGINE", {"industrial"}), ("television series", {"post_war", "early_20th"}),
])
def test_neologisms(spark, text, flags):
    df = spark.createDataFrame([("f", text)], "file_name string, text string")
    row = lexical.lexical_features(df).first()
    assert {p for p in voc.NEOLOGISMS if row[f"contains_{p}_words"]} == flags
    assert row.contains_modern_vocabulary == bool(flags & set(voc.MODERN_PERIODS))
    assert row.vocabulary_modernity_score == pytest.approx(len(flags & set(voc.MODERN_PERIODS)) / 3)


def test_vocabulary_sizes():
    sizes = {s: len(f) for s, f in voc.SUBSET_FEATURES.items()}
    assert sizes == {"compression": 7, "lexical_structure": 6, "readability": 2, "distance": 17,
                     "neologism": 11, "final_model": 43, "optimal": 10}
    assert all(len(t) == 15 for t in voc.NEOLOGISMS.values())
    with pytest.raises(ValueError):
        voc.subset_drop_columns("unknown")


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("café".encode() + b"\xff!")
    (tmp_path / "sub" / "b.txt").write_text("two\nlines")
    (tmp_path / "sub" / "empty.txt").write_text("")
    (tmp_path / "c.md").write_text("no")
    got = {r.file_name: r.text for r in S.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "café!", "b.txt": "two\nlines"}


def test_dictionary_and_null_tokens(spark, tmp_path):
    body = {"english": ["a", "b", "a"], "neologisms": {"p": ["x y", "z"]}, "neologism_periods": {"p": [1, 2]}}
    (tmp_path / "d.json").write_text(json.dumps(body, indent=1))
    words, terms, periods = S.read_dictionary(spark, str(tmp_path / "d.json"))
    assert sorted(map(tuple, words.collect())) == [("english", "a"), ("english", "b")]
    assert sorted(map(tuple, terms.collect())) == [("p", "x y"), ("p", "z")]
    assert [tuple(r) for r in periods.collect()] == [("p", 1, 2)]
    (tmp_path / "f.csv").write_text("file_name,v,w\na,None,1.5\nb,,bad\nc,2,True\n")
    rows = S.read_features(spark, str(tmp_path / "f.csv")).orderBy("file_name").collect()
    assert [tuple(r) for r in rows] == [("a", None, 1.5), ("b", None, None), ("c", 2.0, 1.0)]


def test_metadata_columns_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text("century,x,file_name,decade,year\n19,q,a,1810,1815\n")
    assert tuple(S.read_metadata(spark, str(tmp_path / "m.csv")).first()) == ("a", 1815, 1810, 19)


def test_sink_replaces_its_split(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "train"), ("b", 2.0, "test")], "file_name string, v double, split string")
    path = str(tmp_path / "out")
    sinks.write_features(df, path)
    sinks.write_features(df.filter("split = 'test'"), path)
    assert spark.read.parquet(path).count() == 2


def test_text_files_are_listed_by_tasks(spark, tmp_path):
    """No file index in the plan, and the files that Spark's reader takes."""
    for n in ("a.txt", "b c%2F.txt", "ü.txt", ".hidden.txt", "_left.txt", "_k=1.txt", "x.md", "deep/er/d.txt", "_off/e.txt",
              "p=1/a.txt", "two\nlines.txt", "[x]\u00a0é😀~!.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(f"text of {n}")
    got = S.read_text_files(spark, str(tmp_path))
    assert got.inputFiles() == [] and "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    for pattern in ("*.txt", "{a,d}.txt", "?.md", "[!a].*"):
        got = sorted(map(tuple, S.read_text_files(spark, str(tmp_path), pattern).collect()))
        assert got == sorted(map(tuple, S.spark_files(spark, str(tmp_path), pattern).collect())) and got
    # Patterns, single files and missing folders go to Spark's reader.
    assert {r.file_name for r in S.read_text_files(spark, f"{tmp_path}/*/er").collect()} == {"d.txt"}
    assert {r.file_name for r in S.read_text_files(spark, f"{tmp_path}/a.txt").collect()} == {"a.txt"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_text_files(spark, f"{tmp_path}/none").collect()


def test_contents_come_in_bounded_batches(tmp_path, monkeypatch):
    import pyarrow as pa

    from chronotext.sources import folders

    for i in range(7):
        (tmp_path / f"{i}.txt").write_text("x" * 60)
    monkeypatch.setattr(folders, "BYTES", 100)
    monkeypatch.setattr(folders, "NAMES", 3)
    listed = list(folders.listing([pa.record_batch({"path": [f"file://{tmp_path}"]})], ".*", deep=False))
    assert [b.num_rows for b in listed] == [3, 3, 1]
    read = list(folders.contents(listed))
    assert [b.num_rows for b in read] == [2, 2, 2, 1] and sorted(n for b in read for n in b.column(0).to_pylist()) == [f"{i}.txt" for i in range(7)]
