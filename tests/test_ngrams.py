"""Gram jobs against the direct scorer on random and hand-made strings."""

import hashlib
import random
import re
from math import log2

import pytest
from pyspark.sql import functions as F

from chronotext.operators import ngrams
from tests.ppm_scorer import fit, score, self_bits


def strings(n=60):
    rng = random.Random(7)
    out = ["a", "aa", "ab", "a😀é", "aaaa", "abab\nab", " a b "]
    out += ["".join(rng.choice("abcd \n😀"[: rng.randint(1, 7)]) for _ in range(rng.randint(1, 60)))
            for _ in range(n)]
    return [(f"t{i:03d}", s) for i, s in enumerate(out)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(strings(), "file_name string, text string")


@pytest.fixture(scope="module", params=[16_384, 5])
def span(request):
    before = ngrams.SPAN, ngrams.LONG
    ngrams.SPAN = request.param
    if request.param == 5:  # half of the texts are dealt to several tasks
        ngrams.LONG = 20
    yield request.param
    ngrams.SPAN, ngrams.LONG = before


REFERENCE = [("r1", "abcabcaab"), ("r2", "ccb\nba"), ("r3", "d"), ("r4", "😀ab ab")]


def reference_text():
    order = sorted(REFERENCE, key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    return "".join(t + "\n" for _, t in order)


def test_self_code(texts, span):
    got = {r.file_name: r for r in ngrams.self_code(texts, 2).collect()}
    for name, s in strings():
        assert got[name].chars == len(s)
        assert got[name].bits_1 == pytest.approx(self_bits(s, 1), abs=1e-9)
        assert got[name].bits_2 == pytest.approx(self_bits(s, 2), abs=1e-9)
        p = [s.count(c) / len(s) for c in set(s)]
        assert got[name].entropy == pytest.approx(-sum(x * log2(x) for x in p), abs=1e-9)


def test_golden_self_code(spark):
    df = spark.createDataFrame([("one", "a"), ("two", "aa")], "file_name string, text string")
    got = {r.file_name: r.bits_1 for r in ngrams.self_code(df, 1).collect()}
    assert got["one"] == pytest.approx(1.0)
    assert got["two"] == pytest.approx(1.58496, abs=1e-5)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_reference_and_distance(spark, texts, span, order):
    ref = reference_text()
    model = ngrams.reference_model(
        spark.createDataFrame(REFERENCE, "file_name string, text string"), order
    )
    assert model.opening == ref[:order]
    assert model.bits[order] == pytest.approx(self_bits(ref, order), abs=1e-8)
    counts = fit(ref, order)
    code = {r.file_name: r for r in ngrams.reference_code(texts, model, order, 12).collect()}
    joint = {r.file_name: r.joint_bits for r in ngrams.joint_code(texts, model, order).collect()}
    dist = {r[0]: r[1] for r in ngrams.ncd(texts, model, order).collect()}
    for name, s in strings():
        assert code[name].bits == pytest.approx(score(s, counts, order, 12), abs=1e-8)
        assert joint[name] == pytest.approx(self_bits(s + ref, order), abs=1e-8)
        x, y = self_bits(s, order), self_bits(ref, order)
        want = (self_bits(s + ref, order) - min(x, y)) / max(x, y)
        assert dist[name] == pytest.approx(max(0, min(1, want)), abs=1e-8)


def test_large_model_path_gives_same_costs(spark, texts):
    model = ngrams.reference_model(
        spark.createDataFrame(REFERENCE, "file_name string, text string"), 2
    )
    want = {r.file_name: r.bits for r in ngrams.reference_code(texts, model, 2, 12).collect()}
    model._small = False
    got = {r.file_name: r.bits for r in ngrams.reference_code(texts, model, 2, 12).collect()}
    assert got == pytest.approx(want)


def test_alphabet(spark):
    df = spark.createDataFrame([("x", "aA😀"), ("y", "")], "file_name string, text string")
    assert {r.char for r in ngrams.alphabet(df).collect()} == {"a", "😀"}
    assert ngrams.alphabet(df, lowercase=False).count() == 3


def test_partition_count_changes_nothing(texts):
    a = ngrams.self_code(texts.repartition(1), 2).orderBy("file_name").collect()
    b = ngrams.self_code(texts.repartition(7), 2).orderBy("file_name").collect()
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a] == [
        tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b]


def test_one_shuffle_of_text(spark, texts):
    model = ngrams.reference_model(spark.createDataFrame(REFERENCE, "file_name string, text string"), 2)
    for args in ((None, None, None), (model, 12, model)):
        plan = ngrams._code(texts, 2, "file_name", *args, False)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_spans_of_a_long_document_go_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SPAN", 100)
    monkeypatch.setattr(ngrams, "LONG", 1_000)
    rng = random.Random(3)
    one = "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    df = spark.createDataFrame([("one", one), ("none", None), ("empty", "")], "file_name string, text string")
    (_, _), (long, dealt) = ngrams.by_length(df)
    assert dealt and [r.file_name for r in long.collect()] == ["one"]
    plan = ngrams.raw_grams(long, 2, dealt=True)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(([a-z_#0-9, ]+), \d+\)", re.sub(r"#\d+L?", "", plan)) == [
        "file_name, gram", "file_name, _from"]
    got = ngrams.self_code(df, 2).collect()
    assert [r.file_name for r in got] == ["one"] and got[0].bits_2 == pytest.approx(self_bits(one, 2), abs=1e-6)


def test_partitions_follow_the_characters(spark, monkeypatch):
    """More text is cut into more tasks than the session's shuffle partitions."""
    from chronotext import session

    monkeypatch.setattr(session, "TASK_CHARS", 1_000)
    monkeypatch.setattr(ngrams, "LONG", 1 << 20)
    df = spark.createDataFrame([(f"f{i}", "some words " * 100) for i in range(40)], "file_name string, text string")
    chars = session.text_sizes(df)[0]
    assert chars == 44_000 and session.text_partitions(df) == 44
    grams = ngrams.raw_grams(df, 2)
    assert "hashpartitioning(file_name" in (plan := grams._jdf.queryExecution().executedPlan().toString()) and ", 44)" in plan
    assert len(ngrams.by_length(df)) == 1  # no branch for long texts where there are none
    assert sorted(r["n"] for r in ngrams.char_ngrams(df, 1).groupBy("file_name").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()) == [1_100] * 40


def awkward_texts():
    """Random texts, with repeated rows, an id of two texts, null ids, null and empty texts, a wide alphabet."""
    rng = random.Random(11)
    rows = strings(30) + [("t003", "ab"), ("t003", "ab"), ("two", "abc cba"), ("two", "cab"), (None, "ab\nab"), (None, "q"),
                          ("none", None), ("empty", "")]
    return rows + [(f"wide{i}", "".join(chr(rng.randint(0x4E00, 0x4E00 + 900)) for _ in range(300))) for i in range(4)]


@pytest.mark.parametrize("order", [1, 2])
def test_codes_on_arrays_equal_the_dataframe_sums(spark, monkeypatch, order):
    monkeypatch.setattr(ngrams, "LONG", 1 << 20)  # the spans of the tests before may still hold
    df = spark.createDataFrame(awkward_texts(), "file_name string, text string")
    model = ngrams.reference_model(spark.createDataFrame(REFERENCE, "file_name string, text string"), order)
    code = ngrams.document_code(df, order, model=model, alphabet_size=950, joint=model)
    plan = code._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan and "Generate" not in plan
    got = {r.file_name: r for r in code.collect()}
    monkeypatch.setattr(ngrams.gram_arrays, "MOST_ORDER", 0)
    sums = ngrams.document_code(df, order, model=model, alphabet_size=950, joint=model)
    assert "regexp_extract_all" in sums._jdf.queryExecution().executedPlan().toString()
    want = {r.file_name: r for r in sums.collect()}
    assert code.schema == sums.schema and got.keys() == want.keys() and {"two", None} <= got.keys()
    for key, row in want.items():
        assert tuple(got[key]) == pytest.approx(tuple(row), abs=1e-8), key
    other = ngrams.reference_model(spark.createDataFrame(REFERENCE, "file_name string, text string"), order)
    assert sorted(map(tuple, other.grams.collect())) == sorted(map(tuple, model.grams.collect()))


def test_grams_without_room_are_coded_in_parts(monkeypatch):
    from chronotext.operators import gram_arrays as G

    rows = sorted((k, t) for k, t in awkward_texts() if k and t)
    ids, texts = zip(*rows)

    def coded():
        parts = G.code_texts(ids, texts, 2, "", None, None, None, {})
        return len(parts), {k: tuple(c[i] for c in columns) for keys, columns in parts for i, k in enumerate(keys)}

    whole, want = coded()
    monkeypatch.setattr(G, "WIDTH", 31)
    monkeypatch.setattr(G, "TABLE_BITS", 4)
    parts, got = coded()
    assert whole == 1 and parts > 1 and got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=1e-9)


def test_rows_of_one_long_id_are_dealt(spark, monkeypatch):
    """Rows of one id are one document: together beyond LONG, their spans go to many tasks."""
    monkeypatch.setattr(ngrams, "LONG", 100)
    rows = [("many", "abcab " * 9)] * 5 + [("few", "abcab " * 9), (None, "xy " * 20), (None, "xy " * 20)]
    df = spark.createDataFrame(rows, "file_name string, text string")
    (short, _), (long, dealt) = ngrams.by_document(df, ngrams.document_sizes(df)[1])
    assert dealt and {r[0] for r in short.collect()} == {"few"} and {r[0] for r in long.collect()} == {"many", None}
    got = {r.file_name: tuple(r)[1:] for r in ngrams.self_code(df, 2).collect()}
    monkeypatch.setattr(ngrams, "LONG", 1 << 20)
    for r in ngrams.self_code(df, 2).collect():
        assert got[r.file_name] == pytest.approx(tuple(r)[1:])


def test_alphabet_takes_no_array_of_characters(spark):
    df = spark.createDataFrame([("x", "abé" * 9), ("y", None), ("z", "Ab😀\n")], "file_name string, text string")
    found = ngrams.alphabet(df.repartition(4))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.char for r in found.collect()) == sorted("abé😀\n")
