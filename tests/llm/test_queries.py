"""The registered queries over the smallest tables: beside their SQL, or beside brute force, an
exact round trip or held-out accuracy where SQL can't express them; and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chronotext.llm import decontaminate, jaccard_join, nb_svm, quality_rules, warc
from tests.check import compare, connect
from tests.llm.test_operators import plain_components, plain_hits

SF = "/root/testdata/sf0.001"
WITH_SQL = ["op3_chat_formatting", "op4_url_filters", "op5_ngram_jaccard_join", "op6_quality_rules", "op10_benchmark_decontamination",
            "op11_line_dedup", "op12_conversation_repair", "op13_periodic_runs"]


def table(name):
    return connect(SF).execute(f"SELECT * FROM {name}").df()


@pytest.mark.parametrize("key", WITH_SQL)
def test_matches_sql(spark, key):
    got = entry.queries()[key](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(entry.oracle_sql()[key]).df()) is None


def test_every_operator_has_its_query():
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert {k for k in names if k in entry.oracle_sql()} == set(WITH_SQL)
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_token_counts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = entry.queries()["op1_token_counts"](spark, SF).toPandas().set_index("doc_id")
    for r in table("documents").itertuples():
        n = len(lib.encode(r.text or ""))
        assert tuple(got.loc[r.doc_id, ["n_bytes", "n_tokens", "over_limit"]]) == (len((r.text or "").encode()), n, n > 4096)


def test_warc_records(spark):
    got = entry.queries()["op2_warc_derivatives"](spark, SF).toPandas()
    pages = table("pages").set_index("page_id")
    assert len(got) == 2 * len(pages) and got.record_id.nunique() == len(got)
    for r in got.itertuples():
        page = pages.loc[r.page_id]
        assert r.refers_to == warc.named_id("response", str(r.page_id), page.url) and r.target_uri == page.url
        assert r.source_payload_digest == warc.digest(page.html.encode()) and r.block_digest == warc.digest(bytes(r.block))
        if r.warc_type == "conversion":
            assert bytes(r.block).decode() == warc.plain_text(page.html)


def test_quality_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op7_quality_classifier"](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == got.predicted).all()
    known = connect(sf).execute("SELECT doc_id, quality FROM labels").df().merge(got[got.held_out], on="doc_id")
    assert len(known) > 300 and (known.quality == known.predicted).mean() > 0.95
    assert (known[known.quality == 1].predicted == 1).mean() > 0.98


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op8_language_id"](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    known = connect(sf).execute("SELECT doc_id, lang, text FROM documents").df().merge(got, on="doc_id")
    letters = known.text.map(lambda t: t is not None and any(c.isalpha() for c in t))
    assert ((known.lang_pred == "und") == ~letters).all()
    held = known[known.held_out & letters & known.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.98


def check_packing(got: pd.DataFrame, docs, capacity=2048):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.itertuples():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at: at + capacity], "<u4")
            want[r.doc_id, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    sequences = defaultdict(list)
    for r in got.itertuples():
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-got.length.sum() // capacity) * 1.01 + 1


def test_packing(spark):
    check_packing(entry.queries()["op9_best_fit_packing"](spark, SF).toPandas(), table("documents"))


# --- the pipeline ----------------------------------------------------------------------

def test_pipeline_stages_like_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, beside a computation of its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = table("documents"), docs.columns
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
            kept.append(set(after.doc_id))
        if name == "quality rules":
            told = connect(SF).execute(entry.oracle_sql()["op6_quality_rules"]).df()
            assert set(after.doc_id) == set(told[told.kept].doc_id)
            lines = dict(zip(before.doc_id, before.text))
            for r in after.itertuples():
                assert len(r.text) == r.n_chars
                assert set(r.text.split("\n")) <= set(lines[r.doc_id].split("\n"))
        elif name == "quality classifier":
            rows = spark.createDataFrame(before)
            model = corpus_pipeline.quality_model(spark, rows, SF)
            scores = nb_svm.score(rows, model).toPandas()
            assert set(after.doc_id) == set(scores[scores.score >= 0.3].doc_id)
        elif name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.itertuples()]
            assert set(after.doc_id) == {i for i, _, c in plain_components(rows) if i == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table("benchmark").itertuples()]
            hits = {r[0] for r in plain_hits([(r.doc_id, r.text) for r in before.itertuples()], items) if r[2]}
            assert set(after.doc_id) == set(before.doc_id) - hits and hits
        else:
            check_packing(after, before)
        before = after
    assert all(b <= a for a, b in zip(kept, kept[1:]))


def test_pipeline_run(spark):
    got = entry.queries()["pipeline"](spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)


def test_pipeline_stages_take_odd_tables(spark):
    """Nulls, empty texts, further columns and an empty table."""
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "one two three " * 9, None, None, 1, "y"),
            (3, " ".join(f"w{i}" for i in range(60)), "en", None, 5, "z"), (3, " ".join(f"w{i}" for i in range(60)), "en", None, 5, "z")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if name != "packing":
                assert out.columns == frame.columns
            assert out.count() <= 5
    one = corpus_pipeline.STAGES[2][1](spark, odd, SF)
    assert one.filter("doc_id = 3").count() == 1 and one.filter("doc_id = 1 OR doc_id = 2").count() == 2
    assert quality_rules and jaccard_join and decontaminate
