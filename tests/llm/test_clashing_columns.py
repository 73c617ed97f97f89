"""Documents whose further columns bear the names that operators use inside or give back."""

import pytest

import corpus_pipeline
from chronotext.llm import decontaminate, quality_rules, token_counts, url_rules
from chronotext.llm.common import find_package
from chronotext.llm.queries import URL_RULES, vocabulary

INNER = ("removed_lines", "removed_words", "kept", "version", "host", "doc", "__spans", "__gone", "hit_spans", "c0", "of_doc", "nth", "lines")


@pytest.fixture(scope="module")
def sp(spark):
    find_package(spark)
    return spark


def test_documents(sp):
    line = "A line that every one of these documents holds"
    rows = [(i, f"{line}\n" + " ".join(f"w{i}x{k}" for k in range(40)), "en", "h", 300, *range(len(INNER))) for i in range(30)]
    fields = ", ".join(f"`{c}` int" for c in INNER)
    docs = sp.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {fields}")
    found = quality_rules.clean(docs, n_chars="n_chars")
    assert found.columns == docs.columns
    got = found.collect()
    assert len(got) == 30 and all(line not in r["text"] and tuple(r)[5:] == tuple(range(len(INNER))) for r in got)
    first = corpus_pipeline.rules_stage(sp, docs, "")
    assert first.columns == docs.columns and first.count() == 30
    items = sp.createDataFrame([("b", rows[3][1])], "item_id string, text string")
    hits = decontaminate.contamination(docs, items)
    cut = decontaminate.without_spans(docs, hits)
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()}[3] == ""
    assert decontaminate.without_documents(docs, hits).columns == docs.columns


def test_kept_columns(sp):
    pages = sp.createDataFrame([(1, "http://a.net/x", "kept", "also")], "page_id bigint, url string, host string, rule string")
    got = url_rules.judge_urls(pages, URL_RULES, keep=("host", "rule"))
    assert got.columns == ["host", "rule", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == ("kept", "also", "a.net", "/x", "net/", "block")
    docs = sp.createDataFrame([(1, "one two", 7)], "doc_id bigint, text string, n_bytes int")
    got = token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model"), 10, keep=("n_bytes", "text"))
    assert got.columns[:3] == ["n_bytes", "text", "n_bytes"] and tuple(got.first())[:3] == (7, "one two", 7)
