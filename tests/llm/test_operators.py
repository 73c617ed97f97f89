"""Operators on small odd tables: nulls, empty and long texts, ties, repeated rows, empty tables
and further columns with clashing names; and beside brute force."""

import hashlib
import itertools
import json
import math
import random
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronotext.llm import (
    best_fit, chat, decontaminate, jaccard_join, language_id, nb_svm, quality_rules, token_counts, url_rules, warc,
)
from chronotext.llm.common import find_package

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, score double, version string, n int"
SPM, BPE, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def sp(spark):
    find_package(spark)
    return spark


def docs_of(sp, rows):
    """Documents (id, text, lang, source) with further columns whose names operators use inside."""
    return sp.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 0.5, "v", 3) for r in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_documents(seed=1):
    rng = random.Random(seed)
    base = [" ".join(words(rng, 60)) for _ in range(4)]
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t", "en", None), (4, "one two", "fr", "s"), (5, "one  TWO", None, "s")]
    for i, b in enumerate(base):
        rows += [(10 + 10 * i, b, "en", "s"), (11 + 10 * i, b.upper(), "en", "t")]
        for k in range(3):
            ws = b.split()
            for _ in range(k):
                ws[rng.randrange(60)] = "zz"
            rows.append((12 + 10 * i + k, "\n".join(" ".join(ws[j: j + 12]) for j in range(0, 60, 12)), "de", "s"))
    rows += [rows[5], rows[5], (60, " ".join(words(rng, 30_000, 9000)), "en", "s"), (None, base[0], "en", "s"), (None, "alone " * 7, None, None)]
    return rows


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- token counts ----------------------------------------------------------------------

def test_token_counts(sp):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=SPM)
    rows = odd_documents()
    got = token_counts.token_counts(docs_of(sp, rows), SPM, 20, keep=("doc_id", "n", "node"))
    want = [(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 20, 3, 1) for i, t, *_ in rows]
    assert collected(got, "doc_id", "n_bytes", "n_tokens", "over_limit", "n", "node") == sorted(want, key=repr)
    assert token_counts.token_counts(docs_of(sp, []), SPM, 20).count() == 0
    short = [r for r in rows if r[0] and r[0] < 20]
    for r in token_counts.prefix_counts(docs_of(sp, short), SPM, keep=("doc_id", "text")).collect():
        t = r["text"] or ""
        assert r["prefix_tokens"] == [len(lib.encode(t[:k])) for k in range(len(t) + 1)]


# --- WARC ------------------------------------------------------------------------------

def test_warc(sp, tmp_path):
    pages = sp.createDataFrame(
        [(1, "http://a/", "<p>x</p>", "r"), (2, None, None, "r"), (3, "u", "", "r"), (1, "http://a/", "<p>x</p>", "r"), (None, "v\r\nX: y", "é" * 9, "r")],
        "page_id bigint, url string, html string, record_id string")
    made = warc.responses(pages, "2024-01-01T00:00:00Z")
    got = warc.derive(made, keep=("page_id",)).collect()
    assert Counter((r["page_id"], r["warc_type"]) for r in got) == Counter(
        {(i, k): 2 if i == 1 else 1 for i in (1, 2, 3, None) for k in ("metadata", "conversion")})
    source = {r["record_id"]: r for r in made.collect()}
    for r in got:
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"])
        response = source[r["refers_to"]]
        payload = bytes(response["block"]).partition(b"\r\n\r\n")[2]
        assert r["source_payload_digest"] == warc.digest(payload) and r["target_uri"] == response["target_uri"]
        if r["warc_type"] == "metadata":
            assert ["WARC-Payload-Digest", warc.digest(payload)] in json.loads(bytes(r["block"]))["warc-headers"]
        else:
            assert bytes(r["block"]).decode() == warc.plain_text(payload.decode())
    assert warc.derive(warc.responses(pages.limit(0), "d"), keep=("page_id",)).count() == 0
    file = tmp_path / "a.warc"
    file.write_bytes(b"".join(warc.serialize(r["headers"], bytes(r["block"])) for r in made.collect()) + warc.serialize(
        warc.header_lines([("WARC-Type", "warcinfo"), ("Content-Length", "2")]), b"hi"))
    read = warc.derive(warc.read_responses(sp, str(tmp_path)))
    fields = ("warc_type", "record_id", "refers_to", "block_digest", "headers")
    assert collected(read, *fields) == sorted((tuple(r[c] for c in fields) for r in got), key=repr)


# --- chat ------------------------------------------------------------------------------

def test_chat(sp):
    rows = [
        (1, 1, "assistant", "hi <|endoftext|>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 5, "assistant", ""),
        (4, 1, "assistant", "\n\n  lead"), (4, 0, "system", "trail \n"), (4, 2, "assistant", "é" * 5000), (None, 0, "assistant", "n"),
        (5, 0, "assistant", "tie b"), (5, 0, "assistant", "tie a"),
    ]
    frame = sp.createDataFrame([(*r, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(frame, BYTES)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        g = got[c]
        assert (g["n_turns"], g["loss_chars"]) == (len(turns), len(loss))
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert g["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    for r in chat.format_chats(frame, BYTES).collect():  # no token crosses the edge of a turn
        assert r["token_ends"][-1] == len(r["formatted"].encode()) and len(r["loss_mask"]) == len(r["input_ids"])
    assert chat.digest_chats(chat.format_chats(frame.limit(0), BYTES)).count() == 0


# --- URL rules -------------------------------------------------------------------------

def test_url_rules(sp):
    rules = [url_rules.site_rule("net", "/", "block"), url_rules.site_rule("example.net", "/en/", "allow"),
             url_rules.Rule(None, "block", ("*bad*", "*bad*/**"))]
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net", "http://notexample.net/en/", "x://net/",
            "http://evil.com/x.example.net/en/", "http://u@h.net:80/a", "http://bad.org", "http://BAD.example.net/en/", "a://b://c.net/",
            "http://é.net/é", "http://example.net/EN/", "http://h.net?x/", "http://" + "a" * 50_000 + ".net/"]
    frame = sp.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, None, "h", "p")], "page_id bigint, url string, host string, rule string")

    def plain(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw):], re.S)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
        fit = [(h + p, a) for h, p, a in (("net", "/", "block"), ("example.net", "/en/", "allow"))
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "block" if "bad" in host else "allow")
        return host, path, rule, verdict

    want = [(i, *plain(u)) for i, u in enumerate(urls)] + [(0, *plain(None))]
    got = url_rules.judge_urls(frame, rules)
    assert collected(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert url_rules.judge_urls(frame.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(frame, []).collect()} == {"allow"}


# --- n-gram Jaccard join ---------------------------------------------------------------

def plain_components(rows, t=0.75):
    sets = []
    for _, text, *_ in rows:
        ws = [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append(frozenset(tuple(ws[i: i + 5]) for i in range(max(len(ws) - 4, 1))) if ws else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and both >= t * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    return sorted(out, key=repr)


def test_jaccard_join_on_odd_documents(sp):
    rows = odd_documents()
    got = jaccard_join.near_duplicates(docs_of(sp, rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == plain_components(rows)
    assert jaccard_join.near_duplicates(docs_of(sp, [])).count() == 0
    assert collected(jaccard_join.near_duplicates(docs_of(sp, rows[:3])), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3)]


def chained_documents():
    """Chains of small edits, groups around a shared passage, and copies: components whose members
    are far apart, and many sets just below and above the threshold."""
    rng = random.Random(11)
    rows, i = [], 0
    passage = words(rng, 55, 10_000)
    for _ in range(6):
        ws = words(rng, 70, 10_000)
        for _ in range(9):
            ws = list(ws)
            for _ in range(rng.randrange(3)):
                ws[rng.randrange(70)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((i, " ".join(ws), "en", "s"))
            i += 1
    for _ in range(40):
        rows.append((i, " ".join(passage + words(rng, rng.randrange(2, 60), 10_000)), "en", "s"))
        i += 1
    rows += [(i + k, rows[k * 3][1], "en", "s") for k in range(8)]
    return rows


@pytest.mark.parametrize("block, limit", [(512, 50_000), (3, 4)])
def test_jaccard_join_is_exact(sp, monkeypatch, block, limit):
    """Also with tiny blocks and lists dealt in parts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LIST_LIMIT", limit)
    rows = chained_documents()
    got = jaccard_join.near_duplicates(docs_of(sp, rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_jaccard_join_other_steps_find_the_same(sp, monkeypatch):
    """Without leaders all pairs come from the second step."""
    monkeypatch.setattr(jaccard_join, "first_leaders", lambda lists, top, bottom: lists.filter("false").selectExpr("node AS a", "node AS b"))
    rows = chained_documents()
    got = jaccard_join.near_duplicates(docs_of(sp, rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_one_of_each(sp):
    rows = odd_documents()
    left = jaccard_join.one_of_each(docs_of(sp, rows))
    assert left.columns == docs_of(sp, []).columns
    ids = Counter(r["doc_id"] for r in left.collect())
    want = {i for i, _, c in plain_components(rows) if i == c}
    assert set(ids) == want and all(n == 1 for i, n in ids.items() if i is not None)


# --- quality rules ---------------------------------------------------------------------

def plain_quality(rows, min_docs, percent):
    """Words in lines that stand in too many distinct texts of a host, of its distinct texts."""
    lines_of, seen, hosts = [], defaultdict(set), defaultdict(set)
    for _, text, _, host in rows:
        hosts[host].add(text)
        n = Counter()
        for line in (text or "").split("\n"):
            if line.split():
                n[" ".join(line.split()).lower()] += len(line.split())
        lines_of.append(n)
        for k in n:
            seen[host, k].add(text)
    out = []
    for (doc, text, _, host), n in zip(rows, lines_of):
        total = sum(n.values())
        gone = sum(w for k, w in n.items() if len(seen[host, k]) > min_docs and len(seen[host, k]) * 100 > len(hosts[host]) * percent)
        out.append((doc, total, gone))
    return sorted(out, key=repr)


def boilerplate_documents():
    rng = random.Random(3)
    rows = []
    for i in range(1000, 1040):
        lines = [" ".join(words(rng, 9, 5000)) for _ in range(4)]
        if i % 2:
            lines += ["Read more  here about Cookies", "read MORE here about cookies"]
        if i in (1001, 1003):
            lines = lines[:1] + ["Read more here about cookies"] * 30
        rows.append((i, "\n".join(lines), "en", "h" if i < 1036 else None))
    copied = "\n".join(" ".join(words(rng, 12, 5000)) for _ in range(3))
    return rows + [(2000 + i, copied, "en", "h") for i in range(60)]


def test_quality_rules(sp):
    rows = boilerplate_documents() + odd_documents()
    got = quality_rules.judge(docs_of(sp, rows), max_docs=5, max_percent=1)
    assert collected(got, "doc", "n_words", "removed_words") == plain_quality(rows, 5, 1)
    by = {r["doc"]: r for r in got.collect()}
    assert by[1000]["kept"] and by[1005]["kept"] and by[1005]["removed_words"] == 10
    assert not by[1001]["kept"] and by[1001]["n_words"] > 20  # depleted
    assert all(by[2000 + i]["kept"] and not by[2000 + i]["removed_words"] for i in range(60))  # copies are one document
    assert not by[2]["kept"] and by[2]["base_failed"]
    assert quality_rules.judge(docs_of(sp, [])).count() == 0


def test_quality_rules_count_documents(sp):
    """Pages of one template, whose lines all have the same few other lines beside them."""
    rng = random.Random(5)
    template = [" ".join(words(rng, 4, 5000)) for _ in range(12)]
    rows = [(i, "\n".join([*template, " ".join(words(rng, 30, 5000))]), "en", "h") for i in range(50)]
    rows += [(100 + i, rows[i % 20][1], "en", "k") for i in range(60)]  # 20 distinct texts
    rows += [(200 + i, "copied text of few words", "en", "m") for i in range(4000)]
    rows += [(5000 + i, "\n".join([template[0], " ".join(words(rng, 30, 5000))]), "en", "m") for i in range(25)]
    by = {r["doc"]: r for r in quality_rules.judge(docs_of(sp, rows)).collect()}
    assert all(by[i]["removed_words"] == 48 and len(by[i]["removed_lines"]) == 12 and by[i]["kept"] for i in range(50))
    assert all(by[100 + i]["removed_words"] == 0 for i in range(60))
    assert all(by[5000 + i]["removed_words"] == 4 for i in range(25))  # 25 of the host's 26 texts


def test_quality_rules_clean_texts(sp):
    rows = boilerplate_documents() + odd_documents()
    docs = docs_of(sp, rows)
    verdicts = quality_rules.judge(docs, max_docs=5, max_percent=1)
    left = quality_rules.clean(docs, n_chars="n_chars", max_docs=5, max_percent=1)
    assert left.columns == docs.columns and left.count() == verdicts.filter("kept").count()
    texts = {r["doc_id"]: r for r in left.collect()}
    assert "ookies" not in texts[1005]["text"] and len(texts[1005]["text"]) == texts[1005]["n_chars"]
    assert texts[1000]["text"] == rows[0][1]
    assert quality_rules.clean(docs_of(sp, [])).count() == 0


# --- quality classifier ----------------------------------------------------------------

def test_quality_classifier(sp):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 40)) if i % 3 else " ".join(w + "###" for w in words(rng, 40)), None, None) for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", None, None), (1001, "", None, None), (None, "x", None, None)]
    docs = docs_of(sp, rows)
    labels = sp.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 0, 0), (7, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id bigint, quality int, text int")
    known = nb_svm.known_labels(labels)
    model = nb_svm.fit(docs, known, sample=80)
    got = nb_svm.score(docs, model, keep=("doc_id", "node"))
    assert got.count() == len(rows) and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert all((scores[i] > 0.5) == (i % 3 > 0) for i in held)
    assert set(held).isdisjoint(r["doc_id"] for r in known.collect())
    again = nb_svm.fit(docs.repartition(7), known, sample=80)
    assert np.allclose(model, again)
    assert nb_svm.score(docs.limit(0), model).count() == 0
    one = nb_svm.fit(docs, known.filter("label = 1"))
    assert {round(r["score"], 3) for r in nb_svm.score(docs, one).collect()} == {round(float(1 / (1 + np.exp(-one[(1 << nb_svm.BITS) + 2]))), 3)}
    none = nb_svm.fit(docs, known.limit(0))
    assert {r["score"] for r in nb_svm.score(docs, none).collect()} == {0.5}


# --- language ID -----------------------------------------------------------------------

def test_language_id(sp):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "er", "ung", "ö"], "cc": ["ция", "не", "ста", "во"]}
    rows = []
    for i in range(150):
        lang = sorted(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(20)).title() + " 12!", lang, None))
    rows += [(500, None, None, None), (501, "12 ..!", "aa", None), (502, "", None, None), (503, "katomi", None, None),
             (503, "katomi", None, None), (504, "ö", None, None), (505, "katoru " * 20_000, "aa", None), (506, "日本語の文です", None, None)]
    docs = docs_of(sp, rows)
    model = language_id.train(docs.filter("doc_id % 5 <> 1 OR doc_id > 400"))
    got = collected(language_id.identify(docs, model), "doc_id", "lang_pred")
    want = [(i, lang) for i, _, lang, _ in rows[:150]] + [(500, "und"), (501, "und"), (502, "und"), (503, "aa"), (503, "aa"), (504, "bb"), (505, "aa")]
    assert [g for g in got if g[0] != 506] == sorted(want, key=repr)
    scored = language_id.identify(docs, model)
    assert scored.filter("score < 0 OR score > 1").count() == 0
    assert scored.filter("doc_id = 506").first()["rejected"]
    assert language_id.identify(docs, language_id.train(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_language_models_in_turns_give_the_same(sp, monkeypatch):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("anna banana", "x"), ("otto motto", "y"), ("zisch zosch", "z")] * 4)]
    docs = docs_of(sp, rows)
    one = collected(language_id.identify(docs, language_id.train(docs)), "doc_id", "lang_pred", "score", "cross_entropy")
    monkeypatch.setattr(language_id, "MODEL_ROWS", 1)
    assert collected(language_id.identify(docs, language_id.train(docs)), "doc_id", "lang_pred", "score", "cross_entropy") == one


def close(got, want):
    return all(a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-6) for a, b in zip(got, want, strict=True))


def test_language_models_as_a_table_give_the_same(sp, monkeypatch):
    """Odd and long texts in many slices, priced by joins; nothing is collected."""
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices(s, k=4)) for _ in range(rng.randrange(1, 60))), lang, None)
            for i in range(60) for lang, s in [(("x", "abcde"), ("y", "defgh"), ("z", "ийкл"))[i % 3]]]
    rows += [(100, None, "x", None), (101, "", "y", None), (102, "12 ..", None, None), (103, "日本", None, None),
             (104, "abc def " * 30_000, None, None), (105, "abab", "x", None), (105, "abab", "x", None)]
    docs = docs_of(sp, rows)
    columns = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
    model = language_id.train(docs)
    one = collected(language_id.identify(docs, model).fillna(-1.0, ["cross_entropy"]), *columns)
    assert model.limits
    monkeypatch.setattr(language_id, "MODEL_ROWS", 0)
    monkeypatch.setattr(language_id, "SLICE_TEXT", 5_000)
    monkeypatch.setattr(language_id.Model, "arrays", None)
    table = language_id.train(docs)
    assert close(collected(language_id.identify(docs, table).fillna(-1.0, ["cross_entropy"]), *columns), one)
    assert table.limits.keys() == model.limits.keys()
    assert np.allclose([table.limits[n] for n in sorted(table.limits)], [model.limits[n] for n in sorted(model.limits)])
    assert language_id.identify(docs.limit(0), table).count() == 0


def plain_kneser_ney(texts):
    """Log-probability of the last of four symbols under texts of symbols that begin with three spaces."""
    counts = {4: Counter(t[i - 3: i + 1] for t in texts for i in range(3, len(t)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    @cache
    def p(gram):
        k = len(gram)
        if not k:
            return 1 / len(counts[1])
        own = counts[k]
        n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = {g: v for g, v in own.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(own[gram] - d, 0) / total + d * len(same) / total * p(gram[1:])

    return lambda gram: max(math.log(max(p(gram), 1e-30)), math.log(1e-7))


def plain_symbols(text):
    """Letters lower-cased, all else a space; spaces before the first symbol, one of them counted."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return "    " + "".join(w + " " for w in letters) if letters else "   "


def plain_entropies(texts, model):
    return [-sum(model(t[i - 3: i + 1]) for i in range(3, len(t))) / max(len(t) - 3, 1) for t in texts]


def test_kneser_ney_like_plain_code(sp):
    """Every order beside a direct computation on symbols."""
    texts = ["abab ac", "ba"]
    model = language_id.train(docs_of(sp, [(i, t, "x", None) for i, t in enumerate(texts)]))
    symbols = [plain_symbols(t) for t in texts]
    got, _ = language_id.Scorer(model.arrays()).entropies(texts)
    assert np.allclose(got[:, 0], plain_entropies(symbols, plain_kneser_ney(symbols)), atol=1e-5)


def test_language_models_need_few_shuffles(sp, monkeypatch):
    """Both models come from one table of counts: many shuffles of small tables cost disk and tasks by partitions squared."""
    plans, cut = [], language_id.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(language_id, "materialize", seen)
    model = language_id.train(docs_of(sp, [(i, t, "x", None) for i, t in enumerate(["abab ac", "ba", "cab", "abc", "bca acb"])]))
    plans.append(model.table._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 8


def test_language_id_like_plain_code(sp):
    """Predictions, cross-entropies and limits of whole documents beside brute force."""
    rng = random.Random(12)
    rows = []
    for i in range(48):
        lang, s = (("x", "abcde"), ("y", "cdefg"), ("z", "efgöé"))[i % 3]
        rows.append((i, " ".join("".join(rng.choices(s, k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))) + ". 7!", lang, None))
    rows += [(90, None, "x", None), (91, "abé", None, None), (92, "qqq Qq", None, None)]
    docs = docs_of(sp, rows)
    model = language_id.train(docs, tolerance=2.0)
    out = {r["doc_id"] for r in docs.filter(language_id.held_fold("text")).collect()}
    langs = ["x", "y", "z"]
    plain = {n: plain_kneser_ney([plain_symbols(t) for _, t, lang, _ in rows if lang == n]) for n in langs}
    limits = {}
    for n in langs:
        seen = plain_kneser_ney([plain_symbols(t) for i, t, lang, _ in rows if lang == n and i not in out])
        unseen = plain_entropies([plain_symbols(t) for i, t, lang, _ in rows if lang == n and i in out], seen)
        if len(unseen) > 1:
            limits[n] = np.mean(unseen) + 2 * np.std(unseen)
    assert limits and limits.keys() == model.limits.keys()
    assert all(math.isclose(limits[n], model.limits[n], abs_tol=1e-5) for n in limits)
    rejected = 0
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for i, text, *_ in rows:
        t, r = plain_symbols(text), got[i]
        if not t.strip():
            assert r["lang_pred"] == "und" and r["score"] == 0 and not r["rejected"]
            continue
        h = {n: plain_entropies([t], plain[n])[0] for n in langs}
        best = min(langs, key=h.get)
        assert r["lang_pred"] == best and math.isclose(r["cross_entropy"], h[best], abs_tol=1e-5)
        odds = sum(math.exp((h[best] - h[n]) * min(len(t) - 3, 50)) for n in langs)
        assert math.isclose(r["score"], 1 / odds, abs_tol=1e-4)
        assert r["rejected"] == (h[best] > limits.get(best, math.inf))
        rejected += r["rejected"]
    assert 0 < rejected < 40


# --- packing ---------------------------------------------------------------------------

def test_packing(sp):
    import zlib

    from tokenizers import Tokenizer

    rows = odd_documents()
    lib = Tokenizer.from_file(BPE)
    got = best_fit.pack(docs_of(sp, rows), BPE, capacity=256, with_ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at: at + 256]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 256) + 5
    assert best_fit.pack(docs_of(sp, []), BPE).count() == 0


# --- decontamination -------------------------------------------------------------------

def plain_hits(rows, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for i, t in items:
        ws = split(t)
        for s in range(len(ws) - min(len(ws), size) + 1):
            if ws:
                windows[tuple(ws[s: s + size])].add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for doc, t, *_ in rows:
        ws, hit, found = split(t), set(), set()
        for k in lengths:
            for s in range(len(ws) - k + 1):
                if (w := tuple(ws[s: s + k])) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[w]
        out.append((doc, len(ws), len(hit), sorted(found)))
    return sorted(out, key=repr)


def contaminated_documents():
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, n, 300)).title()) for i, n in enumerate([30, 12, 10, 14, 25])] + [(5, None), (6, " ,"), (7, "É tu")]
    rows = odd_documents()
    for i in range(40):
        ws = words(rng, 50, 300)
        source = items[i % 5][1].split()
        n = rng.choice([9, 10, 11, len(source)])
        at = rng.randrange(0, 51)
        rows.append((200 + i, ", ".join(ws[:at] + source[:n] + ws[at:]) + rng.choice(["", ".", " é TU", " É, tu!"]), "en", "s"))
    return rows, items


@pytest.mark.parametrize("short", [[], [(8, "w1 w2"), (9, "w3")]])
def test_decontamination(sp, short):
    rows, items = contaminated_documents()
    items = items[:7] + short if short else items
    docs = docs_of(sp, rows)
    bench = sp.createDataFrame([(*i, "k") for i in items], "item_id bigint, text string, key string")
    found = decontaminate.contamination(docs, bench)
    assert collected(found, "doc_id", "n_words", "n_hit", "items") == plain_hits(rows, items)
    left = decontaminate.without_documents(docs, found)
    clean = Counter(r[0] for r in plain_hits(rows, items) if not r[2])
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == clean


def test_decontamination_cuts_spans(sp):
    rows, items = contaminated_documents()
    docs = docs_of(sp, [r for r in rows if r[0] is not None])
    bench = sp.createDataFrame(items, "item_id bigint, text string")
    cut = decontaminate.without_spans(docs, decontaminate.contamination(docs, bench))
    assert cut.columns == docs.columns and cut.count() == docs.count()
    hit = {r[0]: r for r in plain_hits(rows, items)}
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for doc, t, *_ in rows:
        if doc is not None and not hit[doc][2]:
            assert texts[doc] == t
    left = {d: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for d, t in texts.items()}
    assert all(left[d] == hit[d][1] - hit[d][2] for d in left)


def test_decontamination_with_nothing(sp):
    rows, items = contaminated_documents()
    empty = sp.createDataFrame([], "item_id bigint, text string")
    found = decontaminate.contamination(docs_of(sp, rows), empty)
    assert found.filter("n_hit > 0").count() == 0 and found.count() == len(rows)
    bench = sp.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.contamination(docs_of(sp, []), bench).count() == 0


def test_decontamination_runs_no_python(sp):
    rows, items = contaminated_documents()
    found = decontaminate.contamination(docs_of(sp, rows), sp.createDataFrame(items, "item_id bigint, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
    assert F is not None
