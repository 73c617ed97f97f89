"""The helpers without Spark, beside the libraries or plain code they must agree with."""

import fnmatch
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from chronotext.llm import best_fit, chat, common, jaccard_join, language_id, nb_svm, quality_rules, token_counts, url_rules, warc

ODD = ["a", "b", " ", "  ", "\n", "</s>", "[INST]", "é", "漢", "字", "🎉", "\t", "ing", "the", "1", "▁", "<0x0A>", "\0", "ﬁ", "aaaa", "\r", "\\", "<|"]


def odd_texts(n, seed, most=40):
    rng = random.Random(seed)
    return ["", " ", "\n", *("".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n))]


def test_prefix_counts_equal_the_library_at_every_prefix():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    for text in [*odd_texts(300, 1), "ab" * 300 + "x" * 200, "no spaces " * 3 + "漢字" * 100]:
        counts = counter.counts(text)
        assert counts.tolist() == [len(sp.encode(text[:k])) for k in range(len(text) + 1)]
        assert len(sp.encode(text[: token_counts.fits(counts, 5)])) <= 5


def test_prefix_counts_survive_forgetting(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = token_counts.PrefixCounter(path)
    texts = odd_texts(60, 2)
    wanted = [whole.counts(t).tolist() for t in texts]
    monkeypatch.setattr(token_counts, "MEMO", 10)
    monkeypatch.setattr(token_counts, "PAIRS", 20)
    small = token_counts.PrefixCounter(path)
    assert [small.counts(t).tolist() for t in texts] == wanted


def coded(ids, texts):
    """The ids of each text as bytes."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    flat, at = ids.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, ids = Tokenizer.from_file(path), best_fit.WordIds(path)
    texts = [*odd_texts(300, 3), "Well, it's THE end... <|endoftext|> <|ENDOFTEXT|>, done. İI é É 12.5, ok.,", "ΣΑΣ. Å Å"]
    wanted = [np.array(e.ids, dtype="<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert coded(ids, texts) == wanted and coded(ids, texts[::-1]) == wanted[::-1]


def test_word_ids_of_letters_that_become_letter_and_mark():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, ids = Tokenizer.from_file(path), best_fit.WordIds(path)
    letters = [chr(i) for i in range(0x80, 0x30000) if chr(i).isalpha()]
    texts = ["BELEDİYESİ. BELEDİYESİ, BELEDİYESİ İ. \u0958. क़, \ufb2a.", *(f"ab{c}. {c}, {c}{c}." for c in letters)]
    wanted = [np.array(e.ids, dtype="<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert coded(ids, texts) == wanted and coded(ids, texts[::-1]) == wanted[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([64, rng.randint(1, 64), rng.randint(1, 20)]) for _ in range(400))
    plan = best_fit.plan_packing(dict(counts), 64)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 64
        for a in pattern:
            used[a] += times
    assert used == counts
    total = sum(a * n for a, n in counts.items())
    assert sum(t for _, t in plan) <= -(-total // 64) + 1


def test_packing_finds_pairs_and_triples():
    assert sum(t for _, t in best_fit.plan_packing({50: 2, 30: 2, 20: 2, 40: 1, 35: 1, 25: 1}, 100)) == 3
    assert best_fit.plan_packing({}, 100) == []


def test_chat_escapes_are_undone():
    for text in odd_texts(400, 4):
        broken = chat.escape(text)
        assert not any(c in broken for c in chat.CONTROL)
        assert chat.unescape(broken) == text


def test_chat_mask_covers_the_assistant_texts():
    turns = [("user", "a <|endoftext|> b"), ("assistant", ""), ("assistant", " x\n"), ("tool", "\n"), ("assistant", "</s>\\é")]
    text, spans = chat.render(turns, "assistant")
    assert chat.read_back(text) == turns
    data = text.encode()
    assert "".join(chat.unescape(data[a:b].decode()) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    ends = np.arange(1, len(data) + 1)  # a token for each byte
    mask = chat.loss_mask(ends, spans)
    assert mask.sum() == sum(b - a for a, b in spans)
    assert chat.masked_text(text, ends, mask) == " x\n</s>\\é"
    # A token that meets a span by one byte is masked.
    assert chat.loss_mask(np.array([3, 6, 9]), [(2, 4)]).tolist() == [True, True, False]


def test_globs_match_like_plain_code():
    globs = ["net/**", "*.net/**", "a*b/x", "**", "é*", "", "a.net/en/**", "*a*a*", "a?b"]
    rng = random.Random(5)
    texts = ["", "net/", "x.net/", "x.net", "a.net/en/", "a/b/x", "é", "a?b", "axb", *(
        "".join(rng.choice("ab./netéx?") for _ in range(rng.randint(0, 14))) for _ in range(400))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    auto = url_rules.compile_globs(globs)
    state = url_rules.run(auto, *common.table(batch, "t"))
    for k, glob in enumerate(globs):
        import re

        plain = re.compile("".join(
            ".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)), re.S)
        word, bit = auto.last[k]
        got = [bool((s[word] >> np.uint64(bit)) & np.uint64(1)) for s in state]
        assert got == [bool(plain.fullmatch(t)) for t in texts], glob
    assert fnmatch.fnmatch("a", "a")


def test_many_globs_cross_word_borders():
    globs = ["x" * n + "**" for n in range(1, 60)]
    auto = url_rules.compile_globs(globs)
    assert len(auto.start) > 20
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 30 + "y", "y"])], names=["t"])
    state = url_rules.run(auto, *common.table(batch, "t"))
    hits = [[bool((s[w] >> np.uint64(b)) & np.uint64(1)) for w, b in auto.last] for s in state]
    assert hits[0] == [n <= 30 for n in range(1, 60)] and not any(hits[1])


def test_word_hashes_and_windows():
    texts = ["a b  a b", "", None, "b\ta", "aa", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    data, offsets = common.table(batch.slice(0), "t")
    starts, ends, rows = common.word_spans(data, offsets, common.ascii_space())
    assert np.diff(rows).tolist() == [4, 0, 0, 2, 1, 0]
    hashes = common.span_hashes(data, starts, ends)
    assert hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 3
    windows, where = common.window_hashes(hashes, rows, 2)
    assert np.diff(where).tolist() == [3, 0, 0, 1, 0, 0]
    assert windows[0] == windows[2] and windows[1] == windows[3] and windows[0] != windows[1]


def test_words_end_with_their_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "ab", "c", "d e"])], names=["t"])
    data, offsets = common.table(batch.slice(1), "t")
    data, offsets = data[offsets[0]: offsets[-1]], offsets - offsets[0]
    starts, ends, rows = common.word_spans(data, offsets, common.ascii_space())
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", b"e"]
    assert rows.tolist() == [0, 1, 2, 4]


def test_base_counts_like_plain_code():
    texts = [t * 3 for t in odd_texts(60, 6)] + ["w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 2, "a\na\n\n b\n b\na #|"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = quality_rules.base_counts(*common.table(batch, "t"))
    for i, t in enumerate(texts):
        ws = t.encode().split()
        wins = Counter(tuple(ws[k: k + 8]) for k in range(len(ws) - 7))
        hit = {p for k in range(len(ws) - 7) if wins[tuple(ws[k: k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[c][i]) for c in quality_rules.BASE) == want, repr(t)


def test_prefixes_find_every_similar_pair():
    """Sets above the threshold share as many prefix shingles as the smaller l asks for."""
    rng = np.random.default_rng(7)
    levels = rng.integers(0, 60, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
    checked = 0
    for _ in range(400):
        n = int(rng.integers(1, 60))
        base = common.mix(rng.integers(0, 1 << 60, n).astype(np.uint64))
        x = np.unique(base)
        y = np.unique(np.concatenate([base[: n - int(rng.integers(0, n // 5 + 1))], common.mix(rng.integers(0, 1 << 60, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))]))
        both = len(np.intersect1d(x, y))
        if 4 * both < 3 * (len(x) + len(y) - both):
            continue
        checked += 1
        (p, _, lx), (q, _, ly) = (jaccard_join.ordered_prefix(s, levels, 4.0, 3, 4) for s in (x, y))
        k = min(lx, ly)
        overlap = -(-3 * (len(x) + len(y)) // 7)
        for longest in (lambda m: jaccard_join.base_prefix(m, 3, 4) + k - 1, lambda m: m - overlap + k):
            assert len(np.intersect1d(p[: longest(len(x))], q[: longest(len(y))])) >= k
    assert checked > 100


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w = nb_svm.dual_coordinate_descent(rows, [np.ones(2)] * 4, np.array([1.0, 1.0, -1.0, -1.0]), 4, epochs=200)
    margins = [w[r].sum() + w[4] for r in rows]
    assert margins[0] > 0.9 and margins[3] < -0.9


def test_symbols_and_gram_contexts():
    split = language_id.Symbols()
    symbols, offsets = split(["Ab, c!", "", "123", "ß"])
    assert "".join(map(chr, symbols.tolist())) == " ab c  ß " or "".join(map(chr, symbols.tolist())) == " ab c ß"
    assert offsets.tolist()[1:3] == [offsets[1]] * 2
    grams, contexts = language_id.gram_hashes(symbols, offsets)
    for k in range(1, language_id.ORDER):  # a context is the gram that ends one place before
        assert contexts[k][1] == grams[k - 1][0]
    again, _ = language_id.gram_hashes(*split(["ab c"]))
    assert all((a[:5] == g[:5]).all() for a, g in zip(again, grams))


def test_gram_hashes_keep_millions_of_grams_apart():
    symbols = np.random.default_rng(4).integers(0x4E00, 0x9000, 2_000_000).astype(np.uint64)
    grams, contexts = language_id.gram_hashes(symbols, np.array([0, len(symbols)]))
    ends = np.zeros(len(symbols) - 3, dtype=np.uint64)
    for k in range(language_id.ORDER):  # exact: 15 bits a symbol
        ends |= (symbols[3 - k: len(symbols) - k] - np.uint64(0x4E00)) << np.uint64(15 * k)
        assert len(np.unique(grams[k][3:])) == len(np.unique(ends))
        if k < language_id.ORDER - 1:
            assert (contexts[k + 1][4:] == grams[k][3:-1]).all()


def test_warc_records_round_trip():
    page = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One<b>two</b></p><!-- no --><script>no()</script><a class=x href='/y?a=1&amp;b=2'>link</a><br>end"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page.encode()
    headers = warc.header_lines([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(block)))])
    data = warc.serialize(headers, block) * 2
    read = list(warc.parse(data))
    assert len(read) == 2 and read[0][2] == block and read[0][1] == headers
    meta, text = warc.derivatives("<urn:x>", "http://a/", "2024-01-01T00:00:00Z", headers, block)
    assert text[-1].decode() == "A & B\nOnetwo\nlink\nend"
    assert meta[0] == "metadata" and text[0] == "conversion" and meta[2] == text[2] == "<urn:x>" and meta[1] != text[1]
    import json

    told = json.loads(meta[-1])
    assert told["title"] == "A & B" and told["links"] == [{"path": "a", "url": "/y?a=1&b=2"}]
    assert told["payload-digest"] == warc.digest(page.encode()) == meta[6] == text[6]
    again = list(warc.parse(warc.serialize(meta[-2], meta[-1]) + warc.serialize(text[-2], text[-1])))
    assert [a[0]["warc-refers-to"] for a in again] == ["<urn:x>"] * 2
    assert [warc.digest(a[2]) for a in again] == [a[0]["warc-block-digest"] for a in again]
    assert warc.http_parts(b"no head")[2] == b"no head" and warc.plain_text("") == ""


def test_counts_of_grams_travel_as_symbols(spark):
    """Hashes are made from the summed symbols, and are those of the texts themselves."""
    from chronotext.llm import language_id as L

    texts = ["Ab ba 12 abba", "\U00010400x", "", None, "ab ba abba"]
    rows = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    made = L.count_grams(rows, "text", "lang")
    shuffled = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert len(shuffled) == 1 and "high" in shuffled[0] and "g1" not in shuffled[0]
    symbols, offsets = L.Symbols()([t or "" for t in texts])
    grams, contexts = L.gram_hashes(symbols, offsets)
    want = {}
    for row in zip(*(x.astype(np.int64).tolist() for x in (*grams, *contexts[1:]))):
        want[row] = want.get(row, 0) + 1
    assert {tuple(r[c] for c in L.GRAMS): r["n"] for r in made.collect()} == want
