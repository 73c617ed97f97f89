"""Line dedup, conversation repair and periodic runs against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from chronotext.llm import chat_repair, line_dedup, periodic_runs, queries
from chronotext.llm.common import find_package

SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def sp(spark):
    find_package(spark)
    return spark


def docs_of(sp, rows):
    """Documents with further columns whose names clash with inner ones."""
    return sp.createDataFrame(
        [(i, t, 1, "x", 2, 3, 4, 5) for i, t in rows],
        "doc_id bigint, text string, d int, v string, h1 int, gone int, runs int, n_words int")


# --- line dedup ------------------------------------------------------------------------


def plain_dedup(rows, min_chars=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(SPACES))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            who = holders.get(key(line), set())
            named = [x for x in who if x is not None]
            first = min(named) if named else None
            if len(who) < 2 or i == first:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def dedup_rows():
    rng = random.Random(5)
    pool = [f"Line number {k} of the pool" for k in range(30)] + ["short", "", "  ", "ÉCOLE de la ville", "école de la ville", "0123456789", "012345678"]
    rows = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else f"\t{rng.choice(pool)} \r" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(7, rows[7][1]), (8, "another row of id 8\nLine number 3 of the pool"), (None, "Line number 1 of the pool\nonly with the null id"),
             (None, "only with the null id"), (90, None), (91, ""), (92, "\n\n"), (93, "the same line twice here\nthe same line twice here")]
    rows += [(100, "\n".join(f"long document line {k % 5000}" for k in range(20_000))), (101, "long document line 4999\nlong document line 77")]
    return rows + [(200 + i, "a line that a third of all documents have\nown " + "x" * i) for i in range(40)]


@pytest.mark.parametrize("batches,fan", [(1, 3), (4, 3), (7, 2)])
def test_line_dedup(sp, batches, fan):
    rows = dedup_rows()
    got = line_dedup.dedup_lines(docs_of(sp, rows), batches=batches, fan=fan)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup(rows)


def test_line_dedup_edges(sp):
    assert line_dedup.dedup_lines(docs_of(sp, [])).count() == 0
    assert [tuple(r) for r in line_dedup.dedup_lines(docs_of(sp, [(None, None)])).collect()] == [(None, 1, 0, "")]
    named = sp.createDataFrame([("b", "a line of some length"), ("a", "A LINE of some length\nx")], "id string, body string")
    got = line_dedup.dedup_lines(named, "id", "body")
    assert sorted(map(tuple, got.collect())) == [("a", 2, 0, "A LINE of some length\nx"), ("b", 1, 1, "")]


def test_line_dedup_heavy_hashes(sp, monkeypatch):
    """Hashes with more lines than the bar go through the broadcast, with equal results."""
    rows = [(i, f"common line of them all\nown line number {i}\ncommon line of them all") for i in range(1200)]
    got = line_dedup.dedup_lines(docs_of(sp, rows), batches=2)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup(rows)


def test_line_runs(sp):
    """Runs hold every hash once; levels stay below the fan; no Python in the plan."""
    runs = line_dedup.LineRuns(sp, fan=2, buckets=4)
    seen = set()
    for b in range(5):
        batch = [(b * 100 + k, k % 7 + b, 0) for k in range(20)]
        runs.add(b, sp.createDataFrame(batch, "d bigint, h1 bigint, h2 bigint"))
        seen |= {h for _, h, _ in batch}
        assert all(len(level) < 2 for level in runs.levels)
        held = [r["h1"] for level in runs.levels for t in level for r in runs._hashes(t).collect()]
        assert sorted(held) == sorted(seen)
    runs.close()
    plan = line_dedup.dedup_lines(docs_of(sp, dedup_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- conversation repair -----------------------------------------------------------------


def plain_repair(rows, costs):
    """Cheapest edits by best-first search over whole scripts, without merging."""
    rerole, delete, insert, truncated = costs
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, out
        nexts = []
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + delete, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                extra = truncated if fault else 0
                nexts.append((extra, "K", role[:1], i + 1, (role, text)))
                nexts += [(extra + rerole, "R", r[0], i + 1, (r, text)) for r in ("user", "assistant") if r[0] != role[:1]]
        if audit.count("I") < 3:
            nexts += [(insert, "I", r[0], i, (r, "")) for r in ("user", "assistant")]
        for more, letter, initial, at, turn in nexts:
            if initial and re.fullmatch("s?(ua)*u?", roles + initial):
                heapq.heappush(heap, (cost + more, audit + letter, at, roles + initial, (*out, turn)))
    return best


def plain_report(rows, costs):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, audit, out = plain_repair(judged, costs)
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
    tell = [sum(f == k for *_, f in judged) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(not (a[0] and b[0] and p in ("su", "ua", "au")) for p, a, b in zip(pairs, judged, judged[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *tell, illegal, cost, audit, sha)


def some_conversations():
    rng = random.Random(9)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    texts = ["hi.", "yes!", "what", "  ", "", None, "no?\n", "étè.", "a longer answer."]
    rows = [(c, rng.choice([0, 1, 2, 3, 5, None]), rng.choice(roles), rng.choice(texts)) for c in range(120) for _ in range(rng.randint(1, 6))]
    return rows + [(None, 0, "user", "q."), (None, 1, "assistant", "a."), (500, None, "user", "q."), (501, 3, "user", "q."), (501, 3, "user", "q.")]


@pytest.mark.parametrize("costs", [(1, 2, 5, 5), (3, 1, 1, 0), (2, 4, 3, 1)])
def test_repair(sp, costs):
    rows = some_conversations()
    frame = sp.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, step int, edit string")
    got = chat_repair.report(chat_repair.repair(frame, chat_repair.Costs(*costs)))
    by = defaultdict(list)
    for c, *row in rows:
        by[c].append(tuple(row))
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == {c: plain_report(own, costs) for c, own in by.items()}
    assert chat_repair.report(chat_repair.repair(frame.limit(0))).count() == 0


def test_repair_edits(sp):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "u."), (1, 2, "user", " "), (1, 3, "assistant", "cut")]
    frame = sp.createDataFrame(rows, "c bigint, t int, r string, x string")
    got = chat_repair.repair(frame, None, "c", "t", "r", "x").orderBy("step").collect()
    assert [(r["edit"], r["turn"], r["was"], r["fault"], r["role"], r["text"], r["cost"]) for r in got] == [
        ("R", 0, "assistant", None, "user", "a.", 1), ("R", 1, "user", None, "assistant", "u.", 1),
        ("D", 2, "user", "blank", None, None, 2), ("D", 3, "assistant", "truncated", None, None, 2)]


def test_repair_streams_long_conversations():
    """A frontier that keeps agreeing holds few rows; one that never agrees loses none."""
    rng = random.Random(3)
    state, out = chat_repair.Repair((1, 2, 5, 5)), []
    held = 0
    for k in range(30_000):
        out += state.row(rng.choice("uas"), rng.choice([None, None, "truncated", "blank"]), k)
        held = max(held, len(state.rows))
    out += state.close()
    assert held < 2000 and [row for *_, row in out if row is not None] == list(range(30_000))
    assert re.fullmatch("(s?(ua)+)?", "".join(g for _, g, _ in out))


def test_damage(sp):
    rows = [(c, t, "assistant", f"Text {t}. Ends!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    frame = sp.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, role, text in rows:
        role, text = (v if v is not None else " " for v in (role, text))
        kind = zlib.crc32(f"{c if c is not None else ' '}:{t if t is not None else ' '}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, chat_repair.damage(frame).collect()), key=repr) == sorted(want, key=repr)


# --- periodic runs -----------------------------------------------------------------------


def plain_runs(words, min_length=24, min_exponent=3):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_texts():
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            base = [rng.choice("ab" if rng.random() < 0.4 else "abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 15))]
            words += (base * rng.randint(1, 9))[: rng.randint(1, 90)]
        texts.append(words)
    return texts


@pytest.mark.parametrize("limits", [(24, 3), (6, 2), (1, 2), (10, 4)])
def test_find_runs(limits):
    for words in some_texts():
        ids = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
        assert periodic_runs.find_runs(ids, *limits) == plain_runs(words, *limits)


def test_periodic_runs(sp):
    rng = random.Random(12)
    texts = [(i, rng.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(some_texts())]
    texts += [(900, None), (901, ""), (902, " \n "), (903, "é è " * 40), (903, "é è " * 40), (None, "x " * 24), (904, "x " * 23),
              (905, "one two three " * 40_000), (906, "w" * 200_000)]
    got = periodic_runs.periodic_runs(docs_of(sp, texts), keep=("doc_id", "runs"))
    want = []
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, 120_000, 3)] if i == 905 else plain_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    found = [(r[0], r[2], [tuple(x) for x in r[3]], r[4]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert got.columns == ["doc_id", "runs", "n_words", "runs", "collapsed"]
    assert periodic_runs.periodic_runs(docs_of(sp, [])).count() == 0


def test_planted_periods(sp):
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (17, None)]
    got = queries.planted_periods(docs_of(sp, docs))
    want = []
    for i, text in docs:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
        want.append((i, text))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
