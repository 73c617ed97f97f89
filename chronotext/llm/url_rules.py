"""URL filter: glob rules packed into bit masks, all simulated at once.

Each glob becomes a run of bits in one multiword state: a start bit and a bit for each
literal. A character moves every pattern one bit on where its mask allows the character,
and keeps a bit where a wildcard that follows it allows the character. The state of all
patterns is one row of 64-bit words for each URL, and a step is a few word operations.

Glob syntax: `*` any run without `/`, `**` any run, all else literal (UTF-8 bytes). A
glob must cover the whole canonical URL, which is the host (A-Z lower-cased) and the path.

Nulls and URLs without `://` have an empty host and path. Where globs of several rules
match, the longest rule name wins, then the first listed. Rows are judged one by one,
so repeated rows repeat; other columns are carried on only if named in `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import table

U64 = np.uint64


@dataclass(frozen=True)
class Rule:
    """`name` is reported; None for rules of the method itself."""

    name: str | None
    action: str
    globs: tuple[str, ...]


def site_rule(host: str, path: str, action: str) -> Rule:
    """A rule for a host with all its subdomains and the paths that begin with `path`."""
    return Rule(host + path, action, (f"{host}{path}**", f"*.{host}{path}**"))


@dataclass
class Automaton:
    """Masks of all globs: `step` and `stay` by byte, `start`, and each glob's last bit."""

    start: np.ndarray
    step: np.ndarray
    stay: np.ndarray
    carry: np.ndarray
    last: list[tuple[int, int]]


def compile_globs(globs: list[str]) -> Automaton:
    bits: list[tuple[int | None, str]] = []  # (literal or None for a start, wildcard that follows)
    last = []
    for glob in globs:
        bits.append((None, ""))
        i, raw = 0, glob.encode()
        while i < len(raw):
            if raw[i: i + 1] == b"*":
                kind = "**" if raw[i: i + 2] == b"**" else "*"
                bits[-1] = (bits[-1][0], max(bits[-1][1], kind, key=len))
                i += len(kind)
            else:
                bits.append((raw[i], ""))
                i += 1
        last.append(len(bits) - 1)
    words = max(1, (len(bits) + 63) // 64)
    auto = Automaton(np.zeros(words, U64), np.zeros((256, words), U64), np.zeros((256, words), U64),
                     np.zeros(words, U64), [(b // 64, b % 64) for b in last])
    for b, (literal, wildcard) in enumerate(bits):
        w, one = b // 64, U64(1) << U64(b % 64)
        if literal is None:
            auto.start[w] |= one
        else:
            auto.step[literal, w] |= one
        if wildcard:
            auto.stay[:, w] |= one
            if wildcard == "*":
                auto.stay[ord("/"), w] &= ~one
    return auto


def run(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the final state; texts are stepped together, longest first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, size = offsets[:-1][order], lengths[order]
    state = np.repeat(auto.start[None, :], len(order), axis=0)
    for at in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -at, side="left"))  # texts longer than `at`
        now = state[:n]
        c = data[begin[:n] + at]
        moved = now << U64(1)
        moved[:, 1:] |= now[:, :-1] >> U64(63)
        state[:n] = (moved & auto.step[c]) | (now & auto.stay[c])
    out = np.empty_like(state)
    out[order] = state
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end; then the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), "^[^?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",),
               default: str = "allow") -> DataFrame:
    """keep, host, path, rule (the deciding rule's name or null) and verdict of each URL."""
    host, path = host_and_path(F.col(url))
    own = [f"c{i}" for i in range(len(keep))]  # a kept column may have any name, that of a result too
    parts = pages.select(*(F.col(k).alias(c) for k, c in zip(keep, own)), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("canonical", F.concat("host", "path"))
    globs = [(g, r) for r in rules for g in r.globs]
    auto = compile_globs([g for g, _ in globs])
    # The worst first, so that a later match overwrites it; a named rule goes before the method's own.
    rank = sorted(range(len(globs)), key=lambda k: (len(globs[k][1].name or ""), -rules.index(globs[k][1])))

    def judge(batches):
        for batch in batches:
            data, offsets = table(batch, "canonical")
            state = run(auto, data, offsets)
            won = np.full(batch.num_rows, -1)
            for k in rank:
                word, bit = auto.last[k]
                won[(state[:, word] >> U64(bit)) & U64(1) == 1] = k
            named = [globs[k][1].name if k >= 0 else None for k in won]
            verdict = [globs[k][1].action if k >= 0 else default for k in won]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(named, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names[:-1], "rule", "verdict"],
            )

    schema = parts.drop("canonical").schema.add("rule", "string").add("verdict", "string")
    return parts.mapInArrow(judge, schema).toDF(*keep, "host", "path", "rule", "verdict")
