"""The registered queries opN_<name> over the whole given tables, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.common import find_package
from chronotext.llm import (
    best_fit, chat, chat_repair, decontaminate, jaccard_join, language_id, line_dedup, nb_svm, periodic_runs, quality_rules,
    token_counts, url_rules, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            find_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x20\x09-\x0D]+"


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- 1: token counts ------------------------------------------------------------------

TOKEN_LIMIT = 4096


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), TOKEN_LIMIT)


# --- 2: WARC derivatives --------------------------------------------------------------

CRAWLED = "2024-01-01T00:00:00Z"  # the pages table holds no dates


@query("op2_warc_derivatives")
def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.derive(warc.responses(pages, CRAWLED), keep=("page_id",))


# --- 3: chat formatting ---------------------------------------------------------------

PROBE = "</s>[INST] ok [/INST]"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BROKEN = "replace(text, '\\', '\\\\')"
for _c in chat.CONTROL:  # no control string is part of another but `<|`, `<s>` at their own start
    _BROKEN = f"replace({_BROKEN}, {_sql_text(_c)}, {_sql_text(_c[0] + chr(92) + _c[1:])})"


@query("op3_chat_formatting", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_sql_text(PROBE)} UNION ALL SELECT -1, 1, 'assistant', {_sql_text(PROBE)})
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(13 + sum(26 + length(role) + length({_BROKEN})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE)
    )
    chats = chat.format_chats(rows.union(probe), vocabulary("byte_bpe_50k.json"))
    return chat.digest_chats(chats).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


# --- 4: URL filters -------------------------------------------------------------------

URL_RULES = [
    url_rules.site_rule("net", "/", "block"), url_rules.site_rule("example.net", "/en/", "allow"),
    url_rules.site_rule("example.com", "/de/", "block"), url_rules.site_rule("org", "/fr/", "allow"),
    # The method's own: hosts of advertising mills.
    url_rules.Rule(None, "block", ("*cheap-pills*", "*cheap-pills*/**", "*casino*", "*casino*/**")),
]


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


@query("op4_url_filters", f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
s AS (SELECT *, CASE WHEN {_fits('example.net', '/en/')} THEN 'example.net/en/'
  WHEN {_fits('example.com', '/de/')} THEN 'example.com/de/'
  WHEN {_fits('org', '/fr/')} THEN 'org/fr/' WHEN {_fits('net', '/')} THEN 'net/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(host, 'cheap-pills') OR contains(host, 'casino') THEN 'block' ELSE 'allow' END AS verdict FROM s""")
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


# --- 5: n-gram Jaccard join -----------------------------------------------------------

@query("op5_ngram_jaccard_join", rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + least(len(ws), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir)).drop("version")


# --- 6: quality rules -----------------------------------------------------------------

@query("op6_quality_rules", rf"""
WITH d AS (
  SELECT row_number() OVER () AS nth, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
wins AS (
  SELECT nth, i, list_slice(ws, i, i + 7) AS g
  FROM (SELECT nth, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT nth, i FROM wins QUALIFY count(*) OVER (PARTITION BY nth, g) > 1),
rep AS (SELECT nth, count(DISTINCT p) AS n FROM (SELECT nth, i + unnest(range(0, 8)) AS p FROM twice) GROUP BY nth),
raw AS (SELECT nth, source, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (
  SELECT nth, source, line, regexp_extract_all(line, '{_WORD}') AS lw FROM raw WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT nth, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY nth),
keyed AS (
  SELECT nth, source, substr(md5(translate(array_to_string(lw, ' '), {_AZ})), 1, 16) AS k, sum(len(lw)) AS n
  FROM worded GROUP BY ALL),
freq AS (SELECT k.source, k, count(DISTINCT text) AS in_docs FROM keyed k JOIN d USING (nth) GROUP BY k.source, k),
hosts AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INTEGER) AS docs FROM documents GROUP BY source),
bad AS (
  SELECT f.source, f.k FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  WHERE in_docs > 20 AND in_docs * 100 > docs),
gone AS (
  SELECT nth, sum(n) AS n FROM keyed JOIN bad ON keyed.k = bad.k AND keyed.source IS NOT DISTINCT FROM bad.source GROUP BY nth),
base AS (
  SELECT nth, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (nth) LEFT JOIN rep USING (nth) LEFT JOIN gone USING (nth)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words - removed_words) * 100 >= n_words * 30 AS kept, removed_words
FROM judged""")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        F.col("doc").alias("doc_id"), *quality_rules.BASE, "base_failed", "kept", "removed_words"
    )


# --- 7: quality classifier ------------------------------------------------------------

QUALITY_LIMIT = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return nb_svm.fit(docs, nb_svm.known_labels(labels))


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return nb_svm.score(docs, quality_model(spark, docs, sf_dir)).select(
        "doc_id", nb_svm.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"),
    )


# --- 8: language ID -------------------------------------------------------------------

@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = nb_svm.held_out(F.col("doc_id"), 3, 1)
    model = language_id.train(docs.filter(~held))
    return language_id.identify(docs, model).select(
        "doc_id", nb_svm.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


# --- 9: best-fit packing --------------------------------------------------------------

@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


# --- 10: benchmark decontamination ----------------------------------------------------

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op10_benchmark_decontamination", rf"""
WITH d AS (
  SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_BENCH_WORD}') AS ws
  FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_BENCH_WORD}') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, list_slice(ws, s, s + least(len(ws), 10) - 1) AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(win) AS k FROM w),
spots AS (
  SELECT nth, s, k, list_slice(ws, s, s + k - 1) AS win
  FROM (SELECT nth, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, lens WHERE len(ws) >= k)),
hits AS (SELECT nth, s, k, win FROM spots SEMI JOIN w USING (win)),
cover AS (SELECT nth, count(DISTINCT p) AS n FROM (SELECT nth, s + unnest(range(0, k)) AS p FROM hits) GROUP BY nth),
items AS (SELECT DISTINCT nth, CAST(item_id AS VARCHAR) AS item FROM hits JOIN w USING (win)),
named AS (SELECT nth, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM items GROUP BY nth)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (nth) LEFT JOIN named USING (nth)""")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# --- 11: line dedup -------------------------------------------------------------------

@query("op11_line_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS nth, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT nth, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT nth, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM l),
f AS (
  SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key
  HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) > 1),
m AS (SELECT nth, line, pos, f.key IS NOT NULL AND doc_id IS DISTINCT FROM least AS gone FROM k LEFT JOIN f ON f.key = k.key),
o AS (
  SELECT nth, sum(gone::INTEGER) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY nth)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN o USING (nth)""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# --- 12: conversation structure repair --------------------------------------------------

# The checksum of an ASCII text by its table of 256 numbers.
_CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """SQL over a row of crc_table."""
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


@query("op12_conversation_repair", rf"""
WITH RECURSIVE {_CRC_TABLE},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM named WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
r AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, role, text, i, left(role, 1) AS ini,
    CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
moves AS (SELECT * FROM (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('A', 'u', 'U'), ('U', 'a', 'A')) v(st, sym, goes)),
ins AS (
  SELECT * FROM (VALUES ('E', '', 'E', 0), ('S', '', 'S', 0), ('U', '', 'U', 0), ('A', '', 'A', 0), ('E', 'I', 'U', 5), ('S', 'I', 'U', 5),
    ('U', 'I', 'A', 5), ('A', 'I', 'U', 5), ('E', 'II', 'A', 10), ('S', 'II', 'A', 10)) v(st, letters, goes, price)),
edits AS (
  SELECT r.c, r.i, m.st, m.goes, CASE WHEN m.sym = r.ini THEN 'K' ELSE 'R' END AS edit,
    (m.sym <> r.ini)::INTEGER + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS price
  FROM r JOIN moves m ON m.sym = r.ini OR m.sym IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT r.c, r.i, s.st, s.st, 'D', 2 FROM r, (SELECT DISTINCT st FROM ins) s),
f AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 'E' AS st, 0 AS cost, '' AS audit FROM r
  UNION ALL
  SELECT f.c, f.i + 1, e.goes, f.cost + n.price + e.price, f.audit || n.letters || e.edit
  FROM f JOIN ins n ON n.st = f.st JOIN edits e ON e.c = f.c AND e.i = f.i + 1 AND e.st = n.goes
  QUALIFY row_number() OVER (PARTITION BY f.c, e.goes ORDER BY f.cost + n.price + e.price, f.audit || n.letters || e.edit) = 1),
ends AS (
  SELECT f.c, f.cost + n.price AS cost, f.audit || n.letters AS audit
  FROM f JOIN ins n ON n.st = f.st JOIN (SELECT c, max(i) AS i FROM r GROUP BY c) z ON z.c = f.c AND z.i = f.i
  WHERE n.goes IN ('E', 'A')
  QUALIFY row_number() OVER (PARTITION BY f.c ORDER BY f.cost + n.price, f.audit || n.letters) = 1),
marks AS (SELECT c, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS spot FROM ends),
nth AS (SELECT *, sum((edit <> 'I')::INTEGER) OVER (PARTITION BY c ORDER BY spot) AS i FROM marks),
outs AS (
  SELECT nth.c, spot, edit, row_number() OVER (PARTITION BY nth.c ORDER BY spot) AS k, r.ini, r.role, r.text
  FROM nth LEFT JOIN r ON r.c = nth.c AND r.i = nth.i WHERE edit <> 'D'),
sys AS (SELECT c, (edit = 'K' AND ini = 's')::INTEGER AS s FROM outs WHERE k = 1),
fixed AS (
  SELECT c, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot)) AS sha FROM outs JOIN sys USING (c) GROUP BY c),
pairs AS (SELECT c, ini, lag(ini) OVER (PARTITION BY c ORDER BY i) AS before, i FROM r),
stats AS (
  SELECT c, conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM r GROUP BY c, conv_id),
bad AS (SELECT c, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY c),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN bad USING (c) LEFT JOIN ends USING (c)
LEFT JOIN fixed USING (c)""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = chat_repair.report(chat_repair.repair(chat_repair.damage(rows)))
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()  # also those that lost all rows
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# --- 13: periodic runs ------------------------------------------------------------------

_GRAM = periodic_runs.least_common(24, 3)


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the id's checksum ends in 0 the words from a on are its first p words from
    a, over and over. No function is applied word by word, so the split happens a few times a text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    ws = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    cut = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, ws).alias("ws"))
    n = F.size("ws")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("ws", a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.concat(F.slice("ws", F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return cut.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


# Stretches of equal words q apart are islands of equal windows of _GRAM words q apart.
@query("op13_periodic_runs", rf"""
WITH {_CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS nth, doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS o FROM documents, crc_table),
e AS (
  SELECT nth, doc_id, o, len(o) AS n, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) ELSE len(o) END AS a,
    h // 10 AS g FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
w AS (
  SELECT nth, doc_id, n, list_transform(range(n), lambda i: CASE WHEN i >= a THEN o[1 + a + (i - a) % p] ELSE o[1 + i] END) AS ws FROM f),
grams AS (
  SELECT nth, i, array_to_string(list_slice(ws, i + 1, i + {_GRAM}), ' ') AS g
  FROM (SELECT nth, ws, unnest(range(0, n - {_GRAM} + 1)) AS i FROM w WHERE n >= {_GRAM})),
twins AS (SELECT x.nth, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.nth = y.nth AND x.g = y.g AND x.i < y.i),
isles AS (SELECT nth, q, min(i) AS start, count(*) + {_GRAM} - 1 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY nth, q ORDER BY i) AS isle FROM twins) GROUP BY nth, q, isle),
runs AS (SELECT nth, start, length, min(q) AS period FROM isles WHERE length >= 24 AND length >= 3 * q GROUP BY nth, start, length),
listed AS (SELECT nth, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY nth),
best AS (
  SELECT x.* FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.nth = x.nth AND (y.length * x.period > x.length * y.period OR (y.length * x.period = x.length * y.period
      AND (y.start < x.start OR (y.start = x.start AND y.period < x.period)))))),
gone AS (SELECT DISTINCT nth, unnest(range(start + period, start + length)) AS i FROM runs),
cut AS (
  SELECT w.nth, string_agg(word, ' ' ORDER BY w.i) AS s FROM (SELECT nth, unnest(ws) AS word, unnest(range(0, n)) AS i FROM w) w
  LEFT JOIN gone ON gone.nth = w.nth AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.nth)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(cut.s, '')) AS collapsed_sha256
FROM w LEFT JOIN listed USING (nth) LEFT JOIN best USING (nth) LEFT JOIN cut USING (nth)""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_periods(documents(spark, sf_dir)))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start, then period, so only a strictly greater exponent takes over.
    best = F.aggregate("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    listed = F.array_join(F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select("doc_id", "runs", "collapsed", best.alias("b"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("l"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"),
        F.col("b.period").alias("period"), F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2("l", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
