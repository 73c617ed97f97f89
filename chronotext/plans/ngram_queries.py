"""Compression features over the given documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions.vocabulary import (
    COMPRESSION_FEATURES, DISTANCE_FEATURES, LEXICAL_FEATURES, NEOLOGISM_FEATURES,
    READABILITY_FEATURES,
)
from chronotext.operators import lexical, ngrams, prepare
from chronotext.plans import views as V
from chronotext.plans.registry import CTES, cte, query, rounded, stored
from chronotext.plans.text_queries import name, r6

ORDER = 2

# Every character with the two before it.
cte("chars", """
SELECT file_name, i, ch, lag(ch, 1) OVER w AS c1, lag(ch, 2) OVER w AS c2 FROM (
  SELECT file_name, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS i FROM corpus)
WINDOW w AS (PARTITION BY file_name ORDER BY i)""", ("corpus",))
# Gram counts by context length j; first_at is the place of the first occurrence.
cte("gramc", """
SELECT file_name, 0::BIGINT AS j, ch AS g, count(*) AS n, min(i) AS first_at FROM chars GROUP BY ALL
UNION ALL SELECT file_name, 1, c1 || ch AS g, count(*), min(i) FROM chars WHERE i >= 2 GROUP BY file_name, c1 || ch
UNION ALL SELECT file_name, 2, c2 || c1 || ch AS g, count(*), min(i) FROM chars WHERE i >= 3 GROUP BY file_name, c2 || c1 || ch""",
    ("chars",))
cte("ctxc", """
SELECT file_name, j, left(g, j::BIGINT) AS c, sum(n)::DOUBLE AS t, count(*)::DOUBLE AS d FROM gramc
GROUP BY file_name, j, left(g, j::BIGINT)""", ("gramc",))
# The first gram of level j sits at position j + 1.
cte("selfcost", """
SELECT file_name, j, n, first_at, log2(t + d) - log2(n) AS bits
FROM (SELECT *, left(g, j::BIGINT) AS c FROM gramc) JOIN ctxc USING (file_name, j, c)""", ("gramc", "ctxc"))
cte("selfcode", """
SELECT file_name, sum(n) FILTER (j = 0)::DOUBLE AS chars,
  coalesce(sum(n * bits) FILTER (j = 1), 0) + coalesce(sum(bits) FILTER (j = 0 AND first_at = 1), 0) AS bits_1,
  coalesce(sum(n * bits) FILTER (j = 2), 0) + coalesce(sum(bits) FILTER (j < 2 AND first_at = j + 1), 0) AS bits_2
FROM selfcost GROUP BY file_name""", ("selfcost",))
cte("entropy", """
SELECT file_name, -sum((n / l) * log2(n / l)) AS h FROM (
  SELECT file_name, n::DOUBLE AS n, sum(n) OVER (PARTITION BY file_name)::DOUBLE AS l FROM gramc WHERE j = 0)
GROUP BY file_name""", ("gramc",))

# Reference text: the sample in hash order, each text ended by a line break.
cte("reftext", f"""
SELECT string_agg(text || chr(10), '' ORDER BY md5('{V.SEED}:' || file_name), file_name) AS t
FROM corpus WHERE file_name IN (SELECT file_name FROM ref_ids)""", ("corpus", "ref_ids"))
cte("refchars", """
SELECT i, ch, lag(ch, 1) OVER w AS c1, lag(ch, 2) OVER w AS c2 FROM (
  SELECT unnest(string_split(t, '')) AS ch, unnest(range(1, length(t) + 1)) AS i FROM reftext)
WINDOW w AS (ORDER BY i)""", ("reftext",))
cte("refg", """
SELECT 0::BIGINT AS j, ch AS g, count(*)::DOUBLE AS n, min(i) AS first_at FROM refchars GROUP BY ch
UNION ALL SELECT 1, c1 || ch, count(*)::DOUBLE, min(i) FROM refchars WHERE i >= 2 GROUP BY c1 || ch
UNION ALL SELECT 2, c2 || c1 || ch, count(*)::DOUBLE, min(i) FROM refchars WHERE i >= 3 GROUP BY c2 || c1 || ch""",
    ("refchars",))
cte("refc", """
SELECT j, left(g, j::BIGINT) AS c, sum(n) AS t, count(*)::DOUBLE AS d, sum(n * log2(n)) AS q FROM refg
GROUP BY j, left(g, j::BIGINT)""", ("refg",))
cte("refx", """
SELECT a.j, left(a.g, a.j::BIGINT) AS c, sum(b.n) AS x FROM refg a
JOIN refg b ON b.j = a.j - 1 AND b.g = right(a.g, a.j::BIGINT) GROUP BY a.j, left(a.g, a.j::BIGINT)""", ("refg",))
cte("alpha", """
SELECT count(DISTINCT ch)::DOUBLE AS a FROM (
  SELECT unnest(string_split(text, '')) AS ch FROM corpus WHERE split <> 'gutenberg')""", ("corpus",))
cte("proc", "SELECT * FROM corpus WHERE file_name NOT IN (SELECT file_name FROM ref_ids)", ("corpus", "ref_ids"))
# Bits per distinct gram, from the empty context up: cost at level j uses the cost one
# level down after excluding the symbols of the level-j context.
cte("price0", """
SELECT g, CASE WHEN n IS NULL THEN NULL ELSE n END AS n0, t AS t0, d AS d0,
  log2(greatest(1, alpha.a - coalesce(d, 0))) AS u
FROM (SELECT DISTINCT g FROM gramc WHERE j = 0) s LEFT JOIN refg USING (g)
CROSS JOIN alpha LEFT JOIN (SELECT t, d FROM refc WHERE j = 0) ON true
WHERE refg.j = 0 OR refg.j IS NULL""", ("gramc", "refg", "refc", "alpha"))
cte("price1", """
SELECT s.g, r.n AS n1, c.t AS t1, c.d AS d1, p.n0, p.u,
  CASE WHEN p.n0 IS NOT NULL THEN log2(t0 - coalesce(x.x, 0) + d0 - coalesce(c.d, 0)) - log2(n0)
    WHEN t0 IS NULL OR d0 - coalesce(c.d, 0) <= 0 THEN u
    ELSE log2(t0 - coalesce(x.x, 0) + d0 - coalesce(c.d, 0)) - log2(d0 - coalesce(c.d, 0)) + u END AS low
FROM (SELECT DISTINCT g FROM gramc WHERE j = 1) s
JOIN price0 p ON p.g = right(s.g, 1)
LEFT JOIN refg r ON r.j = 1 AND r.g = s.g
LEFT JOIN refc c ON c.j = 1 AND c.c = left(s.g, 1)
LEFT JOIN refx x ON x.j = 1 AND x.c = left(s.g, 1)""", ("gramc", "refg", "refc", "refx", "price0"))
cte("cost", """
SELECT 0::BIGINT AS j, g, CASE WHEN n0 IS NOT NULL THEN log2(t0 + d0) - log2(n0) WHEN t0 IS NULL THEN u
  ELSE log2(t0 + d0) - log2(d0) + u END AS bits FROM price0
UNION ALL
SELECT 1, g, CASE WHEN n1 IS NOT NULL THEN log2(t1 + d1) - log2(n1) WHEN t1 IS NULL THEN low
  ELSE log2(t1 + d1) - log2(d1) + low END FROM price1
UNION ALL
SELECT 2, s.g, CASE WHEN r.n IS NOT NULL THEN log2(c.t + c.d) - log2(r.n)
    WHEN c.t IS NULL THEN mid ELSE log2(c.t + c.d) - log2(c.d) + mid END
FROM (
  SELECT s.g, CASE
    WHEN n1 IS NOT NULL THEN log2(t1 - coalesce(x.x, 0) + d1 - coalesce(c.d, 0)) - log2(n1)
    WHEN t1 IS NULL OR d1 - coalesce(c.d, 0) <= 0 THEN low
    ELSE log2(t1 - coalesce(x.x, 0) + d1 - coalesce(c.d, 0)) - log2(d1 - coalesce(c.d, 0)) + low END AS mid
  FROM (SELECT DISTINCT g FROM gramc WHERE j = 2) s
  JOIN price1 p ON p.g = right(s.g, 2)
  LEFT JOIN refc c ON c.j = 2 AND c.c = left(s.g, 2)
  LEFT JOIN refx x ON x.j = 2 AND x.c = left(s.g, 2)) s
LEFT JOIN refg r ON r.j = 2 AND r.g = s.g
LEFT JOIN refc c ON c.j = 2 AND c.c = left(s.g, 2)""", ("gramc", "refg", "refc", "refx", "price0", "price1"))
cte("refcode", """
SELECT file_name, sum(n) FILTER (j = 0)::DOUBLE AS chars,
  coalesce(sum(n * bits) FILTER (j = 1), 0) + coalesce(sum(bits) FILTER (j = 0 AND first_at = 1), 0) AS bits_1,
  coalesce(sum(n * bits) FILTER (j = 2), 0) + coalesce(sum(bits) FILTER (j < 2 AND first_at = j + 1), 0) AS bits_2
FROM gramc JOIN cost USING (j, g) JOIN proc USING (file_name) GROUP BY file_name""", ("gramc", "cost", "proc"))
# Text followed by the reference: windows that start in the text.
cte("refbits", """
SELECT k, (SELECT sum(t * log2(t + d) - q) FROM refc WHERE j = k) AS body,
  (SELECT sum(log2(t + d) - log2(n)) FROM refg JOIN refc ON refc.j = refg.j AND refc.c = left(refg.g, refg.j::BIGINT)
   WHERE refg.j < k AND first_at = refg.j + 1) AS opening
FROM (VALUES (1), (2)) v(k)""", ("refg", "refc"))
cte("joint_chars", f"""
SELECT file_name, i, l, ch, lead(ch, 1) OVER w AS c1, lead(ch, 2) OVER w AS c2 FROM (
  SELECT file_name, length(text) AS l, unnest(string_split(text || left(t, {ORDER}), '')) AS ch,
    unnest(range(1, length(text) + {ORDER} + 1)) AS i FROM proc CROSS JOIN reftext)
WINDOW w AS (PARTITION BY file_name ORDER BY i)""", ("proc", "reftext"))
cte("joint_g", """
SELECT o.*, left(g, j::BIGINT) AS c, coalesce(r.n, 0) AS nr FROM (
  SELECT file_name, 0::BIGINT AS j, ch AS g, count(*)::DOUBLE AS nx, bool_or(i = 1) AS opens
  FROM joint_chars WHERE i <= l GROUP BY file_name, ch
  UNION ALL SELECT file_name, 1, ch || c1, count(*)::DOUBLE, bool_or(i = 1)
  FROM joint_chars WHERE i <= l GROUP BY file_name, ch || c1
  UNION ALL SELECT file_name, 2, ch || c1 || c2, count(*)::DOUBLE, bool_or(i = 1)
  FROM joint_chars WHERE i <= l GROUP BY file_name, ch || c1 || c2) o
LEFT JOIN refg r USING (j, g)""", ("joint_chars", "refg"))
cte("joint_c", """
SELECT o.*, coalesce(t, 0) AS t, coalesce(d, 0) AS d, coalesce(q, 0) AS q FROM (
  SELECT file_name, j, c, sum(nx) AS tx, sum((nr = 0)::INTEGER)::DOUBLE AS new,
    sum((nr + nx) * log2(nr + nx) - CASE WHEN nr > 0 THEN nr * log2(nr) ELSE 0 END) AS dq,
    max(CASE WHEN opens THEN nr + nx END) AS n_open
  FROM joint_g GROUP BY file_name, j, c) o LEFT JOIN refc USING (j, c)""", ("joint_g", "refc"))
cte("joint", """
SELECT file_name, k, body + sum(CASE WHEN j = k THEN (t + tx) * log2(t + tx + d + new) - (q + dq)
    - CASE WHEN t > 0 THEN t * log2(t + d) - q ELSE 0 END
  WHEN j < k AND n_open IS NOT NULL THEN log2(t + tx + d + new) - log2(n_open) ELSE 0 END) AS bits
FROM joint_c CROSS JOIN refbits GROUP BY file_name, k, body""", ("joint_c", "refbits"))


def ncd_sql(k: int) -> str:
    return f"""
SELECT file_name, round(greatest(0, least(1, (bits - least(x, y)) / greatest(x, y))), 6) + 0.0 AS "NCD_Order_{k}" FROM (
  SELECT file_name, j.bits, s.bits_{k} AS x, (SELECT body + opening FROM refbits WHERE k = {k}) AS y
  FROM joint j JOIN selfcode s USING (file_name) WHERE k = {k})"""


# The same for the sample of the validation set.
_OF_SAMPLE = ["ref_ids", "reftext", "refchars", "refg", "refc", "refx", "proc", "price0", "price1", "cost", "refcode"]
for _name in _OF_SAMPLE[1:]:
    _renamed = re.compile(rf"\b({'|'.join(_OF_SAMPLE)})\b")
    cte(f"{_name}_v", _renamed.sub(r"\1_v", CTES[_name][1]),
        tuple(f"{u}_v" if u in _OF_SAMPLE else u for u in CTES[_name][0]))


@query("char_ngrams", """
SELECT file_name, left(g, 1) AS ctx, right(g, 1) AS sym, n FROM gramc WHERE j = 1
UNION ALL SELECT file_name, '', g, 1 FROM gramc WHERE j = 0 AND first_at = 1""", ("gramc",))
def char_ngrams(spark, sf_dir):
    return ngrams.char_ngrams(V.corpus(spark, sf_dir), 1)


def self_table(spark, sf_dir):
    return ngrams.self_code(V.corpus(spark, sf_dir), ORDER).select("file_name", *ngrams.self_columns([1, ORDER]))


@query("shannon_entropy", 'SELECT file_name, round(h, 6) + 0.0 AS "Shannon_Entropy" FROM entropy', ("entropy",))
def shannon_entropy(spark, sf_dir):
    found = ngrams.character_entropy(V.corpus(spark, sf_dir))
    return rounded(found.select("file_name", F.col("entropy").alias("Shannon_Entropy")))


def _register_order(k: int) -> None:
    @query(f"compression_ratio_o{k}", f"""
SELECT file_name, round(bits_{k} / chars / 8, 6) + 0.0 AS "Compression_Ratio_Order_{k}" FROM selfcode""", ("selfcode",))
    def ratio(spark, sf_dir):
        return rounded(self_table(spark, sf_dir).select("file_name", f"Compression_Ratio_Order_{k}"))

    @query(f"entropy_ratio_o{k}", f"""
SELECT file_name, round(CASE WHEN h > 1e-12 THEN bits_{k} / chars / h ELSE 0 END, 6) + 0.0 AS "Entropy_Ratio_Order_{k}"
FROM selfcode JOIN entropy USING (file_name)""", ("selfcode", "entropy"))
    def entropy_ratio(spark, sf_dir):
        return rounded(self_table(spark, sf_dir).select("file_name", f"Entropy_Ratio_Order_{k}"))

    @query(f"nrc_o{k}", f"""
SELECT file_name, round(bits_{k} / (chars * log2(alpha.a)), 6) + 0.0 AS "NRC_Order_{k}" FROM refcode CROSS JOIN alpha""",
           ("refcode", "alpha"))
    def nrc(spark, sf_dir):
        return rounded(ngrams.nrc(
            V.processed(spark, sf_dir), V.reference(spark, sf_dir), k, V.alphabet_size(spark, sf_dir)
        ))

    @query(f"ncd_o{k}", ncd_sql(k), ("joint", "selfcode", "refbits"))
    def ncd(spark, sf_dir):
        return rounded(ngrams.ncd(V.processed(spark, sf_dir), V.reference(spark, sf_dir), k))


for _k in (1, ORDER):
    _register_order(_k)


@query("reference_model", """
SELECT j AS level, left(g, j::BIGINT) AS ctx, right(g, 1) AS sym, n::BIGINT AS n FROM refg""", ("refg",))
def reference_model(spark, sf_dir):
    return _model_grams(V.reference(spark, sf_dir))


def _model_grams(model: ngrams.ReferenceModel) -> DataFrame:
    return model.grams.select(
        F.col("level").cast("bigint").alias("level"), F.left(F.col("g"), F.col("level")).alias("ctx"),
        F.right(F.col("g"), F.lit(1)).alias("sym"), F.col("n"),
    )


@query("reference_model_validation", """
SELECT j AS level, left(g, j::BIGINT) AS ctx, right(g, 1) AS sym, n::BIGINT AS n FROM refg_v""", ("refg_v",))
def reference_model_validation(spark, sf_dir):
    return _model_grams(V.reference_validation(spark, sf_dir))


@query("reference_sample_validation", "SELECT file_name, decade::BIGINT AS decade FROM ref_ids_v", ("ref_ids_v",))
def reference_sample_validation(spark, sf_dir):
    return rounded(V.validation_ids(spark, sf_dir))


@query("nrc_by_split", " UNION ALL ".join(f"""
SELECT file_name, split, {', '.join(f'round(bits_{k} / (chars * log2(alpha.a)), 6) + 0.0 AS "NRC_Order_{k}"' for k in (1, ORDER))}
FROM {code} JOIN corpus USING (file_name) CROSS JOIN alpha WHERE split IN ({sets})""" for code, sets in (
    ("refcode", "'train', 'validation'"), ("refcode_v", "'test', 'gutenberg'"))), ("refcode", "refcode_v", "corpus", "alpha"))
def nrc_by_split(spark, sf_dir):
    """Training and validation texts against the training sample, the others against the
    sample of validation."""
    docs, size = V.processed(spark, sf_dir), V.alphabet_size(spark, sf_dir)
    parts = []
    for model, sets in ((V.reference(spark, sf_dir), ("train", "validation")),
                        (V.reference_validation(spark, sf_dir), ("test", "gutenberg"))):
        own = docs.filter(F.col("split").isin(*sets))
        code = ngrams.document_code(own, ORDER, model=model, alphabet_size=size)
        rates = [ngrams.nrc_column(F.col(f"ref_bits_{k}"), F.col("chars"), k, size) for k in (1, ORDER)]
        parts.append(code.select("file_name", *rates).join(own.select("file_name", "split"), "file_name"))
    return rounded(reduce(DataFrame.unionByName, parts))


@query("nrc_self", """
SELECT file_name, round(bits_2 / (chars * log2(alpha.a)), 6) + 0.0 AS "NRC_Order_2" FROM selfcode CROSS JOIN alpha""",
       ("selfcode", "alpha"))
def nrc_self(spark, sf_dir):
    return rounded(ngrams.nrc(V.corpus(spark, sf_dir), None, ORDER, V.alphabet_size(spark, sf_dir)))


FULL_ROW = (
    LEXICAL_FEATURES + READABILITY_FEATURES + DISTANCE_FEATURES + NEOLOGISM_FEATURES + COMPRESSION_FEATURES
)
cte("feature_row", """
SELECT r.*, c.bits_1 / (c.chars * log2(alpha.a)) AS "NRC_Order_1", c.bits_2 / (c.chars * log2(alpha.a)) AS "NRC_Order_2",
  s.bits_1 / s.chars / 8 AS "Compression_Ratio_Order_1", s.bits_2 / s.chars / 8 AS "Compression_Ratio_Order_2",
  CASE WHEN h > 1e-12 THEN s.bits_1 / s.chars / h ELSE 0 END AS "Entropy_Ratio_Order_1",
  CASE WHEN h > 1e-12 THEN s.bits_2 / s.chars / h ELSE 0 END AS "Entropy_Ratio_Order_2", h AS "Shannon_Entropy"
FROM raw_features r JOIN refcode c USING (file_name) JOIN selfcode s USING (file_name) JOIN entropy e USING (file_name)
CROSS JOIN alpha""", ("raw_features", "refcode", "selfcode", "entropy", "alpha"))


def full_features(spark, sf_dir):
    """The wide row of every document outside the reference, with its periods. Sorted inside its files, as learners
    that draw by a row's place read it."""
    def build():
        docs = V.processed(spark, sf_dir)
        rows = lexical.feature_row(
            docs, V.reference(spark, sf_dir), V.alphabet_size(spark, sf_dir), ORDER, terms=V.terms()
        )
        return prepare.join_metadata(rows, V.metadata(spark, sf_dir)).join(
            docs.select("file_name", "split"), "file_name"
        ).sortWithinPartitions("file_name")

    return stored(spark, sf_dir, "full_features", build)


@query("feature_row_ncd", "SELECT f.file_name, " + ", ".join(
    f"f.{name(c)}" if c in NEOLOGISM_FEATURES[:-1] else f"round(f.{name(c)}, 6) + 0.0 AS {name(c)}" for c in FULL_ROW
) + ", " + ", ".join(f'round(n{k}."NCD_Order_{k}", 6) + 0.0 AS "NCD_Order_{k}"' for k in (1, ORDER))
       + " FROM feature_row f " + " ".join(f"JOIN ({ncd_sql(k)}) n{k} USING (file_name)" for k in (1, ORDER)),
       ("feature_row", "joint", "selfcode", "refbits"))
def feature_row_ncd(spark, sf_dir):
    """The wide row with the distances to the reference text."""
    return rounded(lexical.feature_row(
        V.processed(spark, sf_dir), V.reference(spark, sf_dir), V.alphabet_size(spark, sf_dir), ORDER,
        use_ncd=True, terms=V.terms(),
    ).select("file_name", *FULL_ROW, *[f"NCD_Order_{k}" for k in (1, ORDER)]))


@query("feature_row", "SELECT file_name, " + ", ".join(
    name(c) if c in NEOLOGISM_FEATURES[:-1] else r6(c) for c in FULL_ROW
) + " FROM feature_row", ("feature_row",))
def feature_row(spark, sf_dir):
    return rounded(lexical.feature_row(
        V.processed(spark, sf_dir), V.reference(spark, sf_dir), V.alphabet_size(spark, sf_dir), ORDER,
        terms=V.terms(),
    ).select("file_name", *FULL_ROW))


@query("feature_subset_compression", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({name(c)}), 6) + 0.0 AS mean FROM feature_row" for c in COMPRESSION_FEATURES
), ("feature_row",))
def feature_subset_compression(spark, sf_dir):
    kept = prepare.feature_subset(full_features(spark, sf_dir).drop("split"), "compression")
    means = kept.agg(*[F.avg(f"`{c}`").alias(c) for c in kept.columns])
    return rounded(means.unpivot([], kept.columns, "feature", "mean"))


@query("documented_extras", r"""
SELECT file_name, round(up / greatest(letters, 1), 6) + 0.0 AS "Uppercase_Ratio", round(special / l, 6) + 0.0 AS "Special_Character_Ratio",
  round(CASE WHEN n > 0 THEN h / n ELSE 0 END, 6) + 0.0 AS "Entropy_Per_Word",
  round(CASE WHEN n > 0 THEN hapax / n ELSE 0 END, 6) + 0.0 AS "Hapax_Ratio",
  round(CASE WHEN n > 0 THEN types / n ELSE 0 END, 6) + 0.0 AS "Type_Token_Ratio"
FROM (
  SELECT file_name, length(text)::DOUBLE AS l, len(regexp_extract_all(text, '\p{Lu}'))::DOUBLE AS up,
    len(regexp_extract_all(text, '\p{L}'))::DOUBLE AS letters,
    len(regexp_extract_all(text, '[^\p{L}\p{N}\s[:punct:]]'))::DOUBLE AS special,
    len(words)::DOUBLE AS n, len(list_distinct(words))::DOUBLE AS types
  FROM (SELECT 'doc_' || doc_id AS file_name, text,
    list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents))
JOIN (
  SELECT file_name, -sum((c / t) * log2(c / t)) AS h FROM (
    SELECT file_name, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY file_name)::DOUBLE AS t
    FROM (SELECT 'doc_' || doc_id AS file_name, unnest(string_split(text, '')) AS ch FROM documents)
    GROUP BY file_name, ch) GROUP BY file_name) USING (file_name)
LEFT JOIN (
  SELECT file_name, sum((c = 1)::INTEGER)::DOUBLE AS hapax FROM (
    SELECT file_name, w, count(*) AS c FROM (
      SELECT 'doc_' || doc_id AS file_name,
        unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents)
    GROUP BY file_name, w) GROUP BY file_name) USING (file_name)""")
def documented_extras(spark, sf_dir):
    return rounded(lexical.documented_extras(V.corpus(spark, sf_dir, lowercase=False)))
