"""Query op11: license scan of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_scan import BASE, CONFIDENCE, license_scan, rules, spaced


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return df.select(
        "row.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "found.label")).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, CONFIDENCE[2]).otherwise(0.0), F.coalesce(F.array_max("found.confidence"), F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lines = ",\n".join(f"({i}, {quoted(r.label)}, {r.level}, {quoted(r.keyword)}, {quoted(spaced(r.pattern))})" for i, r in enumerate(rules()))
    base = ", ".join(f"({quoted(' ' + p.replace(' ', '  ') + ' ')}, {quoted(label)})" for p, label in BASE)
    sure = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in CONFIDENCE.items())
    return rf"""
WITH r(rule, label, level, keyword, pattern) AS (VALUES {lines}),
b(pattern, label) AS (VALUES {base}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
l AS MATERIALIZED (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS line FROM d),
-- a match is put between two marks; what precedes a mark gives its word
m AS (SELECT doc_id, rule, string_split(regexp_replace(line, '(' || pattern || ')', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM l JOIN r ON contains(line, ' ' || keyword || ' ') WHERE regexp_matches(line, pattern)),
u AS (SELECT doc_id, rule, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM m),
v AS (SELECT doc_id, rule, i, string_split(piece, chr(2))[1] AS hit, coalesce(sum(len(replace(piece, chr(2), '')) - len(replace(replace(piece, chr(2), ''), ' ', ''))) OVER (PARTITION BY doc_id, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spaces FROM u),
x AS (SELECT doc_id, rule, label, level, CAST(spaces // 2 AS BIGINT) AS a, CAST((spaces + len(hit) - len(replace(hit, ' ', ''))) // 2 - 1 AS BIGINT) AS z FROM v JOIN r USING (rule) WHERE i > 1),
k AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x AS o WHERE o.doc_id = x.doc_id AND o.a <= x.a AND o.z >= x.z
  AND (o.level > x.level OR (o.level = x.level AND (o.z - o.a > x.z - x.a OR (o.z - o.a = x.z - x.a AND o.rule < x.rule)))))),
bp AS (SELECT doc_id, label, string_split(replace(line, pattern, chr(1) || pattern), chr(1)) AS p FROM l JOIN b ON contains(line, pattern)),
bs AS (SELECT doc_id, label, i, coalesce(sum(len(piece) - len(replace(piece, ' ', ''))) OVER (PARTITION BY doc_id, label ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2 AS word FROM (SELECT doc_id, label, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM bp)),
bw AS (SELECT doc_id, count(*) AS n, CAST(min(word) AS BIGINT) AS a, CAST(max(word) AS BIGINT) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM bs WHERE i > 1 GROUP BY doc_id),
kl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION SELECT doc_id, label FROM bs WHERE i > 1) GROUP BY doc_id),
ks AS (SELECT doc_id, max(CASE level {sure} END) AS score FROM k GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(bw.n, 0) AS n_base, bw.a AS first_word, bw.z AS last_word, coalesce(bw.labels, '') AS base_labels, coalesce(kl.labels, '') AS labels,
  greatest(CASE WHEN bw.n > 0 THEN {CONFIDENCE[2]}::DOUBLE ELSE 0::DOUBLE END, coalesce(ks.score, 0::DOUBLE)) AS score
FROM l LEFT JOIN bw USING (doc_id) LEFT JOIN kl USING (doc_id) LEFT JOIN ks USING (doc_id)
"""


OP11_SQL = _sql()
