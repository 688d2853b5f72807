"""Query op10: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import stored, table
from .quality_rules import FENCE, METRICS, MIN_ROWS, judged, measured


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored(measured(table(spark, sf_dir, "documents")).selectExpr("row.doc_id", "* except (row)"), "quality-measures")
    return judged(m).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "base_failed", "kept")


def _sql() -> str:
    rate = lambda a, b: f"CAST({a} AS DOUBLE) / CASE WHEN {b} > 0 THEN {b} END"
    q = ", ".join(f"quantile_disc({rate(a, b)}, {x}) AS {c}_{side}" for c, (a, b, high, low) in METRICS.items() for side, x in (("a", low), ("m", 0.5), ("b", high)) if x is not None)
    pick = lambda x: f"CASE WHEN g.n >= {MIN_ROWS} THEN g.{x} WHEN l.n >= {MIN_ROWS} THEN l.{x} ELSE w.{x} END"
    rules = []
    for c, (a, b, _, low) in METRICS.items():
        mid, hi = pick(f"{c}_m"), pick(f"{c}_b")
        rules.append(f"{rate('m.' + a, 'm.' + b)} <= ({hi}) + {FENCE}::DOUBLE * (({hi}) - ({mid}))")
        if low is not None:
            lo = pick(f"{c}_a")
            rules.append(f"{rate('m.' + a, 'm.' + b)} >= ({lo}) - {FENCE}::DOUBLE * (({mid}) - ({lo}))")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '-') AS lang_key, coalesce(source, '-') AS source_key, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g3 AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g3 WHERE c IS NOT NULL) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
lines AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_lines, CAST(sum(k - 1) AS BIGINT) AS n_dup_lines FROM ln GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars,
       count(*) FILTER (word = upper(word) AND word <> lower(word)) AS n_upper_words FROM w GROUP BY doc_id),
m AS (SELECT d.doc_id, lang_key, source_key, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_upper_words, 0) AS n_upper_words
      FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
p AS (SELECT * FROM m WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
g AS (SELECT lang_key, source_key, count(*) AS n, {q} FROM p GROUP BY 1, 2),
l AS (SELECT lang_key, count(*) AS n, {q} FROM p GROUP BY 1),
whole AS (SELECT count(*) AS n, {q} FROM p),
j AS (SELECT m.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
      coalesce({' AND '.join(rules)}, false) AS good
      FROM m LEFT JOIN g USING (lang_key, source_key) LEFT JOIN l USING (lang_key) CROSS JOIN whole AS w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper_words, base_failed, (NOT base_failed AND good) AS kept FROM j
"""


OP10_SQL = _sql()
