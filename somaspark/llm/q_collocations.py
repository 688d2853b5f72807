"""Query op12: collocations of all documents, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import table


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)) GROUP BY ALL HAVING k = 1 OR n >= 30),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, n AS a, k AS len, string_split(phrase, ' ') AS words FROM f WHERE n >= 30 AND k > 1),
cut AS (SELECT *, array_to_string(list_slice(words, 1, k), ' ') AS head, array_to_string(list_slice(words, k + 1, len), ' ') AS rest FROM (SELECT *, unnest(generate_series(1, len - 1)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.k, a, l.n AS l, r.n AS r, CAST((2000000 * a::HUGEINT) // (l.n + r.n) AS BIGINT) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = head JOIN f AS r ON r.lang = cut.lang AND r.phrase = rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
mx AS (SELECT lang, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(generate_series(1, len - m + 1)) AS i FROM c, (VALUES (2), (3)) AS t(m) WHERE len > m) GROUP BY ALL),
kept AS (SELECT best.lang, best.phrase, a, l, r, score FROM best LEFT JOIN mx ON mx.lang = best.lang AND mx.phrase = best.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT kept.lang, rank, phrase, a, l, r, t.n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) AS kept JOIN t ON t.lang = kept.lang WHERE rank <= 2000
"""
