"""Query op5: boilerplate lines out of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .line_dedup import MIN_SITES, dedup_lines


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return df.select("row.doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT trim(line, ' ') AS k, min((doc_id, pos)) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT l.*, trim(line, ' ') <> '' AS filled, s.k IS NOT NULL AND (doc_id, pos) <> first AS gone FROM l LEFT JOIN s ON trim(line, ' ') = s.k)
SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed,
  CAST(length(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS BIGINT) AS text_chars,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
