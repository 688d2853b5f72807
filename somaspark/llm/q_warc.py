"""Query op4: write all pages as WARC records and read the archives back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import mark_revisits, read_archives, write_archives


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(mark_revisits(table(spark, sf_dir, "pages")))
    records = read_archives(manifest, payloads=False).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN octet_length(encode(html)) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(html)) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS last FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
