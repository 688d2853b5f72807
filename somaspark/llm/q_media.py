"""Query op6: all documents as stored media, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .media import media_columns


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
