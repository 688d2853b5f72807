"""Query op3: encode and decode all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sentence_pieces import decode, encode


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return df.select("doc_id", "n_tokens", "n_byte_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))
