"""Query op7: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lang_id import fit, predict


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    langs, net = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), langs, net).select("doc_id", "held_out", "lang_pred", "score")
