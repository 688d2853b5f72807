"""The corpus pipeline: documents to packed training windows, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from somaspark.llm.common import stored
from somaspark.llm.lang_id import language_filter
from somaspark.llm.line_dedup import line_dedup
from somaspark.llm.near_dedup import near_dedup
from somaspark.llm.q_pack import packed
from somaspark.llm.quality_rules import quality_filter

NEAR_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return language_filter(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found at many sites keep their first occurrence; documents left without a word go."""
    return line_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays; alike by shingles of five words."""
    return near_dedup(docs, words=NEAR_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 4096 tokens."""
    return packed(docs)


STAGES = [("language", language), ("quality", quality), ("lines", lines), ("near", near), ("packing", packing)]

#: Language prediction, sketches and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
