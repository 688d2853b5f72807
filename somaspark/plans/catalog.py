"""Registry of the library's own queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_builder, q_calling, q_calls, q_intervals, q_reads, q_tensors

MODULES = (q_intervals, q_calling, q_reads, q_calls, q_tensors, q_builder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.q.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidate variants survive the SNP rule, with depth, counts and fraction, in contig order."""
    return q_calling.snp_calls(spark, sf_dir).orderBy("contig", "pos")
