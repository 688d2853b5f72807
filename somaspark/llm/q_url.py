"""Query op9: judge all page urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .url_filter import judge_urls, mine_rules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the documents with the pages' ids serve as the pages' labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id as page_id", "coalesce(quality = 0 or toxic = 1, false) as bad")
    return judge_urls(pages, mine_rules(pages.join(labels, "page_id")), RULES)
