"""Structured Streaming forms: windows, sessions, duplicate removal and a stateful run detector."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event time as an instant, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per type and window; rows later than the watermark are dropped."""
    df = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return df.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Call clustering over time: rows of a user within the gap."""
    df = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return df.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begin"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def type_runs(events: DataFrame) -> DataFrame:
    """Longest run of one event type so far of each user; the state is one row a user."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kind, run, best = state.get if state.exists else ("", 0, 0)
        for part in parts:
            for t in part.sort_values(["ts", "event_id"])["event_type"]:
                kind, run = t, run + 1 if t == kind else 1
                best = max(best, run)
        state.update((kind, run, best))
        yield pd.DataFrame({"user_id": [key[0]], "longest": [best]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, longest long", "kind string, run long, best long", "update", GroupStateTimeout.NoTimeout)
