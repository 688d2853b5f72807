"""Clustering over an unbounded stream (W2): state is kept for open clusters only and ends by timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key long, begin timestamp, end timestamp, n long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(spans: np.ndarray, gap: int) -> np.ndarray:
    """Rows (begin, end, n) of clusters and single times, in one row wherever at most gap lies between."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1] + gap])
    return np.column_stack([spans[first, 0], np.maximum.reduceat(spans[:, 1], first), np.add.reduceat(spans[:, 2], first)])


class OpenClusters(StatefulProcessor):
    """The clusters of a key that a row may still join, in microseconds. A row between two of them joins
    both. A timer a cluster, just past its end and the gap, hands it out and forgets it: no row that the
    watermark lets pass can reach it then."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "begin long, end long, n long")

    def due(self, end: int) -> int:
        """The first millisecond past what a cluster of this end can take in."""
        return (end + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(map(int, r)) for r in self.open.get()] if self.open.exists() else []
        spans = np.array(held, "int64").reshape(-1, 3)
        for part in rows:  # each batch of rows is folded before the next is read
            t = part["us"].to_numpy("int64")
            spans = joined(np.vstack([spans, np.column_stack([t, t, np.ones_like(t)])]), self.gap)
        had, want = {self.due(e) for _, e, _ in held}, {self.due(int(e)) for e in spans[:, 1]}
        for at in had - want:
            self.handle.deleteTimer(at)
        for at in want - had:
            self.handle.registerTimer(at)
        self.open.put([tuple(map(int, r)) for r in spans])
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "begin": pd.Series([], dtype="datetime64[us]"), "end": pd.Series([], dtype="datetime64[us]"), "n": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(map(int, r)) for r in self.open.get()] if self.open.exists() else []
        closed, rest = [r for r in held if self.due(r[1]) <= now], [r for r in held if self.due(r[1]) > now]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        yield pd.DataFrame({"key": np.full(len(closed), key[0], "int64"), "begin": pd.to_datetime([r[0] for r in closed], unit="us"), "end": pd.to_datetime([r[1] for r in closed], unit="us"), "n": np.array([r[2] for r in closed], "int64")})

    def close(self) -> None:
        pass


def closed_clusters(events: DataFrame, key: str, ts: str = "ts", gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """key, begin, end, n: clusters of a key's rows with at most gap between neighbours, each handed out
    once, when the watermark has passed what could still join it. key is an integer column; rows with a
    null key or time, and rows behind the watermark, are left out. Needs the RocksDB state store
    (``PROVIDER`` as spark.sql.streaming.stateStore.providerClass)."""
    df = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    df = df.select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"))
    return df.groupBy("key").transformWithStateInPandas(OpenClusters(gap_seconds * 1_000_000), OUT, "append", "eventTime")
