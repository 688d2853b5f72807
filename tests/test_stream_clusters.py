"""Clusters over a stream: out-of-order rows, rows too late, expiry and what stays open."""

import numpy as np
import pytest

from somaspark.streaming import clusters as K

SCHEMA = "user_id long, ts timestamp"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, K.PROVIDER)
    yield
    spark.conf.set(name, old)


def fed(spark, path, rows):
    """One more file of (user, minute), and all that the stream has handed out since."""
    spark.createDataFrame(rows, "user_id long, minute int").selectExpr("user_id", "timestamp_seconds(minute * 60) as ts").coalesce(1).write.mode("append").parquet(f"{path}/in")
    df = K.closed_clusters(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), "user_id", gap_seconds=1800, late="60 minutes")
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"{path}/out").selectExpr("key", "unix_seconds(begin) div 60 as b", "unix_seconds(end) div 60 as e", "n")
    return sorted(map(tuple, got.collect()))


def test_clusters_close_by_timers(spark, tmp_path, store):
    path = str(tmp_path)
    assert fed(spark, path, [(1, 100), (1, 160), (2, 100), (1, 130 - 100), (None, 5), (3, 150)]) == [(1, 30, 30, 1)]
    # minute 130 joins both clusters of user 1; the watermark goes from 100 to 190
    assert fed(spark, path, [(1, 130), (3, 250)]) == [(1, 30, 30, 1), (2, 100, 100, 1), (3, 150, 150, 1)]
    # 120 lies behind the watermark; what could join 160 closes once 190 is passed
    assert fed(spark, path, [(1, 120), (2, 251), (3, 252)]) == [(1, 30, 30, 1), (1, 100, 160, 3), (2, 100, 100, 1), (3, 150, 150, 1)]
    # the rest stays open until later rows come, and each cluster comes once
    assert fed(spark, path, [(9, 900)])[-2:] == [(3, 150, 150, 1), (3, 250, 252, 2)]


def test_joined_spans():
    got = K.joined(np.array([[50, 60, 2], [10, 10, 1], [20, 45, 3], [200, 200, 1]]), 5)
    assert got.tolist() == [[10, 10, 1], [20, 60, 5], [200, 200, 1]]
