"""Streams over the events table end in the same rows as the batch forms."""

from somaspark.plans import q_calls, q_reads
from somaspark.streaming import events as S

DATA = "/root/testdata/sf0.001"


def drained(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path):
    t = spark.read.parquet(f"{DATA}/events.parquet")
    t.repartition(1).write.parquet(str(tmp_path / "events"))
    return S.read_events(spark, str(tmp_path / "events"), t.schema)


def test_tumbling(spark, tmp_path):
    got = drained(spark, S.tumbling(stream(spark, tmp_path)), "tumbling", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, q_calls.tumbling(spark, DATA).collect()))


def test_duplicates(spark, tmp_path):
    e = stream(spark, tmp_path)
    got = drained(spark, S.distinct_events(e.union(e), ["event_id"]), "distinct_events", "append")
    assert got.count() == got.distinct().count() == 1000


def test_stateful_runs(spark, tmp_path):
    got = {r.user_id: r.longest for r in drained(spark, S.type_runs(stream(spark, tmp_path)), "type_runs", "update").collect()}
    assert got == {r.user_id: r.n for r in q_reads.largest_block(spark, DATA).collect()}
