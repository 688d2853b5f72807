"""Members of large buckets meet the bucket's row without a join of all members."""

from somaspark.llm.common import hot_keys
from somaspark.llm.near_dedup import met


def test_large_buckets(spark):
    members = spark.range(5000).selectExpr("id as b", "if(id % 5 < 4, cast(7 as long), id) as bucket")
    buckets = spark.createDataFrame([(7, 0, 4000), (9, 9, 2), (14, 14, 2), (90_000, 1, 2)], "bucket long, a long, size long")
    hot = hot_keys(buckets, ["bucket"], "size", 4006)
    got = met(members, buckets, hot)
    assert [r.bucket for r in hot.collect()] == [7]
    assert sorted(got.select("bucket", "b", "a").collect()) == sorted(members.join(buckets, "bucket").select("bucket", "b", "a").collect()) and got.count() == 4002
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert met(members, buckets, hot.where("false")).count() == 4002
