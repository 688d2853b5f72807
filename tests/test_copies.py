"""Copies of variants: distinct variants meet, every copy has its result."""

import pytest
from pyspark.sql import functions as F

from somaspark.operators import calls as C
from somaspark.operators import intervals as I  # noqa: E741

KIND = "id long, contig int, pos int, ref string, alt string, prob double"
COPIES = 30


@pytest.fixture
def met(monkeypatch):
    """How many pairs each range join of the calls' operators makes."""
    seen, join = [], C.range_join

    def counted(*a, **k):
        df = join(*a, **k)
        seen.append(df.count())
        return df

    monkeypatch.setattr(C, "range_join", counted)
    return seen


def copied(spark, rows, first=0):
    return spark.createDataFrame([(first + i + 1000 * c, *r, c / 100) for c in range(COPIES) for i, r in enumerate(rows)], KIND)


CALLS = [(0, 100, "A", "C"), (0, 103, "AC", "A"), (0, 300, "A", "C"), (0, 500, "ACG", "A"), (1, 100, "A", "AC"), (1, 900, "A", None)]
TRUTH = [(0, 100, "A", "C"), (0, 102, "A", "AC"), (0, 501, "C", "G"), (1, 101, "A", "AG"), (1, 901, "A", "C")]


def near(a, b, pad):
    return a[0] == b[0] and a[1] - pad < b[1] + len(b[2]) and b[1] < a[1] + len(a[2]) + pad


def test_nearest_and_scores(spark, met):
    calls, truth = copied(spark, CALLS), copied(spark, TRUTH, 500_000)
    got = {r.id: (r.match_id, r.distance) for r in C.nearest(calls, truth).collect()}
    best = {0: (500_000, 0), 1: (500_001, 1), 3: (500_002, 1), 4: (500_003, 1), 5: (500_004, 1)}
    assert {i: m for i, m in got.items() if i % 1000 != 1} == {i + 1000 * c: m for c in range(COPIES) for i, m in best.items() if i != 1}
    scores = {r.id: r.score for r in C.resolved_scores(truth, calls).collect()}
    top = (COPIES - 1) / 100
    assert len(scores) == COPIES * len(TRUTH) and set(scores.values()) == {top}
    assert max(met) < len(CALLS) * len(TRUTH)


def test_pairs(spark, met):
    calls, truth = copied(spark, CALLS), copied(spark, TRUTH, 500_000)
    got = {(r.id, r.r_id) for r in C.truth_edges(calls, truth).collect()}
    of = [(i, j) for i, a in enumerate(CALLS) for j, b in enumerate(TRUTH) if near(a, b, 5)]
    assert got == {(i + 1000 * c, 500_000 + j + 1000 * d) for i, j in of for c in range(COPIES) for d in range(COPIES)}
    assert max(met) == len(of)
    kept = C.variant_pairs(calls, truth, 5, F.col("pos") == F.col("r_pos"))
    assert kept.count() == COPIES**2 and "r_prob" in kept.columns


def test_cascade(spark, met):
    rows = CALLS[:5] + [(2, 100, "AC", "A"), (2, 103, "A", "AT")]  # the last two: rule 4, if each is there once
    truth = copied(spark, [*TRUTH[:4], (2, 102, "G", "T")], 500_000)
    alone = {r.id: (r.label, r.rule) for r in C.label_cascade(copied(spark, rows).where("id < 1000"), truth).collect()}
    got = {r.id: (r.label, r.rule) for r in C.label_cascade(copied(spark, rows), truth).collect()}
    assert max(met) < len(rows) * 5 and len(got) == COPIES * len(rows) and alone[5][1] == alone[6][1] == 4
    for i, x in got.items():
        assert x == (alone[i % 1000] if i % 1000 < 5 else ("NONE", 8))


def test_clusters_of_copies(spark):
    """A stretch follows one entry a span, however many copies it has."""
    df = spark.range(20_000).selectExpr("id", "0 as contig", "cast(10 + id % 2 as int) as pos", "if(id % 3 = 0, 'ACGTACGT', 'A') as ref", "'A' as alt")
    got = C.cluster_calls_exact(df).groupBy("part").count().collect()
    assert sum(r["count"] for r in got) == 20_000


def test_equal_pairs_are_aligned_once(spark, monkeypatch):
    from somaspark.operators import network as N

    seen, align = [], N.aligned_reads
    monkeypatch.setattr(N, "aligned_reads", lambda df: (seen.append(df.count()), align(df))[1])
    reads = ["ACGTTTCATGAC", "ACGTCATGGAC", "ACGTCTGAC"]
    df = spark.createDataFrame([(i, n, "ACGTCATGAC", r) for i in range(200) for n, r in enumerate(reads)], "id long, n int, reference string, read string")
    got = {(r.id, r.n): (r.reference, r.read, r.cigar) for r in N.jointly_aligned(df).collect()}
    assert seen == [3] and len(got) == 600
    assert all(got[i, n] == got[0, n] for i in range(200) for n in range(3))
    assert [got[0, n][1].replace("-", "") for n in range(3)] == reads and len({got[0, n][0] for n in range(3)}) == 1


def test_intervals_of_one_place_meet_once(spark, monkeypatch):
    seen, meet = [], I._met

    def counted(*a):
        df = meet(*a)
        seen.append(df.count())
        return df

    monkeypatch.setattr(I, "_met", counted)
    places = {"a": [(0, 5, 20), (0, 15, 90), (1, 5, 20), (0, 200, 201)], "b": [(0, 18, 30), (0, 100, 150), (1, 0, 6)]}
    rows = {k: [(None if c == 1 else i + 100 * c, *x) for c in range(COPIES) for i, x in enumerate(v)] for k, v in places.items()}
    a, b = (spark.createDataFrame(rows[k], "id long, contig int, s int, e int") for k in "ab")
    want = sorted(((x[0], y[0]) for x in rows["a"] for y in rows["b"] if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]), key=repr)
    assert sorted(((r.id, r.r_id) for r in I.range_join(a, b).collect()), key=repr) == want
    assert seen == [3]
    assert sorted(((r.id, r.r_id) for r in I.range_join(a, b, copies=8).collect()), key=repr) == want
    assert seen == [3, 3 * 4 * 4]
    semi, anti = I.range_semi(a, b), I.range_anti(a, b)
    assert (semi.count(), anti.count()) == (3 * COPIES, COPIES) and seen[2:] == [3, 3]


def test_pairs_are_dealt_over_many_tasks(spark):
    """A few bytes in, many pairs out: no task holds a core's share of the pairs, whichever join it is."""
    df = spark.range(40_000).selectExpr("id", "cast(id % 4 as int) as contig", "cast(id % 4000 * 16 as int) as s", "cast(id % 4000 * 16 + 20 as int) as e")
    limit, key = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    try:
        for most in (limit, "-1"):
            spark.conf.set(key, most)
            made = I.range_join(df, df).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
            total = sum(r.n for r in made)
            assert total == 40_000 * 10 and max(r.n for r in made) < total / (4 * 4)
    finally:
        spark.conf.set(key, limit)
