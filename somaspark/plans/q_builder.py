"""Queries over whole feature tensors and the tables they are kept in."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaspark.fixtures import ctes, view
from somaspark.operators import network as N
from somaspark.operators import tensor_builder as B
from somaspark.sources import candidates as C

from .registry import Registry

q = Registry()
MIN_COV = 3  # the made-up bases are thin
TAGS = {"nm": "bq%7", "as_": "(bq*3)%100", "xs": "(bq*2)%90", "pr": "mapq%3", "cl": "bq%2"}


def made(spark, d, insertions: bool, then=None):
    """Tensors of all candidates, or what ``then`` makes of them; with ``insertions``, a third of the alternative bases is moved to inserted columns."""
    ins = "case when code<>refcode and (bq+mapq)%3=0 then 1+bq%4 else 0 end" if insertions else "0"
    bases = view(spark, d, "bases").selectExpr("*", f"cast({ins} as int) as ins", *[f"{x} as {c}" for c, x in TAGS.items()])
    bases = bases.withColumn("refcode", F.when(F.col("ins") > 0, 0).otherwise(F.col("refcode")))
    reference = spark.range(22 * 2010).selectExpr("cast(id%22 as int) as contig", "cast(id div 22 as int) as pos", "cast(1+(id div 22)%4 as int) as code")
    return B.tensors(view(spark, d, "preds"), B.cells(bases), reference, min_cov=MIN_COV, then=then)


# without inserted columns no column goes, so that plain SQL gives coverage, centre and the count channels
SUMS = ", ".join(f"CAST(sum(CASE WHEN {s}n IS NULL THEN CASE WHEN code = 0 THEN floor({s}top / ({s}peak + 0.00001) * 255) ELSE 0 END ELSE floor({s}v / ({s}peak + 0.00001) * 255) END) AS BIGINT) AS {c}" for s, c in (("t", "tumor_bytes"), ("n", "normal_bytes")))
SQL = (
    ctes("preds", "bases")
    + ", c AS (SELECT contig, pos, sample, code, count(*) AS v FROM bases GROUP BY ALL), d AS (SELECT contig, pos, sample, sum(v) AS n FROM c GROUP BY ALL)"
    + ", sp AS (SELECT id, contig, pos, unnest(range(greatest(1, pos-7), pos+8)) AS pl FROM preds)"
    + ", w AS (SELECT id, pl, k AS code, coalesce(t.v, 0) AS tv, coalesce(n.v, 0) AS nv, td.n AS tn, nd.n AS nn FROM sp, range(0, 5) r(k)"
    + "".join(f" LEFT JOIN c {s} ON {s}.contig = sp.contig AND {s}.pos = pl AND {s}.code = k AND {s}.sample = '{n}' LEFT JOIN d {s}d ON {s}d.contig = sp.contig AND {s}d.pos = pl AND {s}d.sample = '{n}'" for s, n in (("t", "tumor"), ("n", "normal")))
    + "), m AS (SELECT id, max(tn) AS ttop, coalesce(max(nn), max(tn)) AS ntop, CASE WHEN count(tn) < count(*) THEN max(tn) ELSE max(tv) END AS tpeak, CASE WHEN count(nn) < count(*) THEN coalesce(max(nn), max(tn)) ELSE max(nv) END AS npeak, min(pl) AS lo, count(DISTINCT pl) AS cols FROM w GROUP BY id)"
    + f" SELECT w.id, CAST(max(preds.pos - lo + (32 - cols) // 2) AS INT) AS centre, CAST(max(ttop) AS INT) AS tumor_cov, CAST(max(ntop) AS INT) AS normal_cov, {SUMS}"
    + f" FROM w JOIN m ON m.id = w.id JOIN preds ON preds.id = w.id WHERE ttop >= {MIN_COV} GROUP BY w.id"
)


@q("q_tensor", SQL)
def tensor(spark, d):
    """All candidates; the sums of the count channels stand for the tensor."""
    return made(spark, d, False, lambda df: B.channel_sums(df, {"tumor_bytes": 1, "normal_bytes": 2}))


@q("q_tensor_insertions")
def tensor_insertions(spark, d):
    """With inserted columns, as a digest of all bytes."""
    return made(spark, d, True, lambda df: df.select("id", "centre", "tumor_cov", "normal_cov", F.md5("tensor").alias("digest")))


@q("q_tensor_scored")
def tensor_scored(spark, d):
    """N1 on real tensors: from bases to the network's output."""
    weights = N.random_weights(B.CHANNELS + 3)
    return made(spark, d, True, lambda df: N.scored(B.network_input(df), weights, B.CHANNELS + 3)).select("id", "p_type", "place", "p_len")


GAPPED = [
    "concat(substring(seq, 1, cast(10+start%7 as int)), '--', substring(seq, cast(11+start%7 as int))) as reference",
    "concat(repeat('-', cast(start%11 as int)), substring(seq, cast(1+start%11 as int), cast(50-start%11-contig as int)), repeat('-', cast(length(seq)-48+contig as int))) as read",
    "start as region_start", "start+length(seq)-1 as region_end", "start+contig%5 as pos_start", "start+40+contig as pos_end",
]


@q(
    "q_excess_ends",
    ctes("refseq") + f", g AS (SELECT contig, start, {', '.join(GAPPED)} FROM refseq), c AS (SELECT *, unnest(range(1, length(reference) + 1)) AS i FROM g)"
    ", k AS (SELECT contig, start, i, substring(reference, i::INT, 1) <> '-' AS r, substring(read, i::INT, 1) NOT IN ('-', '') AS b FROM c)"
    ", p AS (SELECT *, sum(r::INT) OVER (PARTITION BY contig, start ORDER BY i) - 1 AS j FROM k)"
    ", e AS (SELECT contig, start, min(j) FILTER (r AND b) AS lo, max(j) FILTER (r AND b) AS hi, max(j) AS last FROM p GROUP BY ALL)"
    " SELECT contig, start, CAST(pos_start - region_start - coalesce(lo, 0) AS INT) AS excess_start, CAST(region_end - pos_end - coalesce(last - hi, 0) AS INT) AS excess_end FROM g JOIN e USING (contig, start)",
)
def excess_ends(spark, d):
    """Made-up alignments of the reference's own pieces."""
    df = view(spark, d, "refseq").selectExpr("contig", "start", *GAPPED)
    return C.excess_ends(df).select("contig", "start", F.col("excess_start").cast("int"), F.col("excess_end").cast("int"))
