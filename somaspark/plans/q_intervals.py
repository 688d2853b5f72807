"""Queries over interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaspark.fixtures import ctes, view
from somaspark.operators import intervals as I  # noqa: E741

from .registry import Registry

q = Registry()
IV, BOTH = ctes("iv"), ctes("iv", "jv")
MEET = "iv.contig = jv.contig AND iv.s - {k} < jv.e AND jv.s < iv.e + {k}"


@q("q_scan_bed", IV + " SELECT id, contig, least(a, b) AS s, greatest(a, b) AS e FROM (SELECT id, contig, CASE WHEN id%4=0 THEN e ELSE s END AS a, CASE WHEN id%4=0 THEN s ELSE e END AS b FROM iv)")
def scan_bed(spark, d):
    df = view(spark, d, "iv")
    flipped = F.col("id") % 4 == 0
    return I.normalised(df.select("id", "contig", F.when(flipped, F.col("e")).otherwise(F.col("s")).alias("s"), F.when(flipped, F.col("s")).otherwise(F.col("e")).alias("e")))


@q("q_tile_windows", IV + """ SELECT id, tile, CAST(s + 16*tile AS INT) AS tile_s, CAST(CASE WHEN tile = n-1 THEN e ELSE s + 16*(tile+1) END AS INT) AS tile_e
FROM (SELECT *, unnest(generate_series(0, n-1)) AS tile FROM (SELECT *, greatest(1, (e-s)//16) AS n FROM iv))""")
def tile_windows(spark, d):
    return I.tile(view(spark, d, "iv"), 16).select("id", F.col("tile").cast("long").alias("tile"), "tile_s", "tile_e")


@q("q_interval_contained", BOTH + " SELECT iv.id AS a, jv.id AS b FROM iv JOIN jv ON iv.contig = jv.contig AND iv.s >= jv.s AND iv.e <= jv.e")
def interval_contained(spark, d):
    return I.range_join(view(spark, d, "iv"), view(spark, d, "jv")).where("s >= r_s and e <= r_e").select(F.col("id").alias("a"), F.col("r_id").alias("b"))


@q("q_interval_near_edge", BOTH + f" SELECT iv.id AS a, jv.id AS b, abs(iv.s-jv.s) <= 3 AS at_start, abs(iv.e-jv.e) <= 3 AS at_end FROM iv JOIN jv ON {MEET.format(k=0)}")
def interval_near_edge(spark, d):
    df = I.range_join(view(spark, d, "iv"), view(spark, d, "jv"))
    df = df.select("id", "r_id", F.struct("contig", "s", "e").alias("x"), F.struct(F.col("r_contig").alias("contig"), F.col("r_s").alias("s"), F.col("r_e").alias("e")).alias("y"))
    return df.select(F.col("id").alias("a"), F.col("r_id").alias("b"), I.near_start("x", "y", 3).alias("at_start"), I.near_end("x", "y", 3).alias("at_end"))


@q("q_interval_intersect", BOTH + f" SELECT iv.id AS a, jv.id AS b, least(iv.e, jv.e) - greatest(iv.s, jv.s) AS shared FROM iv JOIN jv ON {MEET.format(k=0)}")
def interval_intersect(spark, d):
    return I.clip(view(spark, d, "iv"), view(spark, d, "jv")).select(F.col("id").alias("a"), F.col("r_id").alias("b"), (F.col("ce") - F.col("cs")).alias("shared"))


@q("q_interval_clip", BOTH + f" SELECT iv.id AS id, iv.contig AS contig, greatest(iv.s, jv.s) AS s, least(iv.e, jv.e) AS e FROM iv JOIN jv ON {MEET.format(k=0)}")
def interval_clip(spark, d):
    return I.clip(view(spark, d, "iv"), view(spark, d, "jv")).select("id", "contig", F.col("cs").alias("s"), F.col("ce").alias("e"))


@q("q_interval_semi", BOTH + f" SELECT * FROM iv WHERE EXISTS (SELECT 1 FROM jv WHERE {MEET.format(k=0)})")
def interval_semi(spark, d):
    return I.range_semi(view(spark, d, "iv"), view(spark, d, "jv"))


@q("q_window_inner", BOTH + f" SELECT iv.id AS a, jv.id AS b FROM iv JOIN jv ON {MEET.format(k=5)}")
def window_inner(spark, d):
    return I.range_join(view(spark, d, "iv"), view(spark, d, "jv"), pad=5).select(F.col("id").alias("a"), F.col("r_id").alias("b"))


@q("q_window_semi", BOTH + f" SELECT * FROM iv WHERE EXISTS (SELECT 1 FROM jv WHERE {MEET.format(k=5)})")
def window_semi(spark, d):
    return I.range_semi(view(spark, d, "iv"), view(spark, d, "jv"), pad=5)


@q("q_window_anti", BOTH + f" SELECT * FROM iv WHERE NOT EXISTS (SELECT 1 FROM jv WHERE {MEET.format(k=5)})")
def window_anti(spark, d):
    return I.range_anti(view(spark, d, "iv"), view(spark, d, "jv"), pad=5)


@q("q_region_reads", ctes("reads", "jv") + " SELECT jv.id AS region, count(*) AS n, CAST(sum(mapq) AS BIGINT) AS mapq FROM reads JOIN jv ON reads.contig = jv.contig AND reads.s < jv.e AND jv.s <= reads.e WHERE mapq >= 20 AND NOT is_dup GROUP BY 1")
def region_reads(spark, d):
    """The reader's overlap takes the right end in."""
    reads = view(spark, d, "reads").where("mapq >= 20 and not is_dup").select("contig", "s", (F.col("e") + 1).alias("e"), "mapq")
    return I.range_join(reads, view(spark, d, "jv")).groupBy(F.col("r_id").alias("region")).agg(F.count("*").alias("n"), F.sum("mapq").alias("mapq"))


@q("q_interval_slop", IV + " SELECT id, greatest(0, s-50) AS s, least(e+50, 99000) AS e FROM iv")
def interval_slop(spark, d):
    return I.slop(view(spark, d, "iv"), 50, F.lit(99000)).select("id", "s", "e")


_ISL = """, o AS (SELECT contig, s, e, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {k} THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT contig, min(s) AS s, max(e) AS e{n} FROM i GROUP BY contig, g"""


@q("q_interval_reduce", IV + _ISL.format(t="iv", k=0, n=""))
def interval_reduce(spark, d):
    return I.merge(view(spark, d, "iv")).select("contig", "s", "e")


@q("q_interval_merge_d", IV + _ISL.format(t="iv", k=100, n=""))
def interval_merge_d(spark, d):
    return I.merge(view(spark, d, "iv"), 100).select("contig", "s", "e")


@q("q_interval_merge_count", IV + _ISL.format(t="iv", k=0, n=", count(*) AS n"))
def interval_merge_count(spark, d):
    return I.merge(view(spark, d, "iv"))


@q("q_interval_union_merge", BOTH + ", u AS (SELECT contig, s, e FROM iv UNION ALL SELECT contig, s, e FROM jv)" + _ISL.format(t="u", k=0, n=""))
def interval_union_merge(spark, d):
    cols = ["contig", "s", "e"]
    return I.merge(view(spark, d, "iv").select(*cols).union(view(spark, d, "jv").select(*cols))).select(*cols)


@q("q_interval_coverage", IV + """, p AS (SELECT contig, p, sum(d) AS d FROM (SELECT contig, s AS p, 1 AS d FROM iv UNION ALL SELECT contig, e, -1 FROM iv) GROUP BY 1, 2),
w AS (SELECT contig, p AS s, lead(p) OVER o AS e, CAST(sum(d) OVER o AS BIGINT) AS depth FROM p WINDOW o AS (PARTITION BY contig ORDER BY p ROWS UNBOUNDED PRECEDING))
SELECT w.contig, w.s, (SELECT min(p.p) FROM p WHERE p.contig = w.contig AND p.p > w.s) AS e, depth FROM w WHERE depth > 0""")
def interval_coverage(spark, d):
    return I.coverage(view(spark, d, "iv"))


@q("q_interval_disjoint", IV + """, p AS (SELECT contig, s AS p FROM iv UNION SELECT contig, e FROM iv),
w AS (SELECT contig, p AS s, lead(p) OVER (PARTITION BY contig ORDER BY p) AS e FROM p)
SELECT * FROM w WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM iv WHERE iv.contig = w.contig AND iv.s < w.e AND w.s < iv.e)""")
def interval_disjoint(spark, d):
    return I.disjoint(view(spark, d, "iv"))


@q("q_region_total", IV + " SELECT CAST(sum(e-s+1) AS BIGINT) AS total FROM iv")
def region_total(spark, d):
    return I.total_length(view(spark, d, "iv"))


@q("q_split_regions", IV + _ISL.format(t="iv", k=0, n="").replace("SELECT contig, min(s)", ", m AS (SELECT contig, min(s)", 1) + """),
r AS (SELECT *, CAST(coalesce(sum(e-s) OVER (ORDER BY contig, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run, CAST(sum(e-s) OVER () AS BIGINT) AS total FROM m)
SELECT contig, s, e, CAST(least(9, (run*10)//total) AS INT) AS part FROM r""")
def split_regions(spark, d):
    return I.split_regions(view(spark, d, "iv"), 10)


CUT = """), x AS (SELECT contig, CAST(unnest(generate_series(s, e, 2000)) AS INT) AS p, s, e FROM m),
y AS (SELECT contig, p AS s, CASE WHEN e - s + 1 > 2000 THEN least(e, p + 1999) ELSE e END AS e FROM x WHERE e - s + 1 > 2000 OR p = s),
z AS (SELECT *, CAST(sum(e - s + 1) OVER (ORDER BY contig, s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c1, c1 - (e - s + 1) AS c0 FROM y),
cuts AS (SELECT 0 AS k, 0::BIGINT AS lo, (SELECT max(c1) FROM z) // 10 AS want, (SELECT max(c1) FROM z) AS total UNION ALL
SELECT k + 1, hi, CASE WHEN want < total - hi AND total - hi < 1.5 * want THEN total - hi ELSE want END, total
FROM (SELECT k, want, total, CASE WHEN c1 - b < 40 THEN c1 ELSE b END AS hi FROM (SELECT *, CASE WHEN a - greatest(c0, lo) < 40 THEN least(greatest(c0, lo) + 40, c1) ELSE a END AS b
FROM (SELECT *, lo + want AS a FROM cuts) JOIN z ON c0 < a AND a <= c1))),
w AS (SELECT k, lo, lead(lo, 1, total) OVER (ORDER BY k) AS hi FROM cuts)
SELECT contig, CAST(s + greatest(lo, c0) - c0 AS INT) AS s, CAST(s + least(hi, c1) - c0 - 1 AS INT) AS e, k AS part FROM z JOIN w ON lo < c1 AND hi > c0"""


@q("q_cut_regions", IV.replace("WITH", "WITH RECURSIVE", 1) + _ISL.format(t="iv", k=0, n="").replace("SELECT contig, min(s)", ", m AS (SELECT contig, min(s)", 1) + CUT)
def cut_regions(spark, d):
    return I.cut_regions(view(spark, d, "iv"), 10, longest=2000)


@q("q_region_string", IV + " SELECT id, concat(contig, ':', s, '-', e) AS region FROM iv")
def region_string(spark, d):
    """F21."""
    return view(spark, d, "iv").select("id", F.format_string("%d:%d-%d", "contig", "s", "e").alias("region"))
