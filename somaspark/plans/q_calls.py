"""Queries over calls: clusters, matches, labels, sets, training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaspark.fixtures import ctes, view
from somaspark.functions import variants as V
from somaspark.operators import calls as C
from somaspark.operators import haplotypes as H
from somaspark.operators.intervals import range_anti, range_semi
from somaspark.operators.stretches import kept, numbered

from .q_calling import PART_OF
from .q_calling import _lcp as lcp
from .registry import Registry

q = Registry()
P, T, PT = ctes("preds"), ctes("truth"), ctes("preds", "truth")
KIND = "CASE WHEN length({0}ref) > length({0}alt) THEN 'DEL' WHEN length({0}ref) < length({0}alt) THEN 'INS' ELSE 'SNP' END"
CL = P + """, o AS (SELECT *, pos AS s, pos + length(ref) AS e, max(pos + length(ref)) OVER (PARTITION BY contig ORDER BY pos, pos + length(ref) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM preds),
cl AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR s > reach + {k} THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM o)"""
NEAR = "p.contig = t.contig AND p.pos - 5 < t.pos + length(t.ref) AND t.pos < p.pos + length(p.ref) + 5"


@q("q_cluster_calls", CL.format(k=5) + " SELECT id, contig, cluster FROM cl")
def cluster_calls(spark, d):
    return C.cluster_calls(view(spark, d, "preds")).select("id", "contig", "cluster")


@q("q_cluster_exact", CL.format(k=5).replace("WITH ", "WITH RECURSIVE ", 1) + """, x AS (SELECT id, contig, cluster, s, e FROM cl),
ed AS (SELECT c.id AS c, m.id AS m FROM x AS c JOIN x AS m ON c.contig = m.contig AND (m.s, m.e, m.id) < (c.s, c.e, c.id) AND abs(least(c.e, m.e) - greatest(c.s, m.s)) <= 5),
r(id, f) AS (SELECT id, id FROM x WHERE id NOT IN (SELECT c FROM ed) UNION SELECT ed.c, r.f FROM r JOIN ed ON ed.m = r.id),
l AS (SELECT r.id, max((x.s, x.e, x.id)) AS opener FROM r JOIN x ON x.id = r.f GROUP BY r.id)
SELECT id, contig, cluster, CAST(dense_rank() OVER (PARTITION BY contig, cluster ORDER BY opener) - 1 AS INT) AS part FROM x JOIN l USING (id)""")
def cluster_exact(spark, d):
    return C.cluster_calls_exact(view(spark, d, "preds"))


@q("q_cluster_route", CL.format(k=5) + ", g AS (SELECT contig, cluster, count(*) AS n, max(abs(length(ref)-length(alt))) AS longest, min(s) AS s, max(e) AS e FROM cl GROUP BY 1, 2) SELECT contig, cluster, n, s, e, CASE WHEN (n > 1 AND longest > 0) OR (n = 1 AND longest >= 4) THEN 'resolve' ELSE 'pass' END AS route FROM g")
def cluster_route(spark, d):
    return C.cluster_routes(C.cluster_calls(view(spark, d, "preds"))).drop("longest")


@q("q_cluster_join", CL.format(k=5) + ", g AS (SELECT contig, cluster, max(prob) AS best FROM cl GROUP BY 1, 2) SELECT id, best FROM cl JOIN g USING (contig, cluster)")
def cluster_join(spark, d):
    """Target table and calls by cluster id."""
    c = C.cluster_calls(view(spark, d, "preds"))
    return c.join(c.groupBy("contig", "cluster").agg(F.max("prob").alias("best")), ["contig", "cluster"]).select("id", "best")


@q("q_variant_group", CL.format(k=0) + " SELECT contig, cluster, min(s) AS s, max(e) AS e, count(*) AS n, string_agg(pos || ref || '>' || alt, '|' ORDER BY pos, id) AS alleles FROM cl GROUP BY 1, 2")
def variant_group(spark, d):
    return C.variant_groups(view(spark, d, "preds"))


@q("q_modal_dels", ctes("reads") + ", n AS (SELECT contig, s//50 AS region, 1+l_suppkey%7 AS len, count(*) AS n FROM reads GROUP BY 1, 2, 3) SELECT * FROM n QUALIFY n > 0.5 * max(n) OVER (PARTITION BY contig, region)")
def modal_dels(spark, d):
    return C.modal(view(spark, d, "reads").selectExpr("contig", "s div 50 as region", "1+l_suppkey%7 as len"), ["contig", "region"], "len")


@q("q_modal_ins", ctes("reads") + ", n AS (SELECT contig, s//50 AS region, l_linenumber AS len, count(*) AS n FROM reads GROUP BY 1, 2, 3) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY contig, region ORDER BY n DESC, len) = 1")
def modal_ins(spark, d):
    return C.modal_one(view(spark, d, "reads").selectExpr("contig", "s div 50 as region", "l_linenumber as len"), ["contig", "region"], "len")


@q("q_topk_mean_af", P + ", x AS (SELECT contig, prob, row_number() OVER (PARTITION BY contig ORDER BY prob DESC) AS k, max(prob) OVER (PARTITION BY contig) AS m FROM preds) SELECT contig, CAST(count(*) AS INT) AS n, round(avg(prob), 6) AS mean FROM x WHERE k <= greatest(1, ceil(m*7)) GROUP BY 1")
def topk_mean_af(spark, d):
    return C.top_mean(view(spark, d, "preds"), ["contig"], "prob", 7).withColumn("mean", F.round("mean", 6))


@q("q_msa_consensus", ctes("bases") + """, n AS (SELECT contig, pos, refcode, code, count(*) AS n FROM bases GROUP BY ALL),
x AS (SELECT contig, pos, max((n, code)) FILTER (code <> refcode) AS best, coalesce(sum(n) FILTER (code = refcode), 0)::BIGINT AS ro FROM n GROUP BY contig, pos, refcode),
y AS (SELECT contig, pos, best[2] AS code, best[1] AS ao, ro, best[1] / (best[1] + ro + 0.0001) AS af FROM x WHERE best IS NOT NULL)
SELECT contig, pos, code, ao, ro, round(af, 4)::DOUBLE AS af FROM y QUALIFY af > 0.6 * max(af) OVER (PARTITION BY contig)""")
def msa_consensus(spark, d):
    """Each column's most frequent other code, where its fraction is above 0.6 of the contig's largest."""
    return C.consensus(view(spark, d, "bases")).withColumn("af", F.round("af", 4))


@q("q_msa_consensus_whole", q.sql["q_msa_consensus"])
def msa_consensus_whole(spark, d):
    return msa_consensus(spark, d)


@q("q_msa_consensus_region", ctes("bases") + """, n AS (SELECT contig, pos // 4 AS region, pos, refcode, code, count(*) AS n FROM bases GROUP BY ALL),
x AS (SELECT contig, region, pos, max((n, code)) FILTER (code <> refcode) AS best, coalesce(sum(n) FILTER (code = refcode), 0)::BIGINT AS ro FROM n GROUP BY contig, region, pos, refcode),
y AS (SELECT contig, region, pos, best[2] AS code, best[1] AS ao, ro, best[1] / (best[1] + ro + 0.0001) AS af FROM x WHERE best IS NOT NULL)
SELECT contig, CAST(region AS INT) AS region, pos, code, ao, ro, round(af, 4)::DOUBLE AS af FROM (SELECT *, max(af) OVER (PARTITION BY contig, region) AS top FROM y) WHERE af > 0.6 * top AND af > 0.7""")
def msa_consensus_region(spark, d):
    """A18 region by region, with the least fraction of an SNP."""
    bases = view(spark, d, "bases").withColumn("region", F.expr("cast(pos div 4 as int)"))
    return C.consensus(bases, keys=("contig", "region"), min_af=0.7).withColumn("af", F.round("af", 4))


@q("q_modal_insertions", ctes("reads") + """, n AS (SELECT contig, s // 50 AS region, CAST(s + l_quantity AS INT) AS pos, l_linenumber AS len, count(*) AS n FROM reads GROUP BY ALL),
t AS (SELECT *, first_value(pos) OVER w AS top_pos, first_value(n) OVER w AS top FROM n WINDOW w AS (PARTITION BY contig, region ORDER BY n DESC, pos, len))
SELECT contig, CAST(region AS BIGINT) AS region, pos, len, n FROM t WHERE 2 * n > top AND NOT (abs(pos - top_pos) BETWEEN 1 AND 3)""")
def modal_insertions(spark, d):
    """A region's frequent insertions, without those one to three bases beside the most frequent one."""
    ins = view(spark, d, "reads").selectExpr("contig", "s div 50 as region", "cast(s + l_quantity as int) as pos", "l_linenumber as len")
    return C.modal_insertions(ins, ["contig", "region"], "len")


def _common(a: str, b: str, back: bool = False) -> str:
    """Length of the common prefix, or suffix, of two texts."""
    at = (lambda x: f"substring({x}, length({x}) - i::INT, 1)") if back else (lambda x: f"substring({x}, i::INT + 1, 1)")
    return f"coalesce((SELECT min(i) FROM range(0, least(length({a}), length({b}))) nn(i) WHERE {at(a)} <> {at(b)}), least(length({a}), length({b})))"


@q("q_group_haplotypes", ctes("phased").replace("WITH ", "WITH RECURSIVE ", 1) + f""", d AS (SELECT DISTINCT sample, contig, s, e, alt FROM phased),
o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
cl AS MATERIALIZED (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM o),
sp AS MATERIALIZED (SELECT contig, "group", min(s) AS s, max(e) AS e FROM cl GROUP BY 1, 2),
pl AS (SELECT contig, "group", s, e, unnest(range((s - 1) // 64, (e + 62) // 64)) * 64 AS start FROM sp),
sq AS MATERIALIZED (SELECT contig, "group", s, e, substring(string_agg(coalesce(seq, repeat('N', 64)), '' ORDER BY start), s - (s - 1) // 64 * 64, e - s) AS ref FROM pl LEFT JOIN genome USING (contig, start) GROUP BY 1, 2, 3, 4),
st AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY contig, "group", sample ORDER BY s, e, alt) AS rn FROM cl),
w AS (SELECT contig, "group", sample, 0::BIGINT AS rn, sq.s AS s0, sq.s AS cur, '' AS made, 0 AS skipped, ref FROM sq JOIN (SELECT DISTINCT contig, "group", sample FROM st) USING (contig, "group")
UNION ALL SELECT w.contig, w."group", w.sample, st.rn, s0, CASE WHEN st.s < cur THEN cur ELSE st.e END, CASE WHEN st.s < cur THEN made ELSE made || substring(ref, cur - s0 + 1, st.s - cur) || st.alt END, skipped + (st.s < cur)::INT, ref
FROM w JOIN st ON st.contig = w.contig AND st."group" = w."group" AND st.sample = w.sample AND st.rn = w.rn + 1),
l AS (SELECT contig, "group", sample, ref, made || substring(ref, cur - s0 + 1) AS alt, skipped FROM w QUALIFY row_number() OVER (PARTITION BY contig, "group", sample ORDER BY rn DESC) = 1),
a AS (SELECT contig, "group", alt, count(*) AS n, CAST(row_number() OVER (PARTITION BY contig, "group" ORDER BY min(sample)) - 1 AS INT) AS allele FROM l GROUP BY 1, 2, 3),
f AS (SELECT *, {_common('ref', 'alt')} AS pre FROM l JOIN a USING (contig, "group", alt) JOIN (SELECT contig, "group", s, e FROM sp) USING (contig, "group")),
g AS (SELECT *, greatest(CASE WHEN length(ref) = length(alt) THEN least(pre, length(ref) - 1) ELSE pre - 1 END, 0)::INT AS front FROM f),
h AS (SELECT *, substring(ref, front + 1) AS r, substring(alt, front + 1) AS x FROM g), b AS (SELECT *, greatest(least({_common('r', 'x', True)}, least(length(r), length(x)) - 1), 0)::INT AS back FROM h)
SELECT contig, "group", s, e, sample, ref, alt, allele, n, skipped, CAST(s + front AS INT) AS pos, substring(r, 1, length(r) - back) AS short_ref, substring(x, 1, length(x) - back) AS short_alt FROM b""")
def group_haplotypes(spark, d):
    """Each sample's haplotype of each group of touching variants, across the reference's chunks."""
    genome = kept(view(spark, d, "genome"))
    return H.group_haplotypes(view(spark, d, "phased", genome=genome), genome)


@q("q_nearest_annot", PT + f" SELECT p.id AS id, t.id AS match_id, abs(p.pos-t.pos) AS distance FROM preds p JOIN truth t ON {NEAR} QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY NOT (p.pos = t.pos AND p.ref = t.ref AND p.alt = t.alt), {KIND.format('p.')} <> {KIND.format('t.')}, abs(p.pos-t.pos), abs(length(p.ref)-length(p.alt)-length(t.ref)+length(t.alt)), t.id) = 1")
def nearest_annot(spark, d):
    return C.nearest(view(spark, d, "preds"), view(spark, d, "truth"))


@q("q_resolve_scores", PT + f", b AS (SELECT t.id AS id, p.prob AS score FROM truth t JOIN preds p ON {NEAR.replace('p.pos - 5 <', 'p.pos <').replace('length(p.ref) + 5', 'length(p.ref)').replace('t.pos <', 't.pos - 5 <').replace('length(t.ref) AND', 'length(t.ref) + 5 AND')} QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY abs(length(t.ref)-length(t.alt)-length(p.ref)+length(p.alt)), abs(p.pos-t.pos), p.prob DESC) = 1) SELECT truth.id AS id, coalesce(score, 0.5) AS score FROM truth LEFT JOIN b USING (id)")
def resolve_scores(spark, d):
    return C.resolved_scores(view(spark, d, "truth"), view(spark, d, "preds"))


@q("q_ensemble_match", PT + f", m AS (SELECT p.id AS id, max(t.prob) AS prob FROM preds p JOIN truth t ON p.contig = t.contig AND p.pos = t.pos AND ((p.ref = t.ref AND p.alt = t.alt) OR ({KIND.format('p.')} = 'DEL' AND {KIND.format('t.')} = 'DEL' AND p.alt = t.alt AND (starts_with(p.ref, t.ref) OR starts_with(t.ref, p.ref))) OR ({KIND.format('p.')} = 'INS' AND {KIND.format('t.')} = 'INS' AND p.ref = t.ref AND (starts_with(p.alt, t.alt) OR starts_with(t.alt, p.alt)))) GROUP BY 1) SELECT preds.id AS id, coalesce(m.prob, 0.0)::DOUBLE AS prob FROM preds LEFT JOIN m ON m.id = preds.id")
def ensemble_match(spark, d):
    return C.ensemble_match(view(spark, d, "preds"), view(spark, d, "truth"), "prob")


@q("q_truth_edges", PT + f" SELECT p.id AS a, t.id AS b FROM preds p JOIN truth t ON {NEAR}")
def truth_edges(spark, d):
    return C.truth_edges(view(spark, d, "preds"), view(spark, d, "truth")).select(F.col("id").alias("a"), F.col("r_id").alias("b"))


SIDE = "SELECT id, contig, pos, ref, alt, " + KIND.format("") + " AS k, CASE WHEN length(ref) = length(alt) THEN 0 ELSE " + lcp("ref", "alt") + " END AS c FROM {}"
CASCADE = PT + f""", p AS ({SIDE.format('preds')}), t AS ({SIDE.format('truth')}),
e AS MATERIALIZED (SELECT p.* EXCLUDE (contig), t.id AS tid, t.pos AS tpos, t.ref AS tref, t.alt AS talt, t.k AS tk, t.c AS tc FROM p JOIN t ON {NEAR}),
g1 AS MATERIALIZED (SELECT id, any_value(k) AS label, 1 AS rule FROM e WHERE pos = tpos AND ref = tref AND alt = talt GROUP BY id),
o AS MATERIALIZED (SELECT * FROM e WHERE id NOT IN (SELECT id FROM g1)),
b3 AS MATERIALIZED (SELECT id, arg_min(tk, (tpos, tid)) AS label, 3 AS rule FROM o WHERE {PART_OF.format(a='t', b='')} GROUP BY id),
x AS (SELECT e.tid, e.id, pos, ref, k, label FROM e JOIN g1 USING (id)),
c3 AS (SELECT o.id, arg_min(x.label, (x.pos, x.id)) AS label, 3 AS rule FROM o JOIN x ON o.tid = x.tid WHERE o.id NOT IN (SELECT id FROM b3) AND {PART_OF.format(a='x.', b='o.')} GROUP BY o.id),
g3 AS MATERIALIZED (SELECT * FROM g1 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM c3),
n AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (k = 'DEL') OVER w AS dels, count(*) FILTER (k = 'INS') OVER w AS inss FROM e WINDOW w AS (PARTITION BY tid)),
r4 AS MATERIALIZED (SELECT * FROM n WHERE tid NOT IN (SELECT tid FROM e JOIN g3 USING (id))),
g4 AS MATERIALIZED (SELECT id, min(k) AS label, 4 AS rule FROM r4 WHERE tk = 'SNP' AND n = 2 AND dels = 1 AND inss = 1 GROUP BY id),
r5 AS MATERIALIZED (SELECT * FROM r4 WHERE tid NOT IN (SELECT tid FROM r4 JOIN g4 USING (id))),
g5 AS MATERIALIZED (SELECT id, min(tk) AS label, 5 AS rule FROM r5 WHERE k = tk AND pos = tpos GROUP BY id),
r6 AS MATERIALIZED (SELECT * FROM r5 WHERE tid NOT IN (SELECT tid FROM r5 JOIN g5 USING (id))),
g6 AS MATERIALIZED (SELECT id, min(tk) AS label, 6 AS rule FROM r6 WHERE pos + c = tpos + tc AND k || tk IN ('INSSNP', 'SNPINS') GROUP BY id),
r7 AS MATERIALIZED (SELECT * FROM r6 WHERE tid NOT IN (SELECT tid FROM r6 JOIN g6 USING (id))),
g7 AS (SELECT id, min(tk) AS label, 7 AS rule FROM r7 WHERE k = tk AND k <> 'SNP' AND abs(pos - tpos) < 2 GROUP BY id),
g AS (SELECT * FROM g3 UNION ALL SELECT * FROM g4 UNION ALL SELECT * FROM g5 UNION ALL SELECT * FROM g6 UNION ALL SELECT * FROM g7)
SELECT preds.id AS id, coalesce(label, 'NONE') AS label, coalesce(rule, 8) AS rule FROM preds LEFT JOIN g ON g.id = preds.id"""


@q("q_label_cascade", CASCADE)
def label_cascade(spark, d):
    """L1 and L3 to L8 on the variants as they are written."""
    return C.label_cascade(view(spark, d, "preds"), view(spark, d, "truth"))


@q("q_label_cascade_whole")
def label_cascade_whole(spark, d):
    """L1-L8, with the merged and shifted forms of L2 and L3 over the reference."""
    return C.label_cascade(view(spark, d, "preds"), view(spark, d, "truth"), view(spark, d, "refseq"))


def _moved(t: str, a: str = "") -> str:
    """The shifts of a table's indels, whose one allele is a single base, within [lo, hi): first, last."""
    ev = f"substring(CASE WHEN length({a}ref) > 1 THEN {a}ref ELSE {a}alt END, 2)"
    left, right = f"(substring(seq, 1, {a}pos - start) || ev)", f"(ev || substring(seq, ({a}pos + length({a}ref) - start)::INT))"
    back = f"(SELECT min(i) FROM range(0, 64) r(i) WHERE {a}pos - start - i < 1 OR substring({left}, ({a}pos - start + length(ev) - i)::INT, 1) <> substring({left}, ({a}pos - start - i)::INT, 1))"
    on = f"(SELECT min(i) FROM range(0, 64) r(i) WHERE substring({right}, (i + 1)::INT, 1) <> substring({right}, (i + 1 + length(ev))::INT, 1))"
    return f"SELECT *, CASE WHEN ev <> '' THEN {a}pos - least({a}pos - lo, {back}) ELSE {a}pos END AS first, CASE WHEN ev <> '' THEN {a}pos + least(hi - 1 - {a}pos, {on}) ELSE {a}pos END AS last FROM (SELECT *, CASE WHEN length({a}ref) = length({a}alt) THEN '' ELSE {ev} END AS ev FROM {t} JOIN (SELECT contig AS gc, start, seq FROM genome) ON gc = contig AND start = ({a}pos - 1) // 64 * 64)"


WITHIN = "CASE WHEN {a}k = 'SNP' AND {b}k = 'DEL' THEN {b}pos < {a}pos AND {a}pos < {b}pos + length({b}ref) WHEN {a}k = 'DEL' AND {b}k = 'SNP' THEN least(first, {a}pos) < {b}pos AND {b}pos < {hi} WHEN {a}k = {b}k THEN {a}pos = {b}pos OR {b}pos BETWEEN first AND last OR ({a}k = 'DEL' AND length({a}ref) > 1 AND length({b}ref) > 1 AND least(first, {a}pos) + 1 < {b}pos + length({b}ref) AND {b}pos + 1 < {hi}) ELSE FALSE END"


def _within(a: str, b: str) -> str:
    return WITHIN.format(a=a, b=b, hi=f"greatest(last + greatest(length({a}ref) - length({a}alt) + 1, 1), {a}pos + length({a}ref))")


RULES = (ctes("sparse_calls", "sparse_truth", "genome") + f""", p AS ({SIDE.format('sparse_calls')}), t AS ({SIDE.format('sparse_truth')}),
e AS MATERIALIZED (SELECT p.*, t.id AS tid, t.pos AS tpos, t.ref AS tref, t.alt AS talt, t.k AS tk, t.c AS tc FROM p JOIN t ON {NEAR}),
g1 AS MATERIALIZED (SELECT id, any_value(k) AS label, 1 AS rule FROM e WHERE pos = tpos AND ref = tref AND alt = talt GROUP BY id),
op AS MATERIALIZED (SELECT * FROM e WHERE tid NOT IN (SELECT tid FROM e JOIN g1 USING (id))),
gm AS (SELECT tid AS g, 0 AS side, contig, id, pos, ref, alt FROM op UNION SELECT op.tid, 1, e.contig, e.tid, e.tpos, e.tref, e.talt FROM op JOIN e USING (id)),
gs AS MATERIALIZED (SELECT gm.*, start, seq, row_number() OVER (PARTITION BY g, side ORDER BY pos, id) AS rn FROM gm JOIN genome ON genome.contig = gm.contig AND start = (pos - 1) // 64 * 64),
run AS (SELECT g, side, seq, start, pos AS p0, id AS id0, rn, pos + length(ref) AS cur, substring(seq, 1, pos - start - 1) || alt AS made, [id] AS ids FROM gs
UNION ALL SELECT r.g, r.side, r.seq, r.start, p0, id0, s.rn, s.pos + length(s.ref), made || CASE WHEN s.pos >= cur THEN substring(r.seq, cur - r.start, s.pos - cur) || s.alt ELSE substring(s.alt, 2) END, list_append(ids, s.id)
FROM run r JOIN gs s ON s.g = r.g AND s.side = r.side AND s.rn = r.rn + 1 AND s.pos >= cur - (length(s.ref) <> length(s.alt))::INT),
made AS MATERIALIZED (SELECT g, side, p0, id0, len(ids) AS n, ids, made || substring(seq, cur - start) AS made FROM run),
hit AS MATERIALIZED (SELECT c.g, c.ids, row_number() OVER (PARTITION BY c.g ORDER BY min((t.p0, t.id0, t.n)), c.p0, c.id0, c.n) AS k FROM made c JOIN made t ON c.g = t.g AND c.made = t.made AND c.side = 0 AND t.side = 1 GROUP BY c.g, c.ids, c.p0, c.id0, c.n),
pick AS (SELECT DISTINCT g, 0::BIGINT AS k, []::BIGINT[] AS ids FROM hit UNION ALL SELECT pick.g, hit.k, CASE WHEN list_has_any(pick.ids, hit.ids) THEN pick.ids ELSE list_concat(pick.ids, hit.ids) END FROM pick JOIN hit ON hit.g = pick.g AND hit.k = pick.k + 1),
here AS (SELECT g, arg_max(ids, k) AS ids FROM pick GROUP BY g),
turn AS MATERIALIZED (SELECT here.ids, js, contig, site, row_number() OVER (PARTITION BY contig, site ORDER BY f, tp, g) AS k FROM here JOIN (SELECT tid AS g, any_value(contig) AS contig, any_value((tpos - 1) // 64) AS site, any_value(tpos) AS tp, min((pos, id)) AS f, list(id) AS js FROM op GROUP BY tid) USING (g)),
done AS (SELECT DISTINCT contig, site, 0::BIGINT AS k, []::BIGINT[] AS ids FROM turn UNION ALL SELECT d.contig, d.site, t.k, CASE WHEN list_has_any(d.ids, t.js) THEN d.ids ELSE list_concat(d.ids, t.ids) END FROM done d JOIN turn t ON t.contig = d.contig AND t.site = d.site AND t.k = d.k + 1),
g2 AS MATERIALIZED (SELECT DISTINCT e.id, e.k AS label, 2 AS rule FROM e WHERE id IN (SELECT unnest(ids) FROM done) AND id NOT IN (SELECT id FROM g1)),
gp AS MATERIALIZED (SELECT * FROM g1 UNION ALL SELECT * FROM g2),
hu AS MATERIALIZED (SELECT tid, any_value(contig) AS contig, any_value(tpos) AS tpos, any_value(tref) AS tref, any_value(talt) AS talt, least(min(pos), any_value(tpos)) AS lo, greatest(max(pos + length(ref)), any_value(tpos + length(tref))) AS hi FROM e GROUP BY tid),
ts AS MATERIALIZED (SELECT tid, first, last FROM ({_moved('hu', 't')})),
o AS MATERIALIZED (SELECT e.*, first, last FROM e JOIN ts USING (tid) WHERE id NOT IN (SELECT id FROM gp)),
b3 AS MATERIALIZED (SELECT id, arg_min(tk, (tpos, tid)) AS label, 3 AS rule FROM o WHERE {_within('t', '')} GROUP BY id),
pc AS MATERIALIZED (SELECT e.id, any_value(e.contig) AS contig, any_value(pos) AS pos, any_value(ref) AS ref, any_value(alt) AS alt, any_value(k) AS k, any_value(label) AS label, min(lo) AS lo, max(hi) AS hi FROM e JOIN gp USING (id) JOIN hu USING (tid) GROUP BY e.id),
x AS (SELECT e.tid, m.id AS xid, m.pos AS xpos, m.ref AS xref, m.alt AS xalt, m.k AS xk, m.label, first, last FROM ({_moved('pc')}) m JOIN e USING (id)),
c3 AS (SELECT o.id, arg_min(x.label, (xpos, xid)) AS label, 3 AS rule FROM o JOIN x ON o.tid = x.tid WHERE o.id NOT IN (SELECT id FROM b3) AND {_within('x', 'o.').replace('first', 'x.first').replace('last', 'x.last')} GROUP BY o.id),
g3 AS MATERIALIZED (SELECT * FROM gp UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM c3),
n AS""" + CASCADE.split("\nn AS")[1].replace("preds", "sparse_calls")).replace("WITH ", "WITH RECURSIVE ", 1)  # fmt: skip


@q("q_label_rules", RULES)
def label_rules(spark, d):
    """L1-L8 over the reference, on records each of which reaches one of the rules."""
    spaced = kept(view(spark, d, "spaced").drop("other"), "kind").withColumn("other", F.translate("seq", "ACGT", "CGTA"))
    calls, truth = (view(spark, d, n, spaced=spaced) for n in ("sparse_calls", "sparse_truth"))
    return C.label_cascade(kept(calls), truth, spaced.select("contig", "start", "seq"))


@q("q_class_counts", P + f", k AS (SELECT {KIND.format('')} AS kind FROM preds) SELECT kind, (SELECT count(*) FROM k WHERE k.kind = c.kind) + 1 AS n FROM (VALUES ('DEL'), ('INS'), ('NONE'), ('SNP')) c(kind)")
def class_counts(spark, d):
    return C.class_counts(view(spark, d, "preds").select(V.variant_type().alias("kind")), "kind", ["DEL", "INS", "NONE", "SNP"])


@q("q_class_weights", P + f", k AS (SELECT {KIND.format('')} AS kind FROM preds), c AS (SELECT kind, (SELECT count(*) FROM k WHERE k.kind = c.kind) + 1 AS n FROM (VALUES ('DEL'), ('INS'), ('NONE'), ('SNP')) c(kind)) SELECT kind, round((1 - n / sum(n) OVER ()) / 4 * CASE WHEN kind = 'NONE' THEN 100.0 ELSE 1.0 END, 6)::DOUBLE AS weight FROM c")
def class_weights(spark, d):
    n = C.class_counts(view(spark, d, "preds").select(V.variant_type().alias("kind")), "kind", ["DEL", "INS", "NONE", "SNP"])
    return C.class_weights(n, "kind", {"NONE": 100.0}).withColumn("weight", F.round("weight", 6))


@q("q_confusion_f1", ctes("cls") + """, l AS (SELECT DISTINCT actual AS label FROM cls UNION SELECT DISTINCT predicted FROM cls),
g AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual <> label AND predicted = label) AS fp, count(*) FILTER (actual = label AND predicted <> label) AS fn FROM l CROSS JOIN cls GROUP BY label),
r AS (SELECT *, tp / (tp + fn + 1e-4) AS a, tp / (tp + fp + 1e-4) AS b FROM g)
SELECT label, tp, fp, fn, round(a, 4) AS sn, round(b, 4) AS pr, round(2*a*b/(a+b+1e-4), 4) AS f1 FROM r""")
def confusion_f1(spark, d):
    return C.confusion(view(spark, d, "cls"), "actual", "predicted")


@q("q_accuracy", ctes("cls") + " SELECT count(*) AS n, count(*) FILTER (actual = predicted) AS hits, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (actual = predicted) / count(*), 4) ELSE 0 END::DOUBLE AS accuracy FROM cls WHERE actual IS NOT NULL AND predicted IS NOT NULL")
def accuracy(spark, d):
    """The overall share of right labels."""
    return C.accuracy(view(spark, d, "cls"), "actual", "predicted")


@q("q_none_rotation", P + " SELECT id FROM preds WHERE prob >= 0.4 OR id % 5 = 2")
def none_rotation(spark, d):
    return C.rotating_sample(view(spark, d, "preds"), F.col("prob") < 0.4, 5, 7).select("id")


@q("q_losses", P + " SELECT round(sum(-ln(greatest(prob, 1e-6)) * w) / sum(w), 6) AS cross_entropy, round(avg(CASE WHEN x < 1 THEN 0.5*x*x ELSE x - 0.5 END), 6) AS smooth_l1 FROM (SELECT prob, 1.0 + id%3 AS w, (id%40)/10.0::DOUBLE AS x FROM preds)")
def losses(spark, d):
    df = view(spark, d, "preds").selectExpr("prob", "1.0D + id%3 as w", "(id%40)/10.0D as x")
    return C.loss_terms(df, "prob", "w", "x")


@q("q_union_calls", PT + " SELECT id, contig, pos, ref, alt FROM preds UNION ALL SELECT id, contig, pos, ref, alt FROM truth")
def union_calls(spark, d):
    cols = ["id", "contig", "pos", "ref", "alt"]
    return view(spark, d, "preds").select(*cols).unionByName(view(spark, d, "truth").select(*cols))


@q("q_distinct_calls", PT + " SELECT DISTINCT contig, pos, ref, alt FROM (SELECT contig, pos, ref, alt FROM preds UNION ALL SELECT contig, pos, ref, alt FROM truth)")
def distinct_calls(spark, d):
    return union_calls(spark, d).drop("id").distinct()


@q("q_symdiff", PT + " (SELECT contig, pos, ref, alt, 1 AS side FROM (SELECT DISTINCT contig, pos, ref, alt FROM preds EXCEPT SELECT contig, pos, ref, alt FROM truth)) UNION ALL (SELECT contig, pos, ref, alt, -1 FROM (SELECT DISTINCT contig, pos, ref, alt FROM truth EXCEPT SELECT contig, pos, ref, alt FROM preds))")
def symdiff(spark, d):
    side = lambda n: view(spark, d, n).select("contig", "pos", "ref", "alt").distinct()
    return C.symmetric_difference(side("preds"), side("truth")).withColumn("side", F.col("side").cast("int"))


@q("q_remaining", PT + " SELECT id FROM preds WHERE NOT EXISTS (SELECT 1 FROM truth WHERE truth.contig = preds.contig AND truth.pos = preds.pos)")
def remaining(spark, d):
    """U5."""
    return view(spark, d, "preds").join(view(spark, d, "truth").select("contig", "pos").distinct(), ["contig", "pos"], "left_anti").select("id")


@q("q_merge_post", PT + f", near AS (SELECT DISTINCT p.id AS id FROM preds p JOIN truth t ON {NEAR}) SELECT id, pos, CASE WHEN prob >= 0.7 THEN 'PASS' WHEN prob >= 0.4 THEN 'LowQual' ELSE 'REJECT' END AS filter, id IN (SELECT id FROM near) AS resolved FROM preds")
def merge_post(spark, d):
    """Resolved and unresolved calls together, rescored and labelled."""
    p, t = C.spanned(view(spark, d, "preds")), C.spanned(view(spark, d, "truth"))
    both = range_semi(p, t, pad=5).withColumn("resolved", F.lit(True)).unionByName(range_anti(p, t, pad=5).withColumn("resolved", F.lit(False)))
    return both.select("id", "pos", V.filter_label(F.col("prob")).alias("filter"), "resolved")


@q("q_shard_ids", P + " SELECT id, prob >= 0.4 AS is_var, CAST((row_number() OVER (PARTITION BY contig, prob >= 0.4 ORDER BY id) - 1)//50 AS BIGINT) AS shard FROM preds")
def shard_ids(spark, d):
    """U8: shards of bounded size, variants and others apart."""
    df = view(spark, d, "preds").withColumn("is_var", F.col("prob") >= 0.4)
    return numbered(df, ["contig", "is_var"], F.shiftright("id", 16), "id").selectExpr("id", "is_var", "k div 50 as shard")


@q("q_nan_to_zero", P + " SELECT id, CASE WHEN id%5=0 THEN 0.0 ELSE prob END::DOUBLE AS x FROM preds")
def nan_to_zero(spark, d):
    """U9."""
    return view(spark, d, "preds").select("id", F.nanvl(F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("prob")), F.lit(0.0)).alias("x"))


@q("q_rollup_class", P + f", k AS (SELECT contig, {KIND.format('')} AS kind FROM preds) SELECT contig, kind, count(*) AS n FROM k GROUP BY ROLLUP (contig, kind)")
def rollup_class(spark, d):
    return view(spark, d, "preds").select("contig", V.variant_type().alias("kind")).rollup("contig", "kind").agg(F.count("*").alias("n"))


@q("q_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    """The windowed form of tiling; ``streaming`` has it over a stream."""
    df = view(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return df.select("event_type", F.col("w.start").alias("hour"), "n", "total")


@q("q_session", "WITH o AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS begin, count(*) AS n FROM g GROUP BY user_id, g")
def session(spark, d):
    df = view(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return df.select("user_id", F.col("w.start").alias("begin"), "n")
