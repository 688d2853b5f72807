"""Queries over pileups, candidates and alleles."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaspark.fixtures import ctes, view
from somaspark.functions import variants as V
from somaspark.operators import candidates as C
from somaspark.operators import pileup as P
from somaspark.operators import repeats as T

from .registry import Registry

q = Registry()
B, RAW, PR = ctes("bases"), ctes("raw"), ctes("preds")
CNT = B + ", c AS (SELECT contig, pos, max(refcode) AS refcode, " + ", ".join(f"count(*) FILTER (code = {c}) AS c{c}" for c in range(5)) + " FROM bases{w} GROUP BY contig, pos)"
MM = CNT.replace("{w}", " WHERE sample = 'tumor'") + """, r AS (SELECT *, c0+c1+c2+c3+c4 AS dp, list_sort([{'m': -c1, 'o': 0, 'code': 1}, {'m': -c2, 'o': 1, 'code': 2}, {'m': -c3, 'o': 2, 'code': 3}, {'m': -c4, 'o': 3, 'code': 4}, {'m': -c0, 'o': 4, 'code': 0}]) AS k FROM c),
mm AS (SELECT *, k[1].code AS major, -k[1].m AS major_n, CASE WHEN sw THEN k[3].code ELSE k[2].code END AS minor, CASE WHEN sw THEN -k[3].m ELSE -k[2].m END AS minor_n
FROM (SELECT *, k[1].code = refcode AND k[2].code = 0 AND refcode <> 0 AND -k[3].m > 0.5 * -k[2].m AS sw FROM r))"""
CAND = MM + """, alt AS (SELECT *, CASE WHEN major <> refcode THEN major WHEN minor_n > 0 AND minor_n::DOUBLE / (major_n + minor_n) > 0.01 THEN minor END AS alt FROM mm),
cand AS (SELECT contig, pos, refcode, alt, dp, ro, ao, round(ao::DOUBLE / (ao + ro), 4) AS af FROM (SELECT *, [c0,c1,c2,c3,c4][refcode+1] AS ro, [c0,c1,c2,c3,c4][alt+1] AS ao FROM alt WHERE alt IS NOT NULL AND alt <> refcode))"""


def tumor(spark, d):
    return view(spark, d, "bases").where("sample = 'tumor'")


@q("q_pileup_counts", CNT.replace("{w}", "") + " SELECT * FROM c")
def pileup_counts(spark, d):
    return P.counts(view(spark, d, "bases"))


@q("q_pileup_depth", CNT.replace("{w}", "") + " SELECT contig, pos, c0+c1+c2+c3+c4 AS depth, c1+c2+c3+c4 AS base_depth FROM c")
def pileup_depth(spark, d):
    return P.depth(P.counts(view(spark, d, "bases"))).select("contig", "pos", "depth", "base_depth")


QUAL = B + ", ql AS (SELECT contig, pos, code, count(*) AS n, round(sum(bq)::DOUBLE/count(*), 4) AS bq, round(sum(mapq)::DOUBLE/count(*), 4) AS mapq, round(100*sum(fwd)::DOUBLE/count(*), 4) AS strand FROM bases GROUP BY 1,2,3)"


@q("q_pileup_quality", QUAL + " SELECT * FROM ql")
def pileup_quality(spark, d):
    return P.qualities(view(spark, d, "bases"))


@q("q_strand_matrix", QUAL + " SELECT contig, pos, code, round(strand/100*n, 4) AS fwd_n FROM ql")
def strand_matrix(spark, d):
    return P.strand_counts(P.qualities(view(spark, d, "bases"))).select("contig", "pos", "code", "fwd_n")


@q("q_clip_counts", B + " SELECT contig, pos, CAST(sum(lclip) AS BIGINT) AS ls, CAST(sum(rclip) AS BIGINT) AS rs FROM bases GROUP BY 1, 2")
def clip_counts(spark, d):
    return P.clips(view(spark, d, "bases"))


@q("q_major_minor", MM + " SELECT contig, pos, major, major_n, minor, minor_n FROM mm")
def major_minor(spark, d):
    return P.major_minor(P.counts(tumor(spark, d))).select("contig", "pos", "major", "major_n", "minor", "minor_n")


@q("q_raw_candidates", CAND + " SELECT * FROM cand")
def raw_candidates(spark, d):
    return P.raw_candidates(P.counts(tumor(spark, d)))


@q("q_snp_calls", CAND + " SELECT * FROM cand WHERE alt > 0 AND refcode > 0 AND dp > 2 AND dp < 100000 AND (af >= 0.05 OR ao >= 3)")
def snp_calls(spark, d):
    """The flagship: pileup, alternative allele, SNP rule."""
    return P.snp_calls(P.raw_candidates(P.counts(tumor(spark, d))))


@q("q_depth_cap", B + " SELECT contig, pos, code, bq, mapq, sample FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY bq, mapq, code, sample, fwd) AS k FROM bases) WHERE k <= 3")
def depth_cap(spark, d):
    return P.capped(view(spark, d, "bases"), 3, ["bq", "mapq", "code", "sample", "fwd"]).select("contig", "pos", "code", "bq", "mapq", "sample")


@q("q_tumor_normal_align", B + "".join(f", {p} AS (SELECT contig, pos, {', '.join(f'count(*) FILTER (code = {c}) AS c{c}' for c in range(5))} FROM bases WHERE sample = '{s}' GROUP BY 1, 2)" for p, s in (("t", "tumor"), ("n", "normal")))
   + " SELECT coalesce(t.contig, n.contig) AS contig, coalesce(t.pos, n.pos) AS pos, " + ", ".join(f"coalesce({p}.c{c}, {f'(SELECT max(greatest(c0,c1,c2,c3,c4)) FROM {p})' if c == 0 else '0'}) AS {p}{c}" for p in "tn" for c in range(5)) + " FROM t FULL JOIN n ON t.contig = n.contig AND t.pos = n.pos")
def tumor_normal_align(spark, d):
    b = view(spark, d, "bases")
    return P.aligned_samples(P.counts(b.where("sample = 'tumor'")), P.counts(b.where("sample = 'normal'")))


@q("q_candidate_filter", RAW + " SELECT id, dp, ro, ao FROM raw WHERE ao >= least(ro, 1) AND dp < 80 AND ref <> alt")
def candidate_filter(spark, d):
    return C.prefilter(view(spark, d, "raw"), max_dp=80).select("id", "dp", "ro", "ao")


@q("q_snp_filter", RAW + " SELECT id, contig, pos, ref, alt FROM raw WHERE length(ref) = 1 AND length(alt) = 1 AND dp > 5 AND dp < 100000 AND (ao::DOUBLE / nullif(ro+ao, 0) >= 0.05 OR ao >= 3) AND bq >= 10")
def snp_filter(spark, d):
    return C.snps(view(spark, d, "raw")).select("id", "contig", "pos", "ref", "alt")


@q("q_ins_filter", RAW + " SELECT id FROM raw WHERE length(alt) > length(ref) AND NOT (coalesce(ao::DOUBLE / nullif(ro+ao, 0), 0) < 0.05 AND ao < 10) AND dp > 5")
def ins_filter(spark, d):
    return C.insertions(view(spark, d, "raw")).select("id")


@q("q_dedup_ratio", RAW + ", x AS (SELECT id, contig, pos % 100 AS pos, ref, alt, ro, ao FROM raw) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY contig, pos, ref, alt ORDER BY ao / (ro + 1e-4) DESC, id) = 1")
def dedup_ratio(spark, d):
    return C.best_of_locus(view(spark, d, "raw").selectExpr("id", "contig", "pos % 100 as pos", "ref", "alt", "ro", "ao"))


@q("q_del_merge", B + """, x AS (SELECT contig, pos, substring('-ACGT', max(refcode)+1, 1) AS base, count(*) FILTER (code = 0) AS ao, count(*) FILTER (code = refcode) AS ro FROM bases GROUP BY 1, 2),
y AS (SELECT *, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM x WHERE ao > 0)
SELECT contig, min(pos) AS pos, string_agg(base, '' ORDER BY pos) AS ref, max(ao) AS ao, max(ro) AS ro FROM y GROUP BY contig, g""")
def del_merge(spark, d):
    x = view(spark, d, "bases").groupBy("contig", "pos").agg(F.expr("substring('-ACGT', max(refcode)+1, 1)").alias("base"), F.count(F.expr("case when code = 0 then 1 end")).alias("ao"), F.count(F.expr("case when code = refcode then 1 end")).alias("ro"))
    return C.deletion_runs(x.where("ao > 0"))


ATTR = ", ".join(f"max({c}) AS {c}" for c in C.ATTRIBUTES)
COLS = ", ".join(C.ATTRIBUTES)
SITES = ctes("sites") + f""", sx AS (SELECT *, coalesce(ao::DOUBLE / nullif(ro + ao, 0), 0) AS af FROM (SELECT * FROM sites WHERE ref = 'N' UNION ALL (SELECT * FROM sites WHERE ref <> 'N' QUALIFY row_number() OVER (PARTITION BY contig, pos, ref, alt ORDER BY ao / (ro + 1e-4) DESC, id) = 1))),
iw AS (SELECT *, max(af) OVER (PARTITION BY contig, pos) AS top, count(*) OVER (PARTITION BY contig, pos) AS n FROM sx WHERE ref = 'N'),
im AS (SELECT contig, pos, string_agg(alt, '' ORDER BY id) AS alt, {ATTR}, top FROM iw WHERE n > 1 AND af >= top * 0.5 GROUP BY contig, pos, top),
ins AS (SELECT contig, pos, ref, alt, {COLS} FROM iw WHERE n = 1 AND (af >= 0.05 OR ao >= 10) AND dp > 5
 UNION ALL SELECT contig, pos, 'N', alt, {COLS} FROM im WHERE top >= 0.2 OR ao >= 10)"""


def sites(spark, d):
    df = view(spark, d, "sites")
    return df.where("ref = 'N'").unionByName(C.best_of_locus(df.where("ref <> 'N'")))


@q("q_ins_merge", SITES + " SELECT * FROM ins")
def ins_merge(spark, d):
    return C.merged_insertions(sites(spark, d), merge_min_af=0.2)


@q("q_indel_runs", SITES + f""", stops AS (SELECT contig, pos FROM sx WHERE ref <> 'N' AND alt <> 'N' UNION SELECT contig, pos FROM ins),
d AS (SELECT *, lag(pos) OVER (PARTITION BY contig ORDER BY pos) AS prev, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS nd FROM sx WHERE ref <> 'N' AND alt = 'N' AND dp > 5 AND dp < 100000 AND (af >= 0.02 OR ao >= 10)),
e AS (SELECT d.*, (SELECT min(s.pos) FROM stops s WHERE s.contig = d.contig AND s.pos > d.pos) AS nb, CASE WHEN prev = pos - 1 AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.contig = d.contig AND s.pos = d.pos) THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY pos) AS run FROM e),
w AS (SELECT *, max(af) OVER (PARTITION BY contig, run) AS top, count(*) OVER (PARTITION BY contig, run) AS n FROM r)
SELECT contig, pos, ref, alt, {COLS} FROM w WHERE n = 1 AND (af >= 0.1 OR ((nd IS NULL OR nb <= nd) AND ao >= 10))
UNION ALL SELECT contig, min(pos), string_agg(ref, '' ORDER BY pos), 'N', {ATTR} FROM w WHERE n > 1 AND af >= top * 0.5 GROUP BY contig, run""")
def indel_runs(spark, d):
    df = sites(spark, d)
    return C.merged_deletions(df, C.merged_insertions(df, merge_min_af=0.2), min_af=0.1, merge_min_af=0.02)


@q("q_known_site_filter", ctes("preds", "known") + " SELECT id, contig, pos, ref, alt FROM preds p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.contig = p.contig AND k.pos = p.pos) OR EXISTS (SELECT 1 FROM known k WHERE k.contig = p.contig AND k.pos = p.pos AND (k.ref <> p.ref OR k.alt <> p.alt))")
def known_site_filter(spark, d):
    return C.without_known(view(spark, d, "preds"), view(spark, d, "known")).select("id", "contig", "pos", "ref", "alt")


@q("q_known_site_strict", ctes("preds", "known") + " SELECT id FROM preds p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.contig = p.contig AND k.pos = p.pos AND k.ref = p.ref AND k.alt = p.alt)")
def known_site_strict(spark, d):
    return C.without_known(view(spark, d, "preds"), view(spark, d, "known"), strict=True).select("id")


@q("q_info_format", RAW + " SELECT id, concat_ws(';', CASE WHEN dp IS NOT NULL THEN 'DP=' || dp END, 'RO=' || ro, CASE WHEN ao > 0 THEN 'AO=' || ao END) AS info FROM raw")
def info_format(spark, d):
    return view(spark, d, "raw").withColumn("ao", F.expr("nullif(ao, 0)")).select("id", C.info_text({"DP": "dp", "RO": "ro", "AO": "ao"}).alias("info"))


@q("q_parse_info", RAW + " SELECT id, dp, CASE WHEN ao > 0 THEN ao ELSE -1 END AS ao, CAST(round(ro / 2.0, 4) AS DOUBLE) AS half FROM raw")
def parse_info(spark, d):
    df = view(spark, d, "raw").selectExpr("id", "nullif(ao, 0) as ao", "dp", "round(ro / 2.0D, 4) as half").select("id", C.info_text({"DP": "dp", "AO": "ao", "HF": "half"}).alias("info"))
    return df.select("id", C.info_value("info", "DP", "int").alias("dp"), C.info_value("info", "AO", "int", -1).alias("ao"), C.info_value("info", "HF", "double").alias("half"))


@q("q_variant_type", PR + " SELECT id, CASE WHEN length(ref) > length(alt) THEN 'DEL' WHEN length(ref) < length(alt) THEN 'INS' ELSE 'SNP' END AS kind FROM preds")
def variant_type(spark, d):
    return view(spark, d, "preds").select("id", V.variant_type().alias("kind"))


@q("q_filter_label", PR + " SELECT id, CASE WHEN prob >= 0.7 THEN 'PASS' WHEN prob >= 0.4 THEN 'LowQual' ELSE 'REJECT' END AS filter FROM preds")
def filter_label(spark, d):
    return view(spark, d, "preds").select("id", V.filter_label(F.col("prob")).alias("filter"))


@q("q_phred", PR + " SELECT id, CASE WHEN prob <= 0 THEN 0.0 WHEN prob >= 1 THEN 100.0 ELSE least(100.0, round(-10*log10(1-prob), 4)) END::DOUBLE AS qual FROM preds")
def phred(spark, d):
    return view(spark, d, "preds").select("id", V.phred(F.col("prob")).alias("qual"))


@q("q_unphred", PR + " SELECT id, round(1 - pow(10.0, -(id%600/10.0)/10), 4)::DOUBLE AS score FROM preds")
def unphred(spark, d):
    return view(spark, d, "preds").select("id", V.unphred((F.col("id") % 600).cast("double") / 10).alias("score"))


ALLELES = PR + ", x AS (SELECT id, pos, concat('AC', ref, 'GT') AS ref, concat('AC', alt, CASE WHEN id%2=0 THEN 'GT' ELSE 'T' END) AS alt FROM preds)"
_lcp = lambda a, b: f"CASE WHEN least(length({a}), length({b})) = 0 THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(length({a}), length({b}))+1), lambda i: substring({a}, i::INT, 1) <> substring({b}, i::INT, 1))) - 1, least(length({a}), length({b}))) END"


def alleles(spark, d):
    return view(spark, d, "preds").selectExpr("id", "pos", "concat('AC', ref, 'GT') as ref", "concat('AC', alt, case when id%2=0 then 'GT' else 'T' end) as alt")


@q("q_trim_alleles", ALLELES + f""", y AS (SELECT *, least({_lcp('reverse(ref)', 'reverse(alt)')}, least(length(ref), length(alt)) - 1) AS b FROM x),
z AS (SELECT id, pos, left(ref, (length(ref)-b)::INT) AS r, left(alt, (length(alt)-b)::INT) AS a FROM y),
f AS (SELECT *, least({_lcp('r', 'a')}, least(length(r), length(a)) - 1) AS f FROM z)
SELECT id, CAST(pos + f AS INT) AS pos, substring(r, (f+1)::INT) AS ref, substring(a, (f+1)::INT) AS alt FROM f""")
def trim_alleles(spark, d):
    return alleles(spark, d).select("id", V.trimmed(F.col("pos"), F.col("ref"), F.col("alt")).alias("t")).select("id", "t.pos", "t.ref", "t.alt")


@q("q_lcp_center", ALLELES + f" SELECT id, CAST({_lcp('ref', 'alt')} AS INT) AS center FROM x")
def lcp_center(spark, d):
    return alleles(spark, d).select("id", V.common_prefix(F.col("ref"), F.col("alt")).alias("center"))


@q("q_event_len", ALLELES + f", y AS (SELECT *, {_lcp('ref', 'alt')} AS p FROM x), z AS (SELECT *, substring(ref, (p+1)::INT) AS r, substring(alt, (p+1)::INT) AS a FROM y) SELECT id, CAST(greatest(length(ref), length(alt)) - p - {_lcp('reverse(r)', 'reverse(a)')} AS INT) AS len FROM z")
def event_len(spark, d):
    return alleles(spark, d).select("id", V.event_length(F.col("ref"), F.col("alt")).alias("len"))


@q("q_mnp_explode", PR + ", x AS (SELECT id, contig, pos, ref || 'ACGT' AS ref, alt || 'AGGA' AS alt FROM preds WHERE length(ref) = length(alt)) SELECT id, contig, CAST(pos + i - 1 AS INT) AS pos, substring(ref, i::INT, 1) AS ref, substring(alt, i::INT, 1) AS alt FROM (SELECT *, unnest(range(1, length(ref)+1)) AS i FROM x) WHERE substring(ref, i::INT, 1) <> substring(alt, i::INT, 1)")
def mnp_explode(spark, d):
    """P19."""
    df = view(spark, d, "preds").where("length(ref) = length(alt)").selectExpr("id", "contig", "pos", "ref || 'ACGT' as ref", "alt || 'AGGA' as alt")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("ref"))))
    return df.selectExpr("id", "contig", "pos + i - 1 as pos", "substring(ref, i, 1) as ref", "substring(alt, i, 1) as alt").where("ref <> alt")


PART_OF = """(({a}k = 'SNP' AND {b}k = 'DEL' AND {a}pos > {b}pos AND {a}pos < {b}pos + length({b}ref)) OR ({a}k = 'DEL' AND {b}k = 'SNP' AND {b}pos > {a}pos AND {b}pos < {a}pos + length({a}ref))
OR ({a}k = {b}k AND ({a}pos = {b}pos OR ({a}k = 'DEL' AND len(list_intersect(range({a}pos + 1, {a}pos + length({a}ref)), range({b}pos + 1, {b}pos + length({b}ref)))) > 0))))"""


@q("q_is_part_of", ctes("preds", "truth") + f""", p AS (SELECT *, CASE WHEN length(ref) > length(alt) THEN 'DEL' WHEN length(ref) < length(alt) THEN 'INS' ELSE 'SNP' END AS k FROM preds),
t AS (SELECT *, CASE WHEN length(ref) > length(alt) THEN 'DEL' WHEN length(ref) < length(alt) THEN 'INS' ELSE 'SNP' END AS k FROM truth)
SELECT p.id AS a, t.id AS b FROM p JOIN t ON p.contig = t.contig AND p.pos < t.pos + length(t.ref) AND t.pos < p.pos + length(p.ref) WHERE {PART_OF.format(a='p.', b='t.')}""")
def is_part_of(spark, d):
    from somaspark.operators.calls import variant_pairs

    c = F.col
    part = V.is_part_of(c("pos"), c("ref"), c("alt"), c("r_pos"), c("r_ref"), c("r_alt"))
    return variant_pairs(view(spark, d, "preds"), view(spark, d, "truth"), keep=part).select(c("id").alias("a"), c("r_id").alias("b"))


@q("q_base_clean", PR + " SELECT id, regexp_replace(upper(concat(lower(ref), 'nRx', alt)), '[^ACGT]', '-', 'g') AS seq FROM preds")
def base_clean(spark, d):
    return view(spark, d, "preds").select("id", V.clean_bases(F.concat(F.lower("ref"), F.lit("nRx"), F.col("alt"))).alias("seq"))


@q("q_base_code", PR + " SELECT id, CAST(nullif(instr('-ACGT', substring(ref || 'N', 1 + (id%2)::INT, 1)), 0) - 1 AS INT) AS code FROM preds")
def base_code(spark, d):
    return view(spark, d, "preds").select("id", V.base_code(F.substr(F.concat("ref", F.lit("N")), (1 + F.col("id") % 2).cast("int"), F.lit(1))).alias("code"))


@q("q_tag_scale", ctes("reads") + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(100 - round_even(l_linenumber/(0.001+l_quantity)*100, 0), 100.0), 0.0)::DOUBLE AS nm FROM reads")
def tag_scale(spark, d):
    return view(spark, d, "reads").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.tag_scale(F.col("l_linenumber"), F.col("l_quantity")).alias("nm"))


@q("q_rounding", PR + " SELECT id, round((id%1000)::DOUBLE/8, 2)::DOUBLE AS half_up, round_even(prob*1000/16, 0)::DOUBLE AS half_even FROM preds")
def rounding(spark, d):
    """both conventions."""
    return view(spark, d, "preds").select("id", F.round((F.col("id") % 1000).cast("double") / 8, 2).alias("half_up"), F.rint(F.col("prob") * 1000 / 16).alias("half_even"))


@q("q_split_tokens", PR + " SELECT id, CAST(len(list_filter(string_split(concat(ref, ',,', alt, ','), ','), lambda x: x <> '')) AS INT) AS n FROM preds")
def split_tokens(spark, d):
    """F26."""
    return view(spark, d, "preds").select("id", F.size(F.filter(F.split(F.concat("ref", F.lit(",,"), "alt", F.lit(",")), ","), lambda x: x != "")).alias("n"))


@q("q_contig_name_order", ctes("preds", "contigs") + " SELECT id, name, pos, row_number() OVER (ORDER BY name, pos, id) AS place FROM preds JOIN contigs ON contig = ord")
def contig_name_order(spark, d):
    """Contig names as text, then the position."""
    df = view(spark, d, "preds").join(view(spark, d, "contigs"), F.col("contig") == F.col("ord"))
    return C.placed(df, "name").select("id", "name", "pos", "place")


@q("q_contig_order", ctes("preds", "contigs") + " SELECT id, name, pos, row_number() OVER (ORDER BY ord, pos, id) AS place FROM preds JOIN contigs ON contig = ord")
def contig_order(spark, d):
    """Contig ordinals, then the position; places are numbered contig by contig."""
    from pyspark.sql import Window

    df = view(spark, d, "preds").join(F.broadcast(view(spark, d, "contigs")), F.col("contig") == F.col("ord"))  # a row a contig
    base = df.groupBy("ord").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("ord").orderBy("pos", "id"))
    return df.withColumn("k", place).join(F.broadcast(base.select("ord", "base")), "ord").select("id", "name", "pos", (F.col("base") + F.col("k")).alias("place"))


@q("q_contig_check", ctes("preds", "contigs") + " SELECT DISTINCT contig FROM preds WHERE contig NOT IN (SELECT ord FROM contigs WHERE ord < 20)")
def contig_check(spark, d):
    """Contigs that the dictionary lacks."""
    return view(spark, d, "preds").select("contig").distinct().join(view(spark, d, "contigs").where("ord < 20").select(F.col("ord").alias("contig")), "contig", "left_anti")


@q("q_contig_regex", "SELECT n_name AS name FROM (SELECT CASE WHEN n_nationkey%3=0 THEN 'chr' || n_nationkey WHEN n_nationkey%3=1 THEN CAST(n_nationkey AS VARCHAR) || 'X' ELSE n_name || '_alt' END AS n_name FROM nation) WHERE regexp_full_match(n_name, '(chr)?[0-9XYMT]+')")
def contig_regex(spark, d):
    """S18."""
    names = view(spark, d, "nation").selectExpr("case when n_nationkey%3=0 then 'chr' || n_nationkey when n_nationkey%3=1 then n_nationkey || 'X' else n_name || '_alt' end as name")
    return names.where(F.col("name").rlike("^(chr)?[0-9XYMT]+$"))


@q("q_none_report", PR + ", x AS (SELECT id, round(CASE WHEN length(ref) = length(alt) THEN prob*0.01 ELSE prob*0.02 END, 6)::DOUBLE AS p FROM preds) SELECT * FROM x WHERE p > 0.005")
def none_report(spark, d):
    """Calls of class NONE that are still worth a line."""
    p = F.round(F.when(F.length("ref") == F.length("alt"), F.col("prob") * 0.01).otherwise(F.col("prob") * 0.02), 6)
    return view(spark, d, "preds").select("id", p.alias("p")).where("p > 0.005")


@q("q_score", PR + " SELECT id, round(CASE WHEN length(ref) > length(alt) THEN prob * (1 - prob/3) WHEN length(ref) < length(alt) THEN prob/2 * (1 - prob/3) ELSE (1-prob) * (prob/4) END, 6)::DOUBLE AS score FROM preds")
def score(spark, d):
    p = F.col("prob")
    return view(spark, d, "preds").select("id", F.round(V.score(V.variant_type(), p, p / 2, 1 - p, p / 3, p / 4), 6).alias("score"))


@q("q_check_rep", ctes("refseq") + " SELECT contig, start, u AS unit, count(*) FILTER (substring(seq, p::INT, u::INT) = substring(seq, (p+u)::INT, u::INT)) AS n FROM (SELECT contig, start, seq, u, unnest(range(1, 65-2*u+1)) AS p FROM (SELECT *, unnest([2,3,4]) AS u FROM refseq)) GROUP BY 1, 2, 3")
def check_rep(spark, d):
    df = view(spark, d, "refseq").select("*", F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("unit"))
    hits = lambda u: F.size(F.filter(F.sequence(F.lit(1), F.lit(64 - 2 * u + 1)), lambda p: V.repeats_at(F.col("seq"), p, u)))
    return df.select("contig", "start", "unit", F.coalesce(*[F.when(F.col("unit") == u, hits(u)) for u in (2, 3, 4)]).cast("long").alias("n"))


# eight chunks around a region hold every repeat of the made-up reference; the walk goes unit by unit
_EXT = """, len AS (SELECT contig, CAST(max(start) + 64 AS INT) AS length FROM genome GROUP BY contig),
w AS (SELECT spots.id, spots.contig, s, e, length, min(g.start) AS w0, string_agg(g.seq, '' ORDER BY g.start) AS txt FROM spots JOIN len USING (contig) JOIN genome AS g ON g.contig = spots.contig AND g.start BETWEEN 64*(s//64)-256 AND 64*(s//64)+256 GROUP BY ALL),
p AS (SELECT *, greatest(s-4, 1) AS s0, least(e+4, length-2) AS e0 FROM w),
l AS (SELECT *, CASE {left0} {left3} ELSE s0+3 END AS s1 FROM p),
r AS (SELECT *, CASE {right0} {right3} ELSE e0-3 END AS e1 FROM l)
SELECT id, contig, CAST(s1+1 AS INT) AS s, CAST(e1-1 AS INT) AS e FROM r"""


def _walk(side: str, unit: int, back: int) -> str:
    """WHEN ... THEN ... of one unit: the number of steps is the first at which the unit is not repeated."""
    at = f"(s0+{back}-j*{unit})" if side == "left" else f"(e0-{back}+j*{unit}-{2 * unit}+1)"
    sub = lambda x, n: f"substring(txt, CAST({x}-w0+1 AS INT), {n})"
    inside = f"{at} >= w0 AND {at}+{2 * unit} <= w0+length(txt)"
    fits = f"({inside} AND {sub(at, unit)} = {sub(f'({at}+{unit})', unit)} AND {sub(at, 2 * unit)} <> repeat({sub(at, 1)}, {2 * unit}))"
    steps = f"list_position(list_transform(range(0, 130), lambda j: {fits}), false) - 1"
    room = f"e0-s0-{back}+1 >= {2 * unit}" if side == "left" else f"e0-{back}-s1+1 >= {2 * unit}"
    new = f"greatest(s0+{back}-{unit}*({steps}), 0)" if side == "left" else f"least(e0-{back}+{unit}*({steps}), length-1)"
    return f"WHEN {room} AND {steps} > 0 THEN {new}"


def _extended() -> str:
    some = lambda side, units, back: " ".join(_walk(side, u, back) for u in units)
    return ctes("genome", "spots") + _EXT.format(left0=some("left", T.FIRST["left"], 0), left3=some("left", T.AGAIN["left"], T.REACH), right0=some("right", T.FIRST["right"], 0), right3=some("right", T.AGAIN["right"], T.REACH))


@q("q_extend_repeats", _extended())
def extend_repeats(spark, d):
    """F16: regions grown over the 2-, 3- and 4-mer repeats at their ends."""
    genome = view(spark, d, "genome")
    lengths = genome.groupBy("contig").agg((F.max("start") + 64).alias("length"))
    return T.extend_repeats(view(spark, d, "spots"), T.tandem_runs(genome), lengths)


@q("q_tandem_runs", ctes("genome") + """, b AS (SELECT contig, start + i AS p, substring(seq, (i+1)::INT, 1) AS base FROM genome, range(0, 64) AS r(i)),
n AS (SELECT contig, p, base, unnest([2, 3, 4]) AS unit, unnest([lead(base, 2) OVER w, lead(base, 3) OVER w, lead(base, 4) OVER w]) AS z FROM b WINDOW w AS (PARTITION BY contig ORDER BY p)),
m AS (SELECT *, p - row_number() OVER (PARTITION BY contig, unit ORDER BY p) AS grp FROM n WHERE z = base),
r AS (SELECT contig, unit, min(p) AS s, max(p) + 1 AS e FROM m GROUP BY contig, unit, grp HAVING count(*) >= unit AND count(DISTINCT base) > 1)
SELECT contig, unit, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM r""")
def tandem_runs(spark, d):
    return T.tandem_runs(view(spark, d, "genome"))


@q("q_ref_fetch", ctes("refseq", "iv") + ", x AS (SELECT id, contig, s%1000 AS s FROM iv) SELECT id, substring(seq, (s-start+1)::INT, 8) AS seq FROM x JOIN refseq ON x.contig = refseq.contig AND start = 64*(s//64)")
def ref_fetch(spark, d):
    """A fetch is an equi-join with the reference chunk."""
    x = view(spark, d, "iv").selectExpr("id", "contig", "s % 1000 as s").withColumn("start", (F.floor(F.col("s") / 64) * 64).cast("int"))
    return x.join(view(spark, d, "refseq"), ["contig", "start"]).select("id", F.substr("seq", F.col("s") - F.col("start") + 1, F.lit(8)).alias("seq"))
