"""Queries over reads, CIGARs and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaspark.fixtures import ctes, view
from somaspark.operators import cigar as G
from somaspark.operators import splicing as X
from somaspark.operators.intervals import range_join
from somaspark.operators.stretches import carried, inside, numbered, up_to

from .registry import Registry

q = Registry()
R, RUNS = ctes("reads"), ctes("runs")
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
K = ", ".join(KEY)
RX = "'([0-9]+)([MIDNSHP=X])'"
OPS = R + f", ops AS (SELECT {K}, contig, s, generate_subscripts(regexp_extract_all(cigar, {RX}), 1) - 1 AS i, unnest(regexp_extract_all(cigar, {RX}, 2)) AS op, CAST(unnest(regexp_extract_all(cigar, {RX}, 1)) AS INT) AS len FROM reads)"


@q("q_cigar_parse", OPS + f" SELECT {K}, CAST(i AS INT) AS i, op, len FROM ops")
def cigar_parse(spark, d):
    return view(spark, d, "reads").select(*KEY, F.posexplode(G.parsed("cigar")).alias("i", "x")).select(*KEY, "i", "x.op", "x.len")


@q("q_cigar_merge", OPS.replace("FROM reads)", "FROM (SELECT * REPLACE (translate(cigar, 'I', 'M') AS cigar) FROM reads))") + f""", n AS (SELECT *, i - row_number() OVER (PARTITION BY {K}, op ORDER BY i) AS g FROM ops),
m AS (SELECT {K}, op, g, min(i) AS i, sum(len) AS len FROM n GROUP BY {K}, op, g) SELECT {K}, string_agg(len || op, '' ORDER BY i) AS cigar FROM m GROUP BY {K}""")
def cigar_merge(spark, d):
    return view(spark, d, "reads").select(*KEY, G.rendered(G.merged(G.parsed(F.translate("cigar", "I", "M")))).alias("cigar"))


@q("q_cigar_indels", OPS + f", p AS (SELECT *, CAST(s + coalesce(sum(CASE WHEN op IN ('M','D') THEN len ELSE 0 END) OVER (PARTITION BY {K} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM ops) SELECT {K}, op, pos, len FROM p WHERE op IN ('I','D')")
def cigar_indels(spark, d):
    return view(spark, d, "reads").select(*KEY, F.explode(G.indels(G.parsed("cigar"), F.col("s"))).alias("x")).select(*KEY, "x.op", "x.pos", "x.len")


@q("q_cigar_stats", OPS + f" SELECT {K}, " + ", ".join(f"CAST(coalesce(sum(len) FILTER (op = '{o}'), 0) AS INT) AS n_{o.lower()}" for o in "MID") + f" FROM ops GROUP BY {K}")
def cigar_stats(spark, d):
    ops = G.parsed("cigar")
    return view(spark, d, "reads").select(*KEY, *[G.op_length(ops, o).alias(f"n_{o.lower()}") for o in "MID"])


_SEQ = "substring('ACGTTGCAACGTGGCC', cast(1 + {}%8 as int), 8)"


@q("q_edit_distance", R + f" SELECT {K}, CAST(len(list_filter(range(1, 9), lambda i: substring(a, i::INT, 1) <> substring(b, i::INT, 1))) + l_linenumber + 1 + l_suppkey%7 AS INT) AS nm FROM (SELECT *, {_SEQ.format('l_partkey')} AS a, {_SEQ.format('l_suppkey')} AS b FROM reads)")
def edit_distance(spark, d):
    df = view(spark, d, "reads").selectExpr("*", f"{_SEQ.format('l_partkey')} as a", f"{_SEQ.format('l_suppkey')} as b")
    return df.select(*KEY, G.edit_distance(G.parsed("cigar"), F.col("a"), F.col("b")).alias("nm"))


@q("q_read_filter", R + f" SELECT {K}, contig, s, e FROM reads WHERE mapq >= 20 AND e > s AND NOT is_dup AND NOT is_secondary AND NOT is_qcfail AND cigar <> ''")
def read_filter(spark, d):
    return G.read_filter(view(spark, d, "reads"), 20).select(*KEY, "contig", "s", "e")


@q("q_sa_filter", R + f" SELECT {K} FROM reads WHERE l_suppkey%3 <> 0 AND cigar <> ''")
def sa_filter(spark, d):
    """Supplementary alignments whose CIGAR another record's SA tag already names go."""
    sa = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("1,5,+,9M,60,0;2,7,-,"), F.col("cigar"), F.lit(",60,1;"))).otherwise(F.lit("1,5,+,9M,60,0;"))
    return view(spark, d, "reads").where(~F.coalesce(G.in_supplement(F.col("cigar"), sa), F.lit(False))).select(*KEY)


@q("q_span_filter", ctes("iv", "jv") + " SELECT iv.id AS a, jv.id AS b FROM iv JOIN jv ON iv.contig = jv.contig AND iv.s < jv.e AND jv.s < iv.e WHERE least(iv.e, jv.e) - greatest(iv.s, jv.s) >= 0.75 * (jv.e - jv.s)")
def span_filter(spark, d):
    return G.spans(range_join(view(spark, d, "iv"), view(spark, d, "jv"))).select(F.col("id").alias("a"), F.col("r_id").alias("b"))


@q("q_realign_gate", R + " SELECT contig, region, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS nm FROM (SELECT *, s//200 AS region FROM reads) GROUP BY 1, 2 HAVING count(*) < 1000 AND sum(l_linenumber) / (count(*) + 1e-4) / (max(e) - min(s) + 1e-4) > 0.0135")
def realign_gate(spark, d):
    """A17."""
    g = view(spark, d, "reads").withColumn("region", F.expr("s div 200")).groupBy("contig", "region").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("nm"), (F.max("e") - F.min("s")).alias("span"))
    return g.where((F.col("n") < 1000) & (F.col("nm") / (F.col("n") + 1e-4) / (F.col("span") + 1e-4) > 0.0135)).select("contig", "region", "n", "nm")


@q("q_rle_cigar", RUNS + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM runs),
m AS (SELECT user_id, event_type, g, count(*) AS n, min(k) AS k FROM n GROUP BY 1, 2, 3) SELECT user_id, string_agg(n || upper(left(event_type, 1)), '' ORDER BY k) AS runs FROM m GROUP BY user_id""")
def rle_cigar(spark, d):
    df = G.run_lengths(view(spark, d, "runs"), ["user_id"], ["ts", "event_id"], "event_type")
    return df.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "n", "event_type"))), lambda x: F.concat(x["n"].cast("string"), F.upper(F.left(x["event_type"], F.lit(1))))), "").alias("runs"))


@q("q_largest_block", RUNS + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM runs),
m AS (SELECT user_id, event_type, g, count(*) AS n, min(k) AS k FROM n GROUP BY 1, 2, 3) SELECT user_id, event_type, n FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) = 1""")
def largest_block(spark, d):
    """W12."""
    df = G.run_lengths(view(spark, d, "runs"), ["user_id"], ["ts", "event_id"], "event_type")
    return df.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", -F.col("run"))).alias("x")).select("user_id", "x.event_type", "x.n")


@q("q_read_chunks", R + f" SELECT {K}, contig, CAST((row_number() OVER (PARTITION BY contig ORDER BY e-s, {K}) - 1)//100 AS BIGINT) AS chunk FROM reads")
def read_chunks(spark, d):
    """Reads in order of length, a hundred a chunk."""
    size = F.col("e") - F.col("s")
    df = numbered(view(spark, d, "reads"), ["contig"], F.struct(size, F.shiftright("l_orderkey", 16)), size, *KEY)
    return df.selectExpr(*KEY, "contig", "k div 100 as chunk")


@q("q_realign_join", R + f", n AS (SELECT l_orderkey, s, cigar, max(s + 2) AS new_s FROM reads WHERE l_linenumber%2 = 0 GROUP BY 1, 2, 3) SELECT r.{K.replace(", ", ", r.")}, coalesce(new_s, r.s) AS s FROM reads r LEFT JOIN n ON n.l_orderkey = r.l_orderkey AND n.s = r.s AND n.cigar = r.cigar")
def realign_join(spark, d):
    """Realigned reads replace their originals by (query, position, CIGAR)."""
    r = view(spark, d, "reads")
    new = r.where("l_linenumber % 2 = 0").groupBy("l_orderkey", "s", "cigar").agg(F.max(F.col("s") + 2).alias("new_s"))
    return r.join(new, ["l_orderkey", "s", "cigar"], "left").select(*KEY, F.coalesce("new_s", "s").alias("s"))


@q("q_ref_gaps", R + " SELECT contig, CAST(s + l_quantity AS INT) AS pos, max(l_linenumber) AS gap FROM reads GROUP BY 1, 2")
def ref_gaps(spark, d):
    return G.reference_gaps(view(spark, d, "reads"))


@q("q_gap_positions", R + ", g AS (SELECT contig, CAST(s + l_quantity AS INT) AS pos, max(l_linenumber) AS gap FROM reads GROUP BY 1, 2) SELECT contig, pos, CAST(pos + coalesce(sum(gap) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col FROM g")
def gap_positions(spark, d):
    return G.gap_positions(G.reference_gaps(view(spark, d, "reads"))).select("contig", "pos", F.col("column").alias("col"))


@q("q_ungap_positions", ctes("refseq") + ", g AS (SELECT contig, start, replace(seq, 'GT', 'G-T-') AS seq FROM refseq), x AS (SELECT contig, start, i, substring(seq, i::INT, 1) AS b FROM (SELECT *, unnest(range(1, length(seq)+1)) AS i FROM g)) SELECT contig, start, i AS col, CAST(count(*) FILTER (b <> '-') OVER (PARTITION BY contig, start ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pos FROM x")
def ungap_positions(spark, d):
    """Ungapped position of every column, inside its own row's array."""
    df = view(spark, d, "refseq").select("contig", "start", F.replace("seq", F.lit("GT"), F.lit("G-T-")).alias("seq"))
    df = df.withColumn("col", F.explode(F.sequence(F.lit(1), F.length("seq")).cast("array<long>")))
    return df.select("contig", "start", "col", F.length(F.replace(F.left("seq", F.col("col").cast("int")), F.lit("-"), F.lit(""))).cast("long").alias("pos"))


@q("q_gapped_string", ctes("refseq") + " SELECT contig, start, list_aggregate(list_transform(range(0, length(seq)), lambda i: substring(seq, (i+1)::INT, 1) || CASE WHEN i%16 = 3 THEN '--' ELSE '' END), 'string_agg', '') AS seq FROM refseq")
def gapped_string(spark, d):
    """F22."""
    return view(spark, d, "refseq").select("contig", "start", F.array_join(F.transform(F.split("seq", ""), lambda b, i: F.concat(b, F.when(i % 16 == 3, "--").otherwise(""))), "").alias("seq"))


@q("q_read_to_columns", R + """, p AS (SELECT contig, unnest(range(s, (s + l_quantity + 2 + l_suppkey%7 + l_partkey%9)::INT)) AS pos, s + l_quantity AS a, s + l_quantity + 1 + l_suppkey%7 AS b FROM reads)
SELECT contig, CAST(pos AS INT) AS pos, count(*) FILTER (pos < a OR pos >= b) AS bases, count(*) FILTER (pos >= a AND pos < b) AS gaps FROM p GROUP BY 1, 2""")
def read_to_columns(spark, d):
    return G.column_counts(view(spark, d, "reads"))


@q("q_read_to_columns_whole", q.sql["q_read_to_columns"])
def read_to_columns_whole(spark, d):
    return read_to_columns(spark, d)


@q("q_md_tokens", R + f""", m AS (SELECT {K}, concat(cast(l_quantity as int), 'A', l_linenumber, '^AC', l_suppkey%7, 'T0G', l_partkey%9) AS md FROM reads),
t AS (SELECT {K}, unnest(regexp_extract_all(md, '[0-9]+|\\^[A-Z]+|[A-Z]')) AS t FROM m)
SELECT {K}, count(*) FILTER (regexp_matches(t, '^[0-9]')) AS n_match, count(*) FILTER (regexp_matches(t, '^[A-Z]')) AS n_sub, count(*) FILTER (t LIKE '^%') AS n_del FROM t GROUP BY {K}""")
def md_tokens(spark, d):
    """The MD tag's tokens by kind."""
    md = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("A"), F.col("l_linenumber").cast("string"), F.lit("^AC"), (F.col("l_suppkey") % 7).cast("string"), F.lit("T0G"), (F.col("l_partkey") % 9).cast("string"))
    n = lambda rx: F.size(F.filter("t", lambda x: x.rlike(rx))).cast("long")
    return view(spark, d, "reads").withColumn("t", F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Z]+|[A-Z])"), F.lit(1))).select(*KEY, n("^[0-9]").alias("n_match"), n("^[A-Z]").alias("n_sub"), n(r"^\^").alias("n_del"))


@q("q_size_buckets", R + " , g AS (SELECT contig, s//100 AS shard, count(*) AS size FROM reads GROUP BY 1, 2) SELECT contig, shard, size, CAST((sum(size) OVER (PARTITION BY contig ORDER BY size, shard ROWS UNBOUNDED PRECEDING) - size)//500 AS BIGINT) AS bucket FROM g")
def size_buckets(spark, d):
    """Shards in order of size, gathered up to a budget."""
    g = view(spark, d, "reads").withColumn("shard", F.expr("s div 100")).groupBy("contig", "shard").agg(F.count("*").alias("size"))
    g = carried(g, ["contig"], F.struct("size", F.shiftright("shard", 10)), before={"base": (F.sum, "size")})
    run = F.coalesce("base", F.lit(0)) + F.sum("size").over(up_to(inside(["contig"], "size", "shard")))
    return g.withColumn("run", run).selectExpr("contig", "shard", "size", "(run - size) div 500 as bucket")


# tags that agree with the CIGARs: one or two substitutions in the first run, one right after the deletion or later
_MD = """concat(cast(a as varchar(9)), 'A', case when a + 1 < n then concat('0C', cast(n - a - 2 as varchar(9))) else cast(n - a - 1 as varchar(9)) end,
'^', repeat('T', d), cast(b as varchar(9)), 'G', cast(m - b - 1 as varchar(9)))"""
_TAGGED = f"""select *, {_MD} as md, substring(repeat('ACGTTGCATCAGGA', 8), cast(1 + l_suppkey%5 as int), cast(n + l_linenumber + m as int)) as seq
from (select *, cast(l_quantity as int) as n, cast(1 + l_suppkey%7 as int) as d, cast(1 + l_partkey%9 as int) as m, cast(l_linenumber % cast(l_quantity as int) as int) as a, cast(l_orderkey % (1 + l_partkey%9) as int) as b from {{reads}}) t"""


@q("q_md_snvs", OPS + f""", g AS ({_TAGGED.format(reads="reads")}), k AS (SELECT {K}, regexp_extract_all(md, '[0-9]+|\\^[A-Z]+|[A-Z]') AS ts FROM g),
t AS (SELECT {K}, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM k),
u AS (SELECT *, sum(CASE WHEN t ~ '^[0-9]' THEN t::INT WHEN t LIKE '^%' THEN length(t) - 1 ELSE 1 END) OVER (PARTITION BY {K} ORDER BY i) - 1 AS r FROM (SELECT {K}, i, CASE WHEN t ~ '[0-9]' THEN t ELSE t END AS t FROM t)),
o AS (SELECT *, sum(CASE WHEN op IN ('M','D') THEN len ELSE 0 END) OVER w - CASE WHEN op IN ('M','D') THEN len ELSE 0 END AS r0, sum(CASE WHEN op IN ('M','I') THEN len ELSE 0 END) OVER w - CASE WHEN op IN ('M','I') THEN len ELSE 0 END AS q0 FROM ops WINDOW w AS (PARTITION BY {K} ORDER BY i))
SELECT {K}, contig, CAST(g.s + r AS INT) AS pos, t AS ref, substring(g.seq, (q0 + r - r0 + 1)::BIGINT, 1) AS alt FROM u JOIN g USING ({K}) JOIN (SELECT * EXCLUDE (contig, s, i) FROM o WHERE op = 'M') AS o USING ({K}) WHERE t ~ '^[A-Z]' AND r >= r0 AND r < r0 + len""")
def md_snvs(spark, d):
    """substitutions named by MD tags, with the reads' bases."""
    reads = spark.sql(_TAGGED, reads=view(spark, d, "reads"))
    return X.md_snvs(reads, KEY).select(*KEY, "contig", "pos", "ref", "alt")


# up to two edits a read: inside the first run, and the whole last run with a part of the deletion before it
_EDITS = """select {K}, cast(n div_ 3 as int) as start_idx, cast(n div_ 3 + n div_ 4 as int) as end_idx, 0 as del_start, 0 as del_end, 0 as excess_start, 0 as excess_end,
case when n div_ 4 >= 2 then concat('1M', cast(1 + l_partkey%3 as varchar(9)), 'D', cast(n div_ 4 - 1 as varchar(9)), 'M1I') else concat(cast(n div_ 4 + 1 as varchar(9)), 'I') end as new_cigar from {e} where l_partkey%4 <> 0
union all select {K}, cast(n + l_linenumber as int) as start_idx, cast(n + l_linenumber + m - 1 as int) as end_idx, cast(l_partkey%3 as int) as del_start, 0 as del_end, cast(l_orderkey%4 as int) as excess_start, cast(l_orderkey%2 as int) as excess_end,
case when l_suppkey%2 = 0 then concat(cast(m as varchar(9)), 'M') else concat('2D', cast(m as varchar(9)), 'M1D') end as new_cigar from {e} where l_linenumber%3 <> 0""".replace("{K}", K)
_SIZED = "select *, cast(l_quantity as int) as n, cast(1 + l_partkey%9 as int) as m from {reads}"


@q("q_spliced_reads", OPS + f""", z AS ({_SIZED.format(reads="reads")}), e AS ({_EDITS.format(e="z").replace("div_", "//")}),
ed AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY start_idx) AS k FROM e),
o AS (SELECT *, CASE WHEN op IN ('M','I') THEN len ELSE 0 END AS rl, sum(rl) OVER (PARTITION BY {K} ORDER BY i) - rl AS p FROM ops),
tot AS (SELECT {K}, sum(rl) AS total FROM o GROUP BY ALL),
chk AS (SELECT ed.*, coalesce((SELECT max(len) FROM o WHERE op = 'D' AND p = start_idx AND o.l_orderkey = ed.l_orderkey AND o.l_linenumber = ed.l_linenumber AND o.l_partkey = ed.l_partkey AND o.l_suppkey = ed.l_suppkey AND o.l_quantity = ed.l_quantity AND o.l_extendedprice = ed.l_extendedprice), 0) AS g FROM ed),
bad AS (SELECT DISTINCT {K} FROM chk WHERE excess_start > 0 AND g < excess_start),
f AS (SELECT * REPLACE (CASE WHEN excess_start > 0 THEN greatest(del_start, excess_start) ELSE del_start END AS del_start) FROM chk),
gaps AS (SELECT {K}, k, coalesce(lag(end_idx) OVER w + 1, 0) AS lo, start_idx AS hi, del_start AS off FROM f WINDOW w AS (PARTITION BY {K} ORDER BY k)
  UNION ALL SELECT {K}, max(k) + 1, max(end_idx) + 1, max(total), 0 FROM f JOIN tot USING ({K}) GROUP BY {K}),
pc AS (SELECT {K}, 2 * k AS j, i, op, CASE WHEN op = 'D' THEN CASE WHEN p BETWEEN lo AND hi THEN len - CASE WHEN p = hi THEN off ELSE 0 END ELSE 0 END ELSE least(p + len, hi) - greatest(p, lo) END AS len FROM gaps JOIN o USING ({K})
  UNION ALL SELECT {K}, 2 * k + 1, generate_subscripts(regexp_extract_all(new_cigar, {RX}), 1), unnest(regexp_extract_all(new_cigar, {RX}, 2)), CAST(unnest(regexp_extract_all(new_cigar, {RX}, 1)) AS INT) FROM f),
s1 AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY j, i) AS x FROM pc WHERE len > 0),
s2 AS (SELECT *, x - row_number() OVER (PARTITION BY {K}, op ORDER BY x) AS grp FROM s1),
s3 AS (SELECT {K}, op, min(x) AS x, sum(len) AS len FROM s2 GROUP BY {K}, op, grp),
s4 AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY x) AS a, row_number() OVER (PARTITION BY {K} ORDER BY x DESC) AS b FROM s3),
new AS (SELECT {K}, string_agg(len::BIGINT || op, '' ORDER BY x) AS cigar FROM s4 WHERE NOT (op = 'D' AND (a = 1 OR b = 1)) GROUP BY {K})
SELECT {K}, CASE WHEN new.cigar IS NULL OR bad.l_orderkey IS NOT NULL THEN z.cigar ELSE new.cigar END AS new_cigar FROM z LEFT JOIN new USING ({K}) LEFT JOIN bad USING ({K})""")
def spliced_reads(spark, d):
    """Reads with the new CIGARs of their realigned parts put in."""
    reads = spark.sql(_SIZED, reads=view(spark, d, "reads"))
    edits = spark.sql(_EDITS.replace("div_", "div"), e=reads)
    return X.rewritten(reads, edits, tuple(KEY)).select(*KEY, "new_cigar")
