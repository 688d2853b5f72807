"""Queries over tensors, channels and the scorer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from somaspark.fixtures import ctes, view
from somaspark.operators import annotations as A
from somaspark.operators import decoding as D
from somaspark.operators import network as N
from somaspark.operators import pileup as P
from somaspark.operators import tensors as T
from somaspark.operators.stretches import folder
from somaspark.sources.counts import read_counts, write_counts

from .registry import Registry

q = Registry()
LIST = "list_aggregate({}, 'string_agg', ',')"
SLICE = "list_slice(embedding, {}, {})::DOUBLE[]"


def emb(spark, d):
    return view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def part(a: int, n: int):
    return F.slice("x", a + 1, n)


def text(x, digits: int = 3):
    """Rounded values as whole numbers in one text, the same in both engines."""
    return F.array_join(F.transform(x, lambda v: F.round(v * 10**digits).cast("long").cast("string")), ",")


def sql_text(x: str, digits: int = 3) -> str:
    return f"list_aggregate(list_transform({x}, lambda v: CAST(CAST(round(v * {10**digits}) AS BIGINT) AS VARCHAR)), 'string_agg', ',')"


X4 = SLICE.format(1, 4)


@q("q_softmax", f"SELECT id, {sql_text('list_transform(e, lambda v: v / list_sum(e))')} AS p FROM (SELECT id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM (SELECT vec_id AS id, {X4} AS x FROM embeddings))")
def softmax(spark, d):
    return emb(spark, d).select("id", text(T.softmax(part(0, 4))).alias("p"))


@q("q_argmax", f"SELECT id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS best FROM (SELECT vec_id AS id, {SLICE.format(1, 16)} AS x FROM embeddings)")
def argmax(spark, d):
    return emb(spark, d).select("id", T.argmax(part(0, 16)).alias("best"))


W = [[0.5, -0.25, 0.125, 1.0], [1.0, 0.5, -0.5, 0.25]]


@q("q_dense_layer", f"SELECT id, {sql_text('[x[1]*0.5 - x[2]*0.25 + x[3]*0.125 + x[4] + 0.1, x[1] + x[2]*0.5 - x[3]*0.5 + x[4]*0.25 - 0.2]')} AS y FROM (SELECT vec_id AS id, {X4} AS x FROM embeddings)")
def dense_layer(spark, d):
    return emb(spark, d).select("id", text(T.dense(part(0, 4), W, [0.1, -0.2])).alias("y"))


@q("q_tensor_normalise", f"SELECT id, {LIST.format('list_transform(x, lambda v: greatest(0, least(255, CASE WHEN list_max(x) = 0 THEN 0 ELSE floor(v * 255.0 / list_max(x))::INT END)))')} AS b FROM (SELECT vec_id AS id, {SLICE.format(1, 32)} AS x FROM embeddings)")
def tensor_normalise(spark, d):
    return emb(spark, d).select("id", F.array_join(T.normalised(part(0, 32)), ",").alias("b"))


@q("q_freq_norm", f"SELECT id, {sql_text('list_transform(range(1, 9), lambda i: x[i] / y[i])')} AS f FROM (SELECT vec_id AS id, {SLICE.format(1, 8)} AS x, list_transform({SLICE.format(9, 16)}, lambda v: abs(v) + 1) AS y FROM embeddings)")
def freq_norm(spark, d):
    return emb(spark, d).select("id", text(T.frequency(part(0, 8), F.transform(part(8, 8), lambda v: F.abs(v) + 1))).alias("f"))


@q("q_input_transform", f"SELECT id, {sql_text('list_transform(range(1, 17), lambda i: CASE WHEN i <= 12 THEN (x[i]/255.0 - 0.5)/0.5 ELSE x[i]/255.0 END)', 5)} AS y FROM (SELECT vec_id AS id, {SLICE.format(1, 16)} AS x FROM embeddings)")
def input_transform(spark, d):
    channels = F.array(*[part(4 * i, 4) for i in range(4)])
    return emb(spark, d).select("id", text(F.flatten(T.input_transform(channels)), 5).alias("y"))


@q("q_pad_center", f"SELECT id, {sql_text('list_concat(list_concat(list_transform(range(0, g//2), lambda i: 0.0::DOUBLE), x), list_transform(range(0, g - g//2), lambda i: 0.0::DOUBLE))')} AS y FROM (SELECT *, 12 - len(x) AS g FROM (SELECT vec_id AS id, list_slice(embedding, 1, 5 + vec_id%3)::DOUBLE[] AS x FROM embeddings))")
def pad_center(spark, d):
    df = emb(spark, d).withColumn("x", F.slice("x", F.lit(1), (5 + F.col("id") % 3).cast("int")))
    return df.select("id", text(T.centred(F.col("x"), 12)).alias("y"))


@q("q_cov_channels", "SELECT id, list_aggregate(list_transform(list_concat(list_concat(list_transform(range(0, 8), lambda i: CASE WHEN i = c THEN 255.0 ELSE 0.0 END::DOUBLE), list_transform(range(0, 8), lambda i: round(least(t, 100)/100.0*255, 4)::DOUBLE)), list_transform(range(0, 8), lambda i: round(least(n, 100)/100.0*255, 4)::DOUBLE)), lambda v: CAST(CAST(round(v*10) AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS y FROM (SELECT vec_id AS id, vec_id%8 AS c, vec_id%140 AS t, vec_id%90 AS n FROM embeddings)")
def cov_channels(spark, d):
    i = F.col("id")
    return emb(spark, d).select("id", text(T.coverage_channels((i % 8).cast("int"), i % 140, i % 90, 8), 1).alias("y"))


@q("q_center_col", "SELECT id, CAST(list_position(o, list_min(o)) - 1 AS INT) AS at FROM (SELECT vec_id AS id, list_transform(range(0, 9), lambda i: abs(i*2 - vec_id%11)) AS o FROM embeddings)")
def center_col(spark, d):
    return emb(spark, d).select("id", T.centre_column(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i * 2 - F.col("id") % 11)).alias("at"))


@q("q_resize", f"SELECT id, {sql_text('list_transform(range(0, 7), lambda i: x[(floor(i*15/6.0)+1)::INT] + (x[least(floor(i*15/6.0)+2, 16)::INT] - x[(floor(i*15/6.0)+1)::INT]) * (i*15/6.0 - floor(i*15/6.0)))')} AS y FROM (SELECT vec_id AS id, {SLICE.format(1, 16)} AS x FROM embeddings)")
def resize(spark, d):
    return emb(spark, d).select("id", text(T.resized(part(0, 16), 7)).alias("y"))


@q("q_augment", f"SELECT id, {sql_text('list_transform(range(0, 16), lambda i: x[((i - s + 16) % 16 + 1)::INT])')} AS y FROM (SELECT vec_id AS id, vec_id%5 AS s, {SLICE.format(1, 16)} AS x FROM embeddings)")
def augment(spark, d):
    return emb(spark, d).select("id", text(T.shifted(part(0, 16), (F.col("id") % 5).cast("int"))).alias("y"))


PILE = ctes("preds", "bases") + ", c AS (SELECT contig, pos, " + ", ".join(f"count(*) FILTER (code = {c}) AS c{c}" for c in range(5)) + " FROM bases WHERE sample = 'tumor' GROUP BY 1, 2), sp AS (SELECT id, contig, pos, unnest(range(greatest(1, pos-3), pos+4)) AS pl FROM preds), w AS (SELECT id, pl - sp.pos AS off, " + ", ".join(f"coalesce(c{c}, 0) AS c{c}" for c in range(5)) + " FROM sp LEFT JOIN c ON c.contig = sp.contig AND c.pos = pl)"
COLS = [f"c{c}" for c in range(5)]


def windows(spark, d):
    pile = P.counts(view(spark, d, "bases").where("sample = 'tumor'"))
    return T.window_matrix(view(spark, d, "preds"), pile, 3, COLS)


@q("q_pileup_window", PILE + " SELECT id, " + ", ".join(f"string_agg({c}, ',' ORDER BY off) AS {c}" for c in COLS) + " FROM w GROUP BY id")
def pileup_window(spark, d):
    return windows(spark, d).select("id", *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in COLS])


@q("q_pileup_lookup", PILE + " SELECT id, " + ", ".join(f"string_agg({c}, ',' ORDER BY off) AS {c}" for c in COLS) + " FROM w GROUP BY id")
def pileup_lookup(spark, d):
    """q_pileup_window over the stored count table, of which only the files near a call are read."""
    path, calls = f"{folder(spark)}/counts-{uuid.uuid4().hex}", view(spark, d, "preds")
    write_counts(P.counts(view(spark, d, "bases").where("sample = 'tumor'")), path)
    df = T.window_matrix(calls, read_counts(spark, path, calls, 3), 3, COLS)
    return df.select("id", *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in COLS])


@q("q_empty_fill", PILE + ", t AS (SELECT id, max(greatest(c0,c1,c2,c3,c4)) AS top FROM w GROUP BY id) SELECT id, string_agg(CASE WHEN c0+c1+c2+c3+c4 = 0 THEN top ELSE c0 END, ',' ORDER BY off) AS c0 FROM w JOIN t USING (id) GROUP BY id")
def empty_fill(spark, d):
    return T.filled(windows(spark, d), COLS).select("id", F.array_join(F.transform("c0", lambda v: v.cast("string")), ",").alias("c0"))


@q("q_min_cov", PILE + " SELECT id, CAST(sum(c0+c1+c2+c3+c4) AS BIGINT) AS total FROM w GROUP BY id HAVING sum(c0+c1+c2+c3+c4) >= 5")
def min_cov(spark, d):
    total = sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v) for c in COLS)
    return T.covered_enough(windows(spark, d).select("id", total.alias("total")), "total")


@q("q_column_prune", PILE + ", k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off) - 1 AS i, sum(c1+c2+c3+c4) OVER (PARTITION BY id) AS depth FROM w) SELECT id, string_agg(CASE WHEN off % 2 = 0 OR c1+c2+c3+c4 > 0.1 * depth THEN i END, ',' ORDER BY i) AS kept FROM k GROUP BY id")
def column_prune(spark, d):
    ev = F.aggregate(F.array("c2", "c3", "c4"), F.col("c1"), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    df = windows(spark, d).withColumn("ev", ev).withColumn("depth", F.aggregate("ev", F.lit(0).cast("long"), lambda a, v: a + v))
    df = df.join(view(spark, d, "preds").select("id", F.greatest(F.lit(1), F.col("pos") - 3).alias("lo"), "pos"), "id")
    inserted = F.transform("ev", lambda _, i: (F.col("lo") + i - F.col("pos")) % 2 != 0)
    return df.select("id", F.array_join(F.transform(T.kept_columns(F.col("ev"), F.col("depth"), inserted, 0.1), lambda v: v.cast("string")), ",").alias("kept"))


@q("q_ref_onehot", ctes("refseq") + " SELECT contig, start, list_aggregate(flatten(list_transform(range(0, 5), lambda r: list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN instr('-ACGT', substring(seq, i::INT, 1)) - 1 = r THEN i*3 ELSE 0 END))), 'string_agg', ',') AS y FROM refseq")
def ref_onehot(spark, d):
    codes = F.transform(F.split("seq", ""), lambda b: F.position(b, F.lit("-ACGT")) - 1)
    depth = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: i * 3)
    return view(spark, d, "refseq").select("contig", "start", F.array_join(F.transform(T.one_hot(codes, depth), lambda v: v.cast("string")), ",").alias("y"))


@q("q_ref_onehot_whole", q.sql["q_ref_onehot"])
def ref_onehot_whole(spark, d):
    return ref_onehot(spark, d)


ANN = {"depth": "coverage", "mq": "mq", "bq": "bq", "nm_diff": "nm_diff", "flag": "flag", "rank_z": "rank_z"}
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@q("q_ensemble_scale", ctes("ann") + f" SELECT {KEY}, " + ", ".join(f"round((least(greatest({c}, {T.GROUPS[g][0]}::DOUBLE), {T.GROUPS[g][1]}::DOUBLE) - {T.GROUPS[g][0]}) / {T.GROUPS[g][1] - T.GROUPS[g][0]}, 3) AS {c}" for c, g in ANN.items()) + " FROM ann")
def ensemble_scale(spark, d):
    return view(spark, d, "ann").select(*KEY.split(", "), *[F.round(T.scaled(F.col(c), *T.GROUPS[g]), 3).alias(c) for c, g in ANN.items()])


MADE = {c: f"(id * {2 * i + 3} + pos) % 401 - 150" for i, c in enumerate(A.FEATURES)}


@q("q_ensemble_scale_all", ctes("preds") + ", made AS (SELECT id, " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in MADE.items()) + " FROM preds) SELECT id, " + ", ".join(f"round((least(greatest({c}, {lo}), {hi}) - ({lo})) / {hi - lo}::DOUBLE, 6) AS {c}" for c, (lo, hi) in A.FEATURES.items()) + " FROM made")
def ensemble_scale_all(spark, d):
    """all 93 features, with made-up values."""
    df = view(spark, d, "preds").selectExpr("id", *[f"cast({x} as double) as {c}" for c, x in MADE.items()])
    df = A.all_scaled(df, ["id"])
    return df.select("id", *[F.round(c, 6).alias(c) for c in A.FEATURES])


@q("q_ensemble_af", ctes("raw") + " SELECT id, dp, ro, ao, round(ao::DOUBLE / nullif(ao + ro, 0), 4) AS af FROM raw")
def ensemble_af(spark, d):
    """Columns by name, the fraction from the counts."""
    return view(spark, d, "raw").select("id", "dp", "ro", "ao", F.round(F.try_divide(F.col("ao").cast("double"), F.col("ao") + F.col("ro")), 4).alias("af"))


@q("q_decode_gate", "WITH p AS (SELECT vec_id AS id, CAST(vec_id%16 AS INT) AS centre, vec_id%16 + (vec_id%50)/10.0::DOUBLE - 1.0 AS place, [(vec_id%7)/10.0, (vec_id%5)/10.0, (vec_id%4)/10.0, (vec_id%6)/10.0] AS t FROM embeddings), b AS (SELECT *, CASE WHEN abs(place - centre) <= 0.8 THEN centre ELSE round_even(place, 0)::INT END AS pl, list_max([{'p': t[1], 'kind': 'DEL'}, {'p': t[2], 'kind': 'INS'}, {'p': t[3], 'kind': 'NONE'}, {'p': t[4], 'kind': 'SNP'}]) AS best FROM p), a AS (SELECT *, best.kind <> 'NONE' AND best.p >= 0.05 AND abs(pl - centre) <= 3 AS ok FROM b) SELECT id, CASE WHEN ok THEN best.kind ELSE 'NONE' END AS kind, CASE WHEN ok THEN pl END AS placed, best.p::DOUBLE AS p FROM a")
def decode_gate(spark, d):
    df = view(spark, d, "embeddings").selectExpr("vec_id as id", "cast(vec_id%16 as int) as centre", "vec_id%16 + (vec_id%50)/10.0D - 1.0D as place", "array((vec_id%7)/10.0D, (vec_id%5)/10.0D, (vec_id%4)/10.0D, (vec_id%6)/10.0D) as types")
    return N.decoded(df)


@q("q_network")
def network(spark, d):
    """The full network on 26 x 5 x 32 inputs that repeat each embedding."""
    df = emb(spark, d).select("id", F.flatten(F.array_repeat(F.col("x").cast("array<float>"), 65)).alias("tensor"))
    r = N.scored(df, N.random_weights(26), 26)
    return r.select("id", text(F.col("p_type")).alias("p_type"), "place", text(F.col("p_len")).alias("p_len"))


@q("q_decode_alleles")
def decode_alleles(spark, d):
    """Candidates with 16 made-up columns each; the reference around them is read from their base columns."""
    ref = "if((id*7+i*3)%5=0, array(9D,0D,0D,0D,0D), transform(array(-1,0,1,2,3), k -> if(k=(pos+i)%4, 9D, 0D)))"
    alt = "transform(array(-1,0,1,2,3), k -> if((id*3+i)%6=0, 0D, cast((id+i*5+k*7)%11 as double)))"
    df = view(spark, d, "preds").selectExpr(
        "*", f"transform(sequence(0,15), i -> {ref}) as refs", f"transform(sequence(0,15), i -> {alt}) as alts", "cast(6+id%4 as int) as centre", "6+id%4+(id%90)/10D-4.5D as place",
        "array((id%7)/20D, (id%5)/12D, (id%3)/10D, (id%6)/15D) as types", "array((id%4)/9D, (id%5)/9D, (id%3)/9D, (id%7)/20D) as lens",
    )
    shift = "(length(alt)>length(ref))"
    df = df.selectExpr("*", "filter(sequence(0,15), i -> (id*7+i*3)%5<>0) as b", f"pos + int(length(ref)>length(alt)) as p0", f"centre - int{shift} as a0")
    df = df.selectExpr("*", "p0 - size(filter(b, i -> i<a0)) as around_pos", "array_join(transform(b, i -> substring('ACGT', int((pos+i)%4+1), 1)), '') as around")
    return D.alleles(df).withColumn("prob", F.round("prob", 6))


@q("q_shift_indels", ctes("refseq") + """, x AS (SELECT contig*1000000 + start AS id, seq, 10 + start//64%20 AS pos, 1 + contig%3 AS n FROM refseq)
SELECT id, CAST(pos - coalesce((SELECT min(k) FROM range(1, 60) r(k) WHERE k > pos OR substring(seq, (pos-k+1)::INT, 1) <> substring(seq, (pos-k+n+1)::INT, 1)) - 1, 0) AS INT) AS first,
CAST(pos + (SELECT min(k) FROM range(0, 66) r(k) WHERE pos + k + n >= length(seq) OR substring(seq, (pos+k+1)::INT, 1) <> substring(seq, (pos+k+n+1)::INT, 1)) AS INT) AS last FROM x""")
def shift_indels(spark, d):
    df = view(spark, d, "refseq").selectExpr("cast(contig*1000000 + start as long) as id", "seq", "cast(10 + (start div 64)%20 as int) as pos", "1 + contig%3 as len")
    return N.shifts(df)


@q("q_merge_variants", ctes("refseq") + " SELECT contig*1000000 + start AS id, concat(substring(seq, 1, 5), 'TT', substring(seq, 7, 13), 'G', substring(seq, 23)) AS haplotype FROM refseq")
def merge_variants(spark, d):
    df = view(spark, d, "refseq").selectExpr("cast(contig*1000000 + start as long) as id", "seq", "array(struct(5 as pos, 1 as ref_len, 'TT' as alt), struct(19 as pos, 3 as ref_len, 'G' as alt), struct(20 as pos, 1 as ref_len, 'C' as alt)) as edits")
    return N.haplotypes(df)


@q("q_msa_align")
def msa_align(spark, d):
    """Whole sequences, each with three made-up reads whose insertions differ."""
    reads = "array(concat(substring(seq, 1, 10), substring(seq, 13, 6), 'GG', substring(seq, 19)), concat(substring(seq, 1, 18), 'T', substring(seq, 19)), concat(substring(seq, 1, 40), 'CCA', substring(seq, 45)))"
    df = view(spark, d, "refseq").selectExpr("cast(contig*1000000 + start as long) as id", "seq as reference", f"posexplode({reads}) as (n, read)")
    return N.jointly_aligned(df)


@q("q_codec", f"SELECT vec_id AS id, {LIST.format('list_transform(range(1, 33), lambda i: floor(abs(embedding[i::INT]::DOUBLE) * 50)::INT % 256)')} AS x FROM embeddings")
def codec(spark, d):
    """written and read back."""
    df = emb(spark, d).select("id", F.transform(part(0, 32), lambda v: (F.floor(F.abs(v) * 50) % 256).cast("int")).alias("tensor"))
    return N.unpacked(N.packed(df)).select("id", F.array_join("unpacked", ",").alias("x"))
