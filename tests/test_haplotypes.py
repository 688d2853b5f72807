"""Haplotypes of variant groups against a plain walk, and the trimming of their ends."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from somaspark.operators import haplotypes as H

V = "id long, sample int, contig int, s int, e int, alt string"
REF = "contig int, start int, seq string"


def plain_groups(rows, base):
    """(group's span, sample) -> (haplotype, skipped), base by base."""
    groups, reach = [], None
    for v in sorted({r[1:] for r in rows}, key=lambda v: (v[2], v[3])):
        if reach is None or v[2] > reach:
            groups.append([])
        reach = v[3] if reach is None else max(reach, v[3])
        groups[-1].append(v)
    out = {}
    for g in groups:
        lo, hi = min(v[2] for v in g), max(v[3] for v in g)
        by = defaultdict(list)
        for v in g:
            by[v[0]].append(v[2:])
        for sample, edits in by.items():
            at, text, skipped = lo, "", 0
            for s, e, alt in sorted(edits):
                if s < at:
                    skipped += 1
                    continue
                text, at = text + base[at - 1 : s - 1] + alt, e
            out[lo, hi, sample] = (text + base[at - 1 : hi - 1], skipped)
    return out


def plain_trim(pos, ref, alt):
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0] and (ref[1] == alt[1] or len(ref) == len(alt)):
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    return pos, ref, alt


def test_group_haplotypes_equal_a_plain_walk(spark):
    rng = random.Random(5)
    base, rows = "".join(rng.choices("ACGT", k=640)), []
    for i in range(90):
        s = rng.randrange(2, 560)
        rows.append((i, rng.randrange(3), 0, s, s + rng.choice([0, 1, 1, 2, 9, 70]), "".join(rng.choices("ACGT", k=rng.randrange(0, 4)))))
    rows += [(200 + i, *rows[i][1:]) for i in range(5)] + [(300, None, 0, 5, 6, "A"), (301, 1, 0, None, 6, "A"), (302, 1, 0, 5, 6, None)]
    ref = spark.createDataFrame([(0, s, base[s : s + 64]) for s in range(0, 640, 64)], REF)
    got = H.group_haplotypes(spark.createDataFrame(rows, V).withColumn("group", F.lit("x")), ref).collect()
    want = plain_groups([r for r in rows if None not in r], base)
    assert {(r.s, r.e, r.sample): (r.alt, r.skipped) for r in got} == want and len(got) == len(want)
    assert any(r.skipped for r in got) and all(r.ref == base[r.s - 1 : r.e - 1] for r in got)
    for r in got:
        same = [x for x in got if x.group == r.group and x.alt == r.alt]
        assert r.n == len(same) and {x.allele for x in same} == {r.allele}
        if r.ref and r.alt:
            assert (r.pos, r.short_ref, r.short_alt) == plain_trim(r.s, r.ref, r.alt)


def test_alleles_are_numbered_by_first_sample_and_holes_are_n(spark):
    rows = [(1, 4, 0, 3, 4, "G"), (2, 2, 0, 3, 4, "T"), (3, 9, 0, 3, 4, "G"), (4, 2, 1, 63, 67, "")]
    ref = spark.createDataFrame([(0, 0, "AACCA"), (1, 0, "A" * 64)], REF)
    got = {(r.contig, r.sample): (r.ref, r.alt, r.allele, r.n) for r in H.group_haplotypes(spark.createDataFrame(rows, V), ref).collect()}
    assert got == {(0, 2): ("C", "T", 0, 1), (0, 4): ("C", "G", 1, 2), (0, 9): ("C", "G", 1, 2), (1, 2): ("AANN", "", 0, 1)}


def test_no_variants_no_groups(spark):
    assert H.group_haplotypes(spark.createDataFrame([], V), spark.createDataFrame([], REF)).count() == 0


def test_ends_are_trimmed_as_written(spark):
    rng = random.Random(7)
    texts = [(i, "".join(rng.choices("AC", k=rng.randrange(1, 7))), "".join(rng.choices("AC", k=rng.randrange(1, 7)))) for i in range(300)]
    df = spark.createDataFrame(texts, "pos int, ref string, alt string")
    got = df.select("*", H.trimmed_front(F.col("pos"), F.col("ref"), F.col("alt")).alias("t")).collect()
    assert [tuple(r.t) for r in got] == [plain_trim(*r) for r in texts]
