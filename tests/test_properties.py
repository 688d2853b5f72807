"""Properties and rule corners of the operators on small typed tables."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from somaspark.fixtures import view
from somaspark.functions import variants as V
from somaspark.operators import calls, candidates, cigar, intervals, network, pileup, tensors
from somaspark.plans import catalog
from somaspark.sources import text

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_intervals(seed, n, span=300):
    r = random.Random(seed)
    return [(i, r.randrange(3), (s := r.randrange(span)), s + r.randrange(1, 30)) for i in range(n)]


IV = "id long, contig int, s int, e int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joins_agree_and_partition_the_left_side(spark, seed):
    a, b = frame(spark, random_intervals(seed, 60), IV), frame(spark, random_intervals(seed + 9, 40), IV)
    pairs = lambda df: sorted((r.id, r.r_id) for r in df.collect())
    for pad in (0, 5):
        want = sorted((x.id, y.id) for x in a.collect() for y in b.collect() if x.contig == y.contig and x.s - pad < y.e and y.s < x.e + pad)
        assert pairs(intervals.range_join(a, b, pad, size=16)) == want
        assert pairs(intervals.range_join(a, b, pad, strategy="plain")) == want
        semi, anti = ({r.id for r in f(a, b, pad=pad).collect()} for f in (intervals.range_semi, intervals.range_anti))
        assert semi | anti == set(range(60)) and not semi & anti and semi == {x for x, _ in want}


@pytest.mark.parametrize("size", [8, 1 << 16])
def test_merge_keeps_covered_bases(spark, size):
    rows = random_intervals(5, 80)
    df = frame(spark, rows, IV)
    covered = {(c, p) for _, c, s, e in rows for p in range(s, e)}
    once = intervals.merge(df, size=size)
    got = once.collect()
    assert {(r.contig, p) for r in got for p in range(r.s, r.e)} == covered
    assert sum(r.e - r.s for r in got) == len(covered) and sum(r.n for r in got) == len(rows)
    again = intervals.merge(once.select("contig", "s", "e"), size=size).collect()
    assert sorted((r.contig, r.s, r.e) for r in again) == sorted((r.contig, r.s, r.e) for r in got)
    depth = {(r.contig, p): r.depth for r in intervals.coverage(df).collect() for p in range(r.s, r.e)}
    assert depth == {k: sum(c == k[0] and s <= k[1] < e for _, c, s, e in rows) for k in covered}
    pieces = intervals.disjoint(df).collect()
    assert sorted((r.contig, p) for r in pieces for p in range(r.s, r.e)) == sorted(covered)


def test_interval_corners(spark):
    df = frame(spark, [(1, 0, 0, 10), (2, 0, 10, 20), (3, 0, 21, 30), (4, 0, 0, 10)], IV)
    assert [(r.s, r.e, r.n) for r in intervals.merge(df).orderBy("s").collect()] == [(0, 20, 3), (21, 30, 1)]  # book-ended merge, copies count
    assert intervals.merge(df.where("false")).count() == 0
    tiles = intervals.tile(frame(spark, [(1, 0, 0, 37)], IV), 10).orderBy("tile").collect()
    assert [(t.tile_s, t.tile_e) for t in tiles] == [(0, 10), (10, 20), (20, 37)]  # the tail joins the last window
    parts = intervals.split_regions(frame(spark, [(i, 0, 100 * i, 100 * i + 50) for i in range(20)], IV), 4).collect()
    assert {p.part for p in parts} == {0, 1, 2, 3}


def test_pileup_rules(spark):
    rows = [(0, p, c, 1) for p, codes in ((1, [1, 1, 2, 2]), (2, [1] * 6 + [0] * 3 + [3] * 2), (3, [2, 2, 2]), (4, [1, 1])) for c in codes]
    c = pileup.counts(frame(spark, rows, "contig int, pos int, code int, refcode int"))
    mm = {r.pos: (r.major, r.minor) for r in pileup.major_minor(c).collect()}
    assert mm[1] == (1, 2)  # a tie keeps the order A, C, G, T
    assert mm[2] == (1, 3)  # a gap minor gives way to a base of more than half its count
    raw = {r.pos: (r.alt, r.ro, r.ao, r.af) for r in pileup.raw_candidates(c).collect()}
    assert raw[3] == (2, 0, 3, 1.0) and 4 not in raw and raw[1] == (2, 2, 2, 0.5)


def test_known_sites(spark):
    calls_ = frame(spark, [(1, 0, 5, "A", "C"), (2, 0, 6, "A", "C"), (3, 0, 7, "A", "C"), (4, 0, 8, "A", "C")], "id long, contig int, pos int, ref string, alt string")
    known = frame(spark, [(0, 5, "A", "C"), (0, 6, "A", "C"), (0, 6, "A", "G"), (0, 7, "A", "T")], "contig int, pos int, ref string, alt string")
    assert {r.id for r in candidates.without_known(calls_, known).collect()} == {2, 3, 4}
    assert {r.id for r in candidates.without_known(calls_, known, strict=True).collect()} == {3, 4}


def test_deletion_runs_cross_stretches(spark):
    rows = [(0, p, "ACGT"[p % 4], p, 1) for p in (*range(250, 262), 300)]
    got = candidates.deletion_runs(frame(spark, rows, "contig int, pos int, base string, ao int, ro int")).orderBy("pos").collect()
    assert [(r.pos, len(r.ref), r.ao) for r in got] == [(250, 12, 261), (300, 1, 300)]


def test_alleles_and_scores(spark):
    rows = [("ACGT", "ACT"), ("A", "A"), ("GAAT", "GT"), ("ACA", "AGA"), ("TT", "TTT")]
    df = frame(spark, rows, "ref string, alt string")
    c = F.col
    once = df.select(V.trimmed(F.lit(10), c("ref"), c("alt")).alias("t"))
    twice = once.select("t", V.trimmed(c("t.pos"), c("t.ref"), c("t.alt")).alias("u")).collect()
    assert all(r.t == r.u for r in twice)
    assert [tuple(r.t) for r in twice] == [(11, "CG", "C"), (10, "A", "A"), (10, "GAA", "G"), (11, "C", "G"), (10, "T", "TT")]
    x = frame(spark, [(0.0,), (0.4,), (0.7,), (1.0,), (0.9995,)], "p double")
    got = x.select(V.filter_label(c("p")), V.phred(c("p")), V.unphred(V.phred(c("p")))).collect()
    assert [r[0] for r in got] == ["REJECT", "LowQual", "PASS", "PASS", "PASS"] and got[3][1] == 100.0 and got[4][2] == 0.9995


def test_cigar(spark):
    df = frame(spark, [("5M2I3D4M", 100), ("3S4M", 0), ("2M3M1I1I", 7)], "cigar string, s int")
    ops = cigar.parsed("cigar")
    got = df.select(cigar.rendered(ops), cigar.rendered(cigar.merged(ops)), cigar.indels(ops, F.col("s"))).collect()
    assert [r[0] for r in got] == ["5M2I3D4M", "3S4M", "2M3M1I1I"] and got[2][1] == "5M2I"
    assert [tuple(x) for x in got[0][2]] == [("I", 105, 2), ("D", 105, 3)]
    n = cigar.column_rows(df.withColumn("contig", F.lit(0)), ["contig"]).groupBy("base").count().collect()
    assert {r["base"]: r["count"] for r in n} == {True: 18, False: 3}


def test_label_cascade_gives_truths_to_the_first_rule(spark):
    v = "id long, contig int, pos int, ref string, alt string"
    got = {r.id: (r.label, r.rule) for r in calls.label_cascade(frame(spark, [(1, 0, 10, "A", "C"), (2, 0, 10, "A", "G"), (3, 0, 31, "AC", "A"), (4, 0, 90, "A", "T")], v), frame(spark, [(7, 0, 10, "A", "C"), (8, 0, 30, "AG", "A")], v)).collect()}
    assert got == {1: ("SNP", 1), 2: ("SNP", 3), 3: ("DEL", 7), 4: ("NONE", 8)}


def test_whole_cascade_has_all_rules(spark):
    v = "id long, contig int, pos int, ref string, alt string"
    truth = [(1, 0, 3, "CA", "C"), (2, 0, 20, "ACG", "TCT"), (3, 0, 40, "ACGT", "A"), (4, 0, 60, "A", "C"), (5, 0, 80, "A", "AC"), (6, 0, 100, "A", "AT"), (7, 0, 120, "A", "G")]
    got = [
        (1, 0, 5, "AA", "A"), (2, 0, 20, "A", "T"), (3, 0, 22, "G", "T"), (4, 0, 42, "G", "T"), (5, 0, 62, "GT", "G"), (6, 0, 63, "T", "TC"), (7, 0, 81, "G", "T"), (8, 0, 101, "C", "CG"),
        (9, 0, 120, "A", "G"), (10, 0, 120, "A", "C"), (11, 0, 123, "A", "C"), (12, 0, 500, "A", "C"),
    ]
    ref = frame(spark, [(0, 0, "GGCAAAAATCC"), (0, 20, "C")], "contig int, start int, seq string")
    got = {r.id: (r.label, r.rule) for r in calls.label_cascade(frame(spark, got, v), frame(spark, truth, v), ref).collect()}
    assert got == {
        1: ("DEL", 2), 2: ("SNP", 2), 3: ("SNP", 2), 4: ("DEL", 3), 5: ("DEL", 4), 6: ("INS", 4), 7: ("INS", 6), 8: ("INS", 7),
        9: ("SNP", 1), 10: ("SNP", 3), 11: ("NONE", 8), 12: ("NONE", 8),
    }


def test_shift_ranges_follow_repeats(spark):
    v = frame(spark, [(1, 0, 5, "AA", "A", 1, 11), (2, 0, 3, "C", "CA", 1, 11), (3, 0, 3, "C", "G", 1, 11), (4, 0, 5, "AA", "A", 5, 7)], "id long, contig int, pos int, ref string, alt string, lo int, hi int")
    ref = frame(spark, [(0, 0, "GGCAAAA"), (0, 7, "ATCC")], "contig int, start int, seq string")
    assert {r.id: (r["first"], r["last"]) for r in calls.shift_ranges(v, ref).collect()} == {1: (3, 7), 2: (3, 8), 4: (5, 6)}


def test_exact_clusters_keep_long_overlaps_apart(spark):
    v = frame(spark, [(1, 0, 100, "A" * 40, "A"), (2, 0, 110, "A" * 20, "A"), (3, 0, 141, "A", "C")], "id long, contig int, pos int, ref string, alt string")
    assert len({(r.contig, r.cluster) for r in calls.cluster_calls(v).collect()}) == 1
    assert {r.id: r.part for r in calls.cluster_calls_exact(v).collect()} == {1: 0, 2: 1, 3: 0}


def plain_parts(rows, gap):
    """(contig, part's opener) by id, one call after the other."""
    parts, out = {}, {}
    for i, c, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        mine = parts.setdefault(c, [])
        hit = next((p for p in reversed(mine) if any(abs(min(e, b) - max(s, a)) <= gap for _, a, b in p)), None)
        if hit is None:
            mine.append(hit := [])
        hit.append((i, s, e))
        out[i] = hit[0][0]
    return out


def test_exact_clusters_across_stretches(spark):
    """Chains of calls that run over many stretches, long deletions over several, ties and a lone call."""
    r = random.Random(8)
    rows = [(i, r.randrange(2), s, s + r.choice([1, 1, 1, 2, 6, 12, 40, 90])) for i in range(500) for s in [r.randrange(1500)]]
    rows += [(1000 + i, 2, 3 * i, 3 * i + 1) for i in range(200)] + [(2000, 3, 5, 6), (2001, 4, 7, 8), (2002, 4, 7, 8)]
    v = frame(spark, [(i, c, s, "A" * (e - s), "C") for i, c, s, e in rows], "id long, contig int, pos int, ref string, alt string")
    want = plain_parts(rows, 5)
    for size in (1 << 16, 1 << 5):
        got = calls.cluster_calls_exact(v, size=size).collect()
        parts = {}
        for x in got:
            parts.setdefault((x.contig, x.cluster, x.part), set()).add(want[x.id])
        assert len(got) == len(rows) and all(len(p) == 1 for p in parts.values()) and len(parts) == len(set(want.values()))
        at = {i: (c, s, e, i) for i, c, s, e in rows}
        for c, cluster in {(x.contig, x.cluster) for x in got}:
            opened = [next(iter(parts[k])) for k in sorted(k for k in parts if k[:2] == (c, cluster))]
            assert [k[2] for k in sorted(k for k in parts if k[:2] == (c, cluster))] == list(range(len(opened))) and opened == sorted(opened, key=at.get)
    assert calls.cluster_calls_exact(v.where("id < 0")).collect() == []


def test_tensor_helpers(spark):
    df = frame(spark, [([1.0, 5.0, 3.0],)], "x array<double>")
    r = df.select(tensors.softmax(F.col("x")), tensors.centred(F.col("x"), 6), tensors.resized(F.col("x"), 5), tensors.normalised(F.col("x")), tensors.argmax(F.col("x"))).first()
    assert abs(sum(r[0]) - 1) < 1e-12 and r[1] == [0, 1, 5, 3, 0, 0] and r[2] == [1, 3, 5, 4, 3] and r[3] == [51, 255, 153] and r[4] == 1


def test_alignment_recovers_sequences():
    r = random.Random(4)
    for _ in range(30):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randrange(1, 14))) for _ in range(2))
        x, y = network.align(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y) and not any(p == q == "-" for p, q in zip(x, y, strict=True))
    assert network.align("ACGT", "ACGT") == ("ACGT", "ACGT")


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.bed").write_text("1\t10\t5\n2\t1\t4\n")
    assert sorted(map(tuple, text.read_bed(spark, str(tmp_path / "a.bed")).collect())) == [("1", 5, 10), ("2", 1, 4)]
    df = frame(spark, [(1, "2", 7, None, "A", "C", 33.0111, "PASS", "SCORE=0.9995", "GT", "0/1"), (0, "1", 9, None, "G", "T", 10.0, "LowQual", "SCORE=0.9", "GT", "0/1")], "ord int, contig string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, sample string")
    text.write_vcf(df, str(tmp_path / "v"), frame(spark, [(0, "1", 50), (1, "2", 60)], "ord int, name string, len int"))
    back = text.read_vcf(spark, f"{tmp_path}/v/*").orderBy("contig").collect()
    assert [(r.contig, r.pos, r.qual) for r in back] == [("1", 9, 10.0), ("2", 7, 33.0111)]
    (tmp_path / "bad.vcf").write_text("1 2 3\n")
    assert text.read_vcf(spark, str(tmp_path / "bad.vcf"), strict=False).count() == 0
    with pytest.raises(Exception, match="not ten fields"):
        text.read_vcf(spark, str(tmp_path / "bad.vcf")).collect()
    (tmp_path / "n.tsv").write_text("CHROM\tPOS\tREF\tALT\tx\ty\n1\t5\tAC\tA\tTrue\tnan\n")
    r = text.read_annotations(spark, str(tmp_path / "n.tsv"), ["x", "y"]).first()
    assert (r.end, r.x, r.y) == (7, 1.0, 0.0)
    with pytest.raises(ValueError, match="missing"):
        text.read_annotations(spark, str(tmp_path / "n.tsv"), ["z"])
    line = text.count_line(frame(spark, [("1", 4, 2, [1, 2])], "contig string, pos int, refcode int, n array<int>"), ["n"]).first().value
    assert re.split("\t", line) == ["1", "4", "5", "C", "1:2"]


def test_read_to_columns_whole_has_all_reads(spark):
    want = {}
    for r in view(spark, DATA, "reads").collect():
        at = r.s
        for n, op in re.findall("([0-9]+)([MID])", r.cigar):
            for p in range(at, at + int(n)) if op != "I" else ():
                want.setdefault((r.contig, p), [0, 0])[op == "D"] += 1
                at += 1
    got = {(r.contig, r.pos): [r.bases, r.gaps] for r in catalog.queries()["q_read_to_columns_whole"](spark, DATA).collect()}
    assert got == want


def test_consensus_takes_the_best_code_of_all_contigs(spark):
    rows = [(c, p, x, 1) for c, p, codes in ((0, 1, [1, 2, 2, 3]), (0, 2, [1] * 9 + [4]), (7, 1, [1, 0, 3]), (9, 1, [1, 1])) for x in codes]
    got = {(r.contig, r.pos): (r.code, r.ao, r.ro, round(r.af, 4)) for r in calls.consensus(frame(spark, rows, "contig int, pos int, code int, refcode int")).collect()}
    assert got == {(0, 1): (2, 2, 1, 0.6666), (7, 1): (3, 1, 1, 0.5)}
    assert {r.contig for r in catalog.queries()["q_msa_consensus_whole"](spark, DATA).collect()} == {r.contig for r in view(spark, DATA, "bases").where("code <> refcode").select("contig").distinct().collect()}


def test_joint_alignment_shares_insertion_columns(spark):
    reads = [(1, 0, "ACGTCATGAC", "ACGTTTCATGAC"), (1, 1, "ACGTCATGAC", "ACGTCATGGAC"), (1, 2, "ACGTCATGAC", "ACGTCTGAC"), (2, 0, "AC", "AC"), (3, 0, "AC", "")]
    got = {(r.id, r.n): r for r in network.jointly_aligned(frame(spark, reads, "id long, n int, reference string, read string")).collect()}
    assert len(got) == 5 and len({(got[1, n].reference, len(got[1, n].read)) for n in range(3)}) == 1
    for i, n, ref, read in reads:
        assert got[i, n].reference.replace("-", "") == ref and got[i, n].read.replace("-", "") == read
    assert got[1, 0].reference.count("-") == 3 and got[2, 0].reference == "AC" and got[3, 0].read == "--"


def test_sequences_are_taken_whole(spark):
    seqs = {(r.contig, r.start): r.seq for r in view(spark, DATA, "refseq").collect()}
    for r in catalog.queries()["q_msa_align"](spark, DATA).collect():
        assert r.reference.replace("-", "") == seqs[r.id // 1000000, r.id % 1000000]
    for r in catalog.queries()["q_ref_onehot_whole"](spark, DATA).collect():
        seq = seqs[r.contig, r.start]
        assert r.y == ",".join(str(3 * (i + 1) if b == x else 0) for x in "-ACGT" for i, b in enumerate(seq))


def sites(spark, rows):
    """(pos, ref, alt, dp, ro, ao) to raw records of one contig."""
    from somaspark.operators.candidates import ATTRIBUTES

    rest = [c for c in ATTRIBUTES if c not in ("dp", "ro", "ao")]
    full = [(i, 0, p, r, a, dp, ro, ao, *([i] * len(rest))) for i, (p, r, a, dp, ro, ao) in enumerate(rows)]
    return frame(spark, full, "id long, contig int, pos int, ref string, alt string, " + ", ".join(f"{c} int" for c in ("dp", "ro", "ao", *rest)))


def test_indel_merging_corners(spark):
    from somaspark.operators import candidates as C

    ins = [(10, "N", "A", 50, 10, 10), (10, "N", "C", 60, 20, 4), (10, "N", "G", 40, 10, 9), (20, "N", "T", 5, 1, 9), (21, "N", "T", 6, 1, 9)]
    got = {(r.pos, r.alt, r.dp, r.ro, r.ao, r.mq) for r in C.merged_insertions(sites(spark, ins)).collect()}
    assert got == {(10, "AG", 50, 10, 10, 2), (21, "T", 6, 1, 9, 4)}  # C is under half of the largest fraction; 20 is too shallow
    dels = [
        (1, "A", "N", 50, 10, 10), (2, "C", "N", 50, 10, 10), (3, "G", "N", 50, 10, 1), (4, "T", "N", 50, 10, 10),  # G goes
        (4, "T", "G", 50, 10, 10),  # an SNP: 4 begins a run of its own
        (6, "A", "N", 50, 900, 12), (8, "A", "N", 50, 900, 12), (9, "A", "G", 50, 1, 0),  # a gap ends 6, an SNP ends 8
        (70_000, "C", "N", 50, 10, 10), (65_535, "A", "N", 50, 10, 10), (65_536, "C", "N", 50, 10, 10),  # over a stretch's end
        (70_001, "C", "N", 5, 10, 10),  # too shallow
    ]
    df = sites(spark, dels)
    got = {(r.pos, r.ref) for r in C.merged_deletions(df, C.merged_insertions(df)).collect()}
    assert got == {(1, "AC"), (4, "T"), (8, "A"), (65_535, "AC"), (70_000, "C")}
    assert C.merged_deletions(df.where("false"), df.where("false")).collect() == []


def test_stretches_agree_with_whole_windows(spark):
    from somaspark.operators import intervals as I  # noqa: E741

    r = random.Random(12)
    rows = [(i, i % 3, s, s + r.randrange(1, 200)) for i in range(400) for s in [r.randrange(20_000)]]
    df = frame(spark, rows, "id long, contig int, s int, e int")
    for gap in (0, 30):
        want = {}
        for c in range(3):
            island, reach = 0, None
            for i, _, s, e in sorted((x for x in rows if x[1] == c), key=lambda x: (x[2], x[3])):
                island += reach is None or s > reach + gap
                reach = e if reach is None else max(reach, e)
                want[i] = island
        for size in (16, 256, 1 << 16):
            assert {x.id: x.island for x in I.islands(df, gap, size=size).collect()} == want
    whole = sorted(map(tuple, I.coverage(df).collect()))
    assert sorted(map(tuple, I.coverage(df, size=32).collect())) == whole
    assert sum((e - s) * n for _, s, e, n in whole) == sum(e - s for _, _, s, e in rows)
    assert I.bin_size(df, df) == 128 and I.range_join(df, df, strategy="auto").count() == I.range_join(df, df, size=16).count() == I.range_join(df, df, strategy="plain").count()
