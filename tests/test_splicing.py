"""MD walks and spliced CIGARs against reads built base by base."""

import random
import re

from pyspark.sql import functions as F

from somaspark.operators import cigar as G
from somaspark.operators import splicing as X


def runs(ops):
    """(op, len) of a text of one op a base."""
    return [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", ops)]


def text(ops):
    return "".join(f"{n}{o}" for o, n in runs(ops))


def aligned(r):
    """A read made base by base: cigar, md, seq and its substitutions (offset on the reference, ref, alt, place in the read)."""
    ops, md, seq, subs, ref = "H" * r.choice([0, 0, 3]), [], "", [], 0
    clip = r.choice([0, 0, 4])
    ops, seq = ops + "S" * clip, seq + "".join(r.choices("ACGT", k=clip))
    for _ in range(r.randrange(1, 7)):
        for _ in range(r.randrange(1, 12)):
            base = r.choice("ACGT")
            alt = r.choice("ACGTN") if r.random() < 0.3 else base
            if alt != base:
                subs.append((ref, base, alt, len(seq)))
            md.append("=" if alt == base else base)
            ops, seq, ref = ops + "M", seq + alt, ref + 1
        what, n = r.choice("ID"), r.randrange(1, 4)
        ops += what * n
        if what == "I":
            seq += "".join(r.choices("ACGT", k=n))
        else:
            md.append("^" + "".join(r.choices("ACGT", k=n)))
            ref += n
    ops, md, seq, ref = ops + "M", [*md, "="], seq + "A", ref + 1
    tag, same = "", 0
    for x in md:
        if x == "=":
            same += 1
        else:
            tag, same = f"{tag}{same}{x}", 0
    return text(ops + "S" * r.choice([0, 2]) + "H" * r.choice([0, 5])), f"{tag}{same}", seq + "GG", subs


def test_md_snvs(spark):
    made = [aligned(random.Random(i)) for i in range(200)]
    rows = [(i, i % 3, 10 * i, c, md if i % 2 else md.lower(), seq, "".join(chr(33 + k % 60) for k in range(len(seq)))) for i, (c, md, seq, _) in enumerate(made)]
    more = [(900, 0, 5, None, "1A2", "ACGT", None), (901, 0, 5, "4M", None, "ACGT", None), (902, 0, 5, "4M", "4", "ACGT", None), (903, 0, 5, "2M", "9A", "AC", None), (904, 0, 5, "", "", "", None)]
    df = spark.createDataFrame([*rows, *more], "id int, contig int, s int, cigar string, md string, seq string, quals string")
    got = sorted((x.id, x.contig, x.pos, x.ref, x.alt, x.qual) for x in X.md_snvs(df, ["id"]).collect())
    assert got == sorted((i, i % 3, 10 * i + at, ref, alt, place % 60) for i, (_, _, _, subs) in enumerate(made) for at, ref, alt, place in subs)
    assert len(got) > 900 and {x.qual for x in X.md_snvs(df.drop("quals"), ["id"]).collect()} == {None}
    assert X.md_snvs(df.where("id < 0"), ["id"]).collect() == []


def plain(cigar, edits):
    """The edits put in one after the other, on lists of (op, len, place in the read)."""
    ops = [(o, int(n)) for n, o in re.findall(r"(\d+)([A-Z])", cigar)]
    core = "".join(o * n for o, n in ops if o != "H")
    places, at = [], 0  # the place of every character of core
    for o in core:
        places.append(at)
        at += o in "MISX="
    gap = lambda p: sum(o == "D" and q == p for o, q in zip(core, places))
    clipped = lambda p: any(o == "S" and q == p for o, q in zip(core, places))
    out, lo, off_lo = "", 0, 0
    for e in [*edits, None]:
        hi, off_hi, new = at, 0, ""
        if e:
            start, end, off_hi, off_after, excess_a, excess_z, new = e
            hi = start
            if excess_a > 0:
                if gap(start) < excess_a:
                    return cigar
                off_hi = max(off_hi, excess_a)
            if excess_z > 0:
                if gap(end + 1) >= excess_z:
                    off_after = max(off_after, excess_z)
                elif gap(end + 1) or not (end + 1 >= at or clipped(end + 1)):
                    return cigar
        left = dict.fromkeys((lo,), off_lo)
        left[hi] = left.get(hi, 0) + off_hi
        for o, p in zip(core, places):
            if o == "D" and lo <= p <= hi:
                if left.get(p, 0) > 0:
                    left[p] -= 1
                else:
                    out += o
            elif o != "D" and lo <= p < hi:
                out += o
        out += "".join(o * int(n) for n, o in re.findall(r"(\d+)([A-Z])", new))
        if e:
            lo, off_lo = end + 1, off_after
    if sum(o in "MISX=" for o in out) != at:
        return cigar
    got = [*[x for x in ops[:1] if x[0] == "H"], *runs(out), *[x for x in ops[1:][-1:] if x[0] == "H"]]
    for _ in range(2):  # the end first
        got.reverse()
        if len(got) > 2 and got[0][0] == "S" and got[1][0] == "D":
            del got[1]
        elif got[0][0] == "D":
            del got[0]
    return "".join(f"{n}{o}" for o, n in got)


def random_case(r):
    ops = "S" * r.choice([0, 0, 3])
    for _ in range(r.randrange(1, 7)):
        ops += "M" * r.randrange(1, 15) + r.choice(["", "I" * r.randrange(1, 4), "D" * r.randrange(1, 6)])
    ops += "M" * r.randrange(0, 4) + "S" * r.choice([0, 0, 2])
    size = sum(o in "MIS" for o in ops)
    edits, at = [], r.randrange(3)
    while at < size and len(edits) < 3:
        end = min(size - 1, at + r.randrange(8))
        n = end - at + 1 + (r.random() < 0.05)
        middle = "".join(r.choice("MMI") for _ in range(n))
        cut = r.randrange(n + 1)
        middle = middle[:cut] + "D" * r.randrange(3) + middle[cut:]
        edits.append((at, end, r.randrange(3), r.randrange(3), r.choice([0, 0, 0, 0, 1]), r.choice([0, 0, 0, 0, 1]), text(middle)))
        at = end + 1 + r.choice([0, 1, 5, 9])
    return ("2H" if r.random() < 0.2 else "") + text(ops) + ("7H" if r.random() < 0.2 else ""), edits


def test_spliced_cigars(spark):
    cases = [random_case(random.Random(i)) for i in range(400)]
    reads = spark.createDataFrame([(f"r{i}", i, c, 3) for i, (c, _) in enumerate(cases)] + [("none", 1, "5M", 3), ("null", 1, None, 3)], "query string, pos int, cigar string, edits int")
    edits = spark.createDataFrame([(f"r{i}", i, c, *e) for i, (c, es) in enumerate(cases) for e in es], "query string, pos int, cigar string, start_idx int, end_idx int, del_start int, del_end int, excess_start int, excess_end int, new_cigar string")
    got = {x.query: x for x in X.rewritten(reads.drop("edits"), edits).collect()}
    changed = 0
    for i, (c, es) in enumerate(cases):
        new = got[f"r{i}"].new_cigar
        assert new == plain(c, es), (c, es)
        changed += new != c
        length = lambda x: sum(int(n) for n, o in re.findall(r"(\d+)([A-Z])", x) if o in "MIS")
        assert length(new) == length(c)  # the read keeps its bases
    assert changed > 100 and got["none"].new_cigar == "5M" and got["null"].new_cigar is None


def test_joined_runs_and_long_arrays(spark):
    r = random.Random(3)
    texts = ["", "5M", *["".join(f"{r.randrange(0, 4)}{r.choice('MID')}" for _ in range(n)) for n in (1, 5, 40, 3000)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, cigar string")
    for x in df.select("i", "cigar", G.rendered(X.joined(G.parsed("cigar"))).alias("new")).collect():
        assert x.new == text("".join(o * int(n) for n, o in re.findall(r"(\d+)([A-Z])", x.cigar)))
    long = "3M1I2M1D" * 2000
    edit = F.array(F.struct(*[F.lit(v).alias(k) for k, v in (("start_idx", 600), ("end_idx", 602), ("del_start", 1), ("del_end", 0), ("excess_start", 1), ("excess_end", 0), ("new_cigar", "3M"))]))
    (x,) = spark.createDataFrame([(long,)], "cigar string").select(X.spliced(F.col("cigar"), edit).alias("new")).collect()
    assert x.new == plain(long, [(600, 602, 1, 0, 1, 0, "3M")]) != long


def test_info_tables(spark, tmp_path):
    row = (1, "q1", 10, "5M", 0, 4, 0, 0, 3, 9)
    X.write_info(spark.createDataFrame([row], X.INFO), f"{tmp_path}/info")
    assert [tuple(x) for x in X.read_info(spark, f"{tmp_path}/info").collect()] == [row]


def test_codes_are_walked_once_a_read(spark):
    """no interpreted array expressions over the codes; equal results are the other tests' matter."""
    reads = spark.createDataFrame([(1, 0, 5, "3M1I2M", "1A3", "ACGTAC"), (2, 0, 5, None, "1A3", "ACGTAC"), (3, 0, 5, "3M", "9" * 12 + "A", "ACG"), (4, 0, 5, "3M", "0a^C0t0", "GC")], "id long, contig int, s int, cigar string, md string, seq string")
    found = X.md_snvs(reads, ["id"])
    assert sorted((r.id, r.pos, r.ref, r.alt, r.qual) for r in found.collect()) == [(1, 6, "A", "C", None), (4, 5, "A", "G", None)]
    edits = spark.createDataFrame([(1, 0, 1, 0, 0, 0, 0, "1M1I"), (1, 4, 5, 0, 0, 0, 0, "2X"), (3, 0, 2, 0, 0, None, 0, "3X")], "id long, start_idx int, end_idx int, del_start int, del_end int, excess_start int, excess_end int, new_cigar string")
    new = X.rewritten(reads.select("id", "cigar"), edits, ("id",))
    assert {r.id: r.new_cigar for r in new.collect()} == {1: "1M1I1M1I2X", 2: None, 3: "3M", 4: "3M"}
    for df in (found, new):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "lambdafunction" not in plan.lower()
