"""Rule 2 of labelling (merged and shifted runs) against a plain search over all pairs of runs."""

import random
from collections.abc import Iterator

from pyspark.sql import functions as F

from somaspark.fixtures import view
from somaspark.operators import calls as C
from somaspark.operators.intervals import range_join

V = "id long, contig int, pos int, ref string, alt string"


def _merged(run: list[tuple]) -> tuple[list[tuple[int, str, str]], int, int] | None:
    """The edits of variants in order (pos, ref, alt), their begin and end; None where they overlap.
    An indel may begin with the last base of the variant before it."""
    edits, end = [], None
    for pos, ref, alt in run:
        if len(run) > 1 and "," in alt or end is not None and pos < end - (len(ref) != len(alt)):
            return None
        edits.append((pos, ref, alt) if end is None or pos >= end else (end, ref[1:], alt[1:]))
        end = pos + len(ref)
    return edits, run[0][0], end


def _haplotype(edits: list[tuple[int, str, str]], lo: int, hi: int, base: dict[int, str], other: dict[int, str]) -> tuple[str, str] | None:
    """Reference and changed bases of [lo, hi); bases between the edits from base, else from the REF
    alleles of the other side; None where neither has one."""
    ref, alt, at = [], [], lo
    for pos, r, a in [*edits, (hi, "", "")]:
        gap = [base.get(p, other.get(p)) for p in range(at, pos)]
        if None in gap:
            return None
        ref += [*gap, r]
        alt += [*gap, a]
        at = pos + len(r)
    return "".join(ref), "".join(alt)


def equivalent(left: list[tuple], right: list[tuple], base: dict[int, str]) -> bool:
    """Whether two runs of variants turn the reference into the same sequence."""
    a, b = _merged(left), _merged(right)
    if not a or not b or any("," in v[2] for v in (*left, *right)):
        return False
    refs = [{p + i: x for p, r, _ in edits for i, x in enumerate(r)} for edits in (a[0], b[0])]
    lo, hi = min(a[1], b[1]), max(a[2], b[2])
    h = _haplotype(a[0], lo, hi, base, refs[1])
    return h is not None and h == _haplotype(b[0], lo, hi, base, refs[0])


def _explained(js_of: dict[int, list], truths_of: dict[int, list], var: dict, truth: dict, order: list[int], base: dict[int, str]) -> set[int]:
    """L2 of one island: the calls that, merged over consecutive runs, equal a run of truths."""
    grown = lambda v: len(v[2]) - len(v[1])
    done: set[int] = set()

    def runs(ids: list[int], of: dict) -> Iterator[tuple[list[int], list[tuple], int]]:
        for i in range(len(ids)):
            for n in range(i, len(ids)):
                part = [of[k] for k in ids[i : n + 1]]
                if not _merged(part):
                    break  # a longer run overlaps as well
                yield ids[i : n + 1], part, sum(map(grown, part))

    for t in order:
        js = js_of[t]
        if done & set(js):
            continue
        here: set[int] = set()
        tried = list(runs(js, var))
        for _, want, growth in runs(sorted({i for j in js for i in truths_of[j]}, key=lambda i: (truth[i][0], i)), truth):
            for ids, got, g in tried:
                if g == growth and not here & set(ids) and equivalent(want, got, base):
                    here |= set(ids)
            if here >= set(js):
                break
        done |= here
    return done


def variants(rng, base, n, first_id, contig):
    out = set()
    for _ in range(n):
        p, size = rng.randrange(2, len(base) - 4), rng.choice([1, 1, 2, 2, 3])
        ref = base[p : p + size]
        alt = rng.choice([ref[0], ref[0] + "".join(rng.choices("AC", k=rng.randrange(1, 3))), "".join(rng.choices("AC", k=size))])
        if alt != ref:
            out.add((contig, p + 1, ref, alt))
    return [(first_id + i, *v) for i, v in enumerate(sorted(out))]


def rewritten(rng, base, v):
    """The same change in other words: an indel elsewhere, or several bases one by one."""
    contig, pos, ref, alt = v[1:]
    if len(ref) == len(alt):
        return [(i, contig, pos + i, x, y) for i, (x, y) in enumerate(zip(ref, alt, strict=True)) if x != y]
    made = base[: pos - 1] + alt + base[pos - 1 + len(ref) :]
    grown, size = max(len(alt) - len(ref), 0), max(len(ref) - len(alt), 0)
    ways = [(p + 1, base[p : p + 1 + size], base[p] + made[p + 1 : p + 1 + grown]) for p in range(1, len(base) - 4) if base[: p + 1] + made[p + 1 : p + 1 + grown] + base[p + 1 + size :] == made]
    return [(0, contig, *rng.choice(ways))] if ways else []


def plain_matches(calls, truths, base, pad=5):
    edges = [(c, t) for c in calls for t in truths if c[1] == t[1] and c[2] - pad < t[2] + len(t[3]) and t[2] < c[2] + len(c[3]) + pad]
    closed = {t[0] for c, t in edges if c[2:] == t[2:]}
    good = {c[0] for c, t in edges if c[2:] == t[2:]}
    closed |= {t[0] for c, t in edges if c[0] in good}
    edges = sorted(edges, key=lambda e: (e[0][2], e[0][0], e[1][2], e[1][0]))
    js_of, truths_of, order = {}, {}, []
    for c, t in edges:
        truths_of.setdefault(c[0], []).append(t[0])
        if t[0] not in closed:
            if t[0] not in js_of:
                order.append(t[0])
            js_of.setdefault(t[0], []).append(c[0])
    var, truth = {c[0]: c[2:] for c in calls}, {t[0]: t[2:] for t in truths}
    return _explained(js_of, truths_of, var, truth, order, base)


def test_merged_matches_equal_a_search_over_all_pairs(spark):
    rng = random.Random(3)
    calls, truths, chunks, want = [], [], [], set()
    for contig in range(300):
        base = "".join(rng.choices("AC", weights=[7, 1], k=40))
        a, b = variants(rng, base, rng.randrange(1, 6), contig * 100, contig), variants(rng, base, rng.randrange(1, 5), contig * 100, contig)
        a = [v for v in a if rng.random() < 0.4] + [w for v in b if rng.random() < 0.6 for w in rewritten(rng, base, v)]
        a = [(contig * 100 + i, *v) for i, v in enumerate(sorted({v[1:] for v in a}))]
        calls, truths = calls + a, truths + b
        chunks += [(contig, s, base[s : s + 16]) for s in (0, 16, 32)]
        want |= plain_matches(a, b, {i + 1: x for i, x in enumerate(base)})
    c, t, ref = spark.createDataFrame(calls, V), spark.createDataFrame(truths, V), spark.createDataFrame(chunks, "contig int, start int, seq string")
    edges = C.kept(C.truth_edges(c, t))
    good = edges.where("pos = r_pos and ref = r_ref and alt = r_alt").select("id").distinct()
    got = {r.id for r in C.merged_matches(edges, good, ref).collect()}
    assert len(want) > 60 and got == want


def test_hulls_take_holes_from_alleles_and_overlapping_chunks_once(spark):
    hulls = spark.createDataFrame([(1, 0, 3, 12, [(7, "GT")]), (2, 0, 30, 33, []), (3, 0, 5, 6, [])], "hull long, contig int, s int, e int, known array<struct<pos: int, ref: string>>")
    ref = spark.createDataFrame([(0, 0, "AACC"), (0, 2, "CCA"), (0, 8, "TTT")], "contig int, start int, seq string")
    got = {r.hull: r.seq for r in C.hull_bases(hulls, ref, F.col("known")).collect()}
    assert got == {1: "CCANGTTTT", 2: "NNN", 3: "A"}


def test_records_that_cannot_be_merged_end_a_run(spark):
    rows = [(1, 2, "A", "C"), (2, 3, "C", "A,G"), (3, 4, "G", "T"), (4, 5, "A", "G"), (5, 5, "TA", "T"), (6, 6, "AC", "A")]
    df = spark.createDataFrame([(0, *r, 1, "AACGTACC") for r in rows], "hull int, vid long, pos int, ref string, alt string, s int, seq string")
    got = {tuple(x.vid for x in r.run) for r in C.variant_runs(df, ["hull"]).collect()}
    # 2 has two alternatives, 4 has the wrong REF, 6 begins with the last base of 5
    assert got == {(1,), (3,), (5,), (6,), (5, 6)}


def test_every_rule_labels_rows(spark):
    d = "/root/testdata/sf0.001"
    calls = view(spark, d, "sparse_calls")
    got = C.label_cascade(calls, view(spark, d, "sparse_truth"), view(spark, d, "genome")).join(calls.select("id", (F.shiftright("id", 4) % 10).alias("kind")), "id")
    rules = {(r.kind, r.rule) for r in got.select("kind", "rule").distinct().collect()}
    assert rules == {(0, 1), (1, 2), (2, 2), (3, 2), (4, 2), (5, 3), (6, 6), (7, 7), (8, 4), (9, 8)}


def test_a_view_is_made_from_those_at_hand(spark):
    genome = spark.createDataFrame([(c, 64 * i, "ACGTTGCA" * 8) for c in (1, 2) for i in range(30)], "contig int, start int, seq string")
    spaced = view(spark, "/nowhere", "spaced", genome=genome)
    calls = view(spark, "/nowhere", "sparse_calls", spaced=spaced)  # reads no table
    assert {r.id % 16 for r in calls.collect()} == set(range(12))
    assert view(spark, "/nowhere", "phased", genome=genome).count() == 8 * 20


def test_rows_that_meet_as_they_are_make_the_same_pairs(spark):
    rng = random.Random(7)
    sides = [spark.createDataFrame([(i, rng.randrange(2), s, s + rng.randrange(1, 9 if i % 5 else 200)) for i, s in enumerate(rng.choices(range(150), k=80))], "id int, contig int, s int, e int") for _ in range(2)]
    for strategy in ("binned", "auto"):
        got, want = (sorted(map(tuple, range_join(*sides, 5, strategy=strategy, copies=n).collect())) for n in (1, 2))
        assert got == want and len(got) > 80


def test_shifts_look_across_chunks_and_stop_at_the_hull(spark):
    ref = spark.createDataFrame([(1, 8 * i, "ACACACAC") for i in range(4)], "contig int, start int, seq string")
    rows = [(1, 1, 15, "ACA", "A", 5, 26), (2, 1, 15, "ACA", "A", 14, 17), (3, 9, 15, "ACA", "A", 5, 26), (4, 1, 15, "A", "C", 5, 26)]
    got = C.shift_ranges(spark.createDataFrame(rows, V + ", lo int, hi int"), ref)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 25), (2, 14, 16), (3, 15, 15)]
