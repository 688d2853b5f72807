"""Repeat runs and extended regions against a walk base by base; as-of joins against a scan."""

import random

import pytest

from somaspark.operators import repeats as T


def sequence(seed, n):
    r = random.Random(seed)
    out = ""
    while len(out) < n:
        out += r.choice([lambda: "".join(r.choices("ACGT", k=r.randrange(1, 9))), lambda: "".join(r.choices("ACGTacgtN", k=r.randrange(2, 5))) * r.randrange(2, 9), lambda: r.choice("ACGT") * r.randrange(2, 7)])()
    return out[:n]


def chunks(contig, seq, size):
    return [(contig, i, seq[i : i + size]) for i in range(0, len(seq), size)]


def walked(seq, s, e, pad):
    """The region's new ends, a unit at a time."""
    seq = seq.upper()

    def fits(a, w, lo, hi):
        text = seq[a : a + 2 * w]
        return a >= lo and a + 2 * w - 1 <= hi and len(text) == 2 * w and text[:w] == text[w:] and len(set(text)) > 1 and "N" not in text

    s, e = max(s - pad - 3, 1), min(e + pad + 3, len(seq) - 2)
    first_s, first_e = s, e
    for s, units in ((first_s, (2, 3, 4)), (first_s + 3, (3, 4))):
        at = s
        for w in units:
            while fits(s, w, 0, e):
                s -= w
            if s != at:
                break
        if s != at:
            break
    s = max(s, 0)
    for e, units in ((first_e, (2, 3, 4)), (first_e - 3, (2, 3, 4))):
        at = e
        for w in units:
            while fits(e - 2 * w + 1, w, s, e):
                e += w
            if e != at:
                break
        if e != at:
            break
    return s + pad, min(e, len(seq) - 1) - pad


@pytest.mark.parametrize("size", [64, 16])
def test_extended_regions(spark, size):
    seqs = {c: sequence(c, n) for c, n in ((0, 640), (1, 333), (2, 64), (3, 17), (4, 64 * 5))}
    seqs[4] = "AC" * 160  # one run through every chunk
    reference = spark.createDataFrame([x for c, s in seqs.items() for x in chunks(c, s, size)], "contig int, start int, seq string")
    lengths = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "contig int, length int")
    r = random.Random(4)
    regions = []
    for i in range(400):
        c = r.choice(list(seqs))
        s = r.randrange(0, len(seqs[c]) - 10)
        regions.append((i, c, s, min(len(seqs[c]) - 1, s + r.randrange(8, 40))))
    df = spark.createDataFrame([*regions, (900, 77, 1, 20), (901, 0, None, 9), (902, 0, 5, None)], "id long, contig int, s int, e int")
    runs = T.tandem_runs(reference, chunk=size)
    for pad in (1, 0):
        got = {x.id: (x.s, x.e) for x in T.extend_repeats(df, runs, lengths, pad).collect()}
        assert got == {i: walked(seqs[c], s, e, pad) for i, c, s, e in regions}
    assert sum(got[i] != (s - 0, e) for i, c, s, e in regions) > 100  # most change
    for x in runs.collect():
        text = seqs[x.contig].upper()
        assert all(text[p] == text[p + x.unit] for p in range(x.s, x.e)) and len(set(text[x.s : x.s + x.unit])) > 1
        assert x.e + x.unit >= len(text) or text[x.e] != text[x.e + x.unit] or "N" in text[x.e]
        assert x.s == 0 or text[x.s - 1] != text[x.s - 1 + x.unit] or "N" in text[x.s - 1]
    assert T.extend_repeats(df.where("id < 0"), runs, lengths).collect() == []


def test_as_of(spark):
    r = random.Random(1)
    table = {(r.randrange(3), r.randrange(100_000)) for _ in range(80)}
    points = [(i, r.randrange(4), r.randrange(100_000)) for i in range(300)] + [(500 + i, c, p) for i, (c, p) in enumerate(table)]
    left, right = spark.createDataFrame(points, "id long, contig int, p int"), spark.createDataFrame([(c, p, f"{c}-{p}") for c, p in table], "contig int, k int, name string")
    for size in (1 << 16, 1 << 8):
        got = {x.id: x.last and x.last.name for x in T.as_of(left, right, ["contig"], "p", "k", size).collect()}
        assert got == {i: (lambda best: f"{c}-{best}" if best is not None else None)(max((k for t, k in table if t == c and k <= p), default=None)) for i, c, p in points}


def test_runs_are_found_without_interpreted_arrays(spark):
    """odd chunks in one batch, against a plain walk; the plan holds no array expressions over bases."""
    seqs = ["ACACACNN", "acgtacgt", "AAAAAAAA", "", None, "TGTGTG", "ACÄCACAC"]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(seqs)], "contig int, start int, seq string").coalesce(1)
    want = set()
    for c, x in enumerate(seqs):
        x = (x or "").upper()
        for u in (2, 3, 4):
            same = [i + u < len(x) and x[i] == x[i + u] and x[i] in "ACGT" for i in range(len(x))] + [False]
            a = None
            for i, ok in enumerate(same):
                if ok and a is None:
                    a = i
                elif not ok and a is not None:
                    if i - a >= u and len(set(x[a : a + u])) > 1:
                        want.add((c, u, a, i))
                    a = None
    from somaspark.operators import repeats

    seen = []
    keep = repeats.kept
    repeats.kept = lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d)
    try:
        got = {(r.contig, r.unit, r.s, r.e) for r in repeats.tandem_runs(df, chunk=8).collect()}
    finally:
        repeats.kept = keep
    assert got == want and "lambdafunction" not in seen[0].lower()
