"""The network, the decoding of its output, scaled annotations and cut regions against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somaspark.fixtures import view
from somaspark.operators import annotations, decoding, intervals, network
from somaspark.plans import q_tensors
from somaspark.sources import text


def test_forward_plain():
    w = network.random_weights(3, seed=5)
    r = np.random.default_rng(2)
    for n in w:
        if n.endswith(("running_mean", "bias")):
            w[n] = r.normal(0, 0.1, w[n].shape).astype(np.float32)
        if n.endswith("running_var"):
            w[n] = r.uniform(0.5, 2, w[n].shape).astype(np.float32)
    x = r.normal(size=(2, 3, 5, 32)).astype(np.float32)

    def conv(x, name, d):
        k, (c, h, v) = w[name + ".weight"], x.shape
        kh, kw = k.shape[2:]
        y = np.empty((64, h, v))
        for a in range(h):
            for b in range(v):
                acc = w[name + ".bias"].astype(float)
                for i in range(kh):
                    for j in range(kw):
                        p, q = a + d * (i - kh // 2), b + d * (j - kw // 2)
                        if 0 <= p < h and 0 <= q < v:
                            acc = acc + k[:, :, i, j] @ x[:, p, q]
                y[:, a, b] = acc
        return y

    def norm(y, n):
        g = lambda k: w[f"{n}.{k}"][:, None, None]
        return (y - g("running_mean")) / np.sqrt(g("running_var") + 1e-5) * g("weight") + g("bias")

    def pool(y, s):
        return np.stack([y[:, :, max(0, b - 1) : b + 2].max(2) for b in range(0, y.shape[2], s)], 2)

    def soft(v):
        return np.exp(v) / np.exp(v).sum()

    got = network.forward(x, w)
    for row in range(2):
        h = pool(np.maximum(norm(conv(x[row], "conv1", 1), "bn1"), 0), 1)
        for i, (_, _, d1, d2, s) in enumerate(network.BLOCKS):
            at = f"res_layers.{i}."
            y = np.maximum(norm(conv(h, at + "conv_r1", d1), at + "bn_r1"), 0)
            h = pool(h + norm(conv(y, at + "conv_r2", d2), at + "bn_r2"), s)
        z = np.maximum(w["fc1.weight"] @ h.ravel() + w["fc1.bias"], 0)
        want = soft(w["fc2.weight"] @ z + w["fc2.bias"]), w["fc3.weight"] @ z + w["fc3.bias"], soft(w["fc4.weight"] @ z + w["fc4.bias"])
        for g, v in zip(got, want, strict=True):
            assert np.allclose(g[row], v, atol=1e-3)


def test_weights_and_bad_tensors(spark, tmp_path):
    w = network.random_weights(2)
    network.store_weights(spark, {"module." + n: v for n, v in w.items()}, str(tmp_path / "w"), 3)
    back = network.load_weights(spark, str(tmp_path / "w"), 2)
    assert all((back[n] == w[n]).all() for n in w)
    with pytest.raises(ValueError):
        network.load_weights(spark, str(tmp_path / "w"), 5)
    df = spark.createDataFrame([(1, [0.5] * 320), (2, None), (3, [1.0])], "id long, tensor array<double>")
    got = {r.id: r for r in network.scored(df, w, 2).collect()}
    assert abs(sum(got[1].p_type) - 1) < 1e-3 and got[2].p_type is None and got[3].place is None


def plain_allele(r):
    kinds, top = ["DEL", "INS", "NONE", "SNP"], len(r.refs) - 1
    code = [None if sum(c) <= 0 else c.index(max(c)) for c in r.refs]
    bases = [i for i, k in enumerate(code) if k]
    gaps = [i for i, k in enumerate(code) if k == 0]
    base = lambda i, cols: "ACGT"[cols[i][1:].index(max(cols[i][1:]))]
    seen = lambda i: sum(r.alts[i][1:]) > 0
    spot = min(max(0.0, r.place), top)
    mid = r.centre if abs(spot - r.centre) < 0.8 else round(spot)
    close = lambda x: min(x, key=lambda i: (abs(i - spot), i))
    types, call, as_is = list(r.types), None, False
    while sum(types) >= 0.05:
        k = types.index(max(types))
        own, off = (gaps, bases) if kinds[k] == "INS" else (bases, gaps)
        at = mid
        if kinds[k] == "NONE":
            return None
        if mid in off and not own:
            if kinds[k] != "INS" or len(r.alt) < len(r.ref) + 7:
                return None
            at, as_is = r.centre, True
        elif mid in off:
            at = r.centre if r.centre in own else close(own)
        if abs(at - r.centre) <= 3:
            call = kinds[k]
            break
        types[k] = 0
    grown = len(r.alt) - len(r.ref)
    anchor = r.centre - (grown > 0)
    if not call or abs(spot - r.centre) >= 3 or anchor not in bases:
        return None
    place = {i: r.pos + (grown < 0) + n - bases.index(anchor) for n, i in enumerate(bases)}
    want, p, n = r.lens.index(max(r.lens)), r.types, r.lens
    if call == "SNP":
        ref = alt = ""
        for i in range(at, at + want):
            later = [b for b in bases if b >= i]
            if later:
                b = later[0]
                rest = list(r.alts[b])
                rest["-ACGT".index(base(b, r.refs))] = 0
                ref, alt = ref + base(b, r.refs), alt + "ACGT"[rest[1:].index(max(rest[1:]))]
                if not seen(b):
                    break
        out = (place.get(at), ref, alt, p[3] * n[1]) if ref else None
    elif call == "INS" and as_is:
        out = (r.pos, r.ref, r.alt, p[1])
    elif call == "INS":
        before = [b for b in bases if 1 <= b < at]
        if not before or not seen(before[-1]):
            return None
        i, want = before[-1] + 1, max(grown, 3) if want == 3 else max(want, 1)
        alt = ref = base(before[-1], r.refs)
        while i in gaps and len(alt) <= want:
            alt, i = alt + base(i, r.alts), i + 1
        out = (place[before[-1]], ref, alt, p[1] * (1 - n[0]))
    else:
        ahead, body, want = [b for b in bases if b < at], [b for b in bases if b >= at], max(-grown, 3) if want == 3 else want
        if not ahead or at not in bases:
            return None
        head = base(ahead[-1], r.refs)
        rec = (r.pos, r.ref, r.alt) if len(body) < want else (place[ahead[-1]], head + "".join(base(b, r.refs) for b in body[: max(want, 1)]), head)
        out = (*rec, p[0] * (1 - n[0]))
    if not out or out[0] is None or out[1] == out[2]:
        return None
    skip = out[0] - r.around_pos
    return out if skip >= 0 and r.around[skip : skip + len(out[1])] == out[1] else None


def test_decoded_alleles(spark, monkeypatch):
    rows = []
    keep = decoding.alleles
    monkeypatch.setattr(decoding, "alleles", lambda df: rows.append(df) or keep(df))
    got = {r.id: (r.pos, r.ref, r.alt, r.prob) for r in q_tensors.decode_alleles(spark, "/root/testdata/sf0.001").collect()}
    want = {r.id: (*x[:3], round(x[3], 6)) for r in rows[0].collect() if (x := plain_allele(r))}
    assert len(want) > 100 and {len(x[1]) - len(x[2]) for x in want.values()} >= {-1, 0, 1}
    assert got.keys() == want.keys()
    assert all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 2e-6 for k in want)
    assert keep(rows[0].limit(3).withColumn("refs", F.lit(None).cast("array<array<double>>"))).count() == 0


def test_cut_regions(spark):
    rows = [(1, 0, 0, 700), (2, 0, 650, 900), (3, 1, 5, 45), (4, 2, 10, 2500), (5, 3, 0, 30), (6, 3, 60, 95)]
    df = spark.createDataFrame(rows, "id long, contig int, s int, e int")
    got = sorted(tuple(r) for r in intervals.cut_regions(df, 4, longest=1000).collect())
    bases = lambda rs: [(c, i) for c, s, e in rs for i in range(s, e + 1)]
    merged = [(0, 0, 900), (1, 5, 45), (2, 10, 2500), (3, 0, 30), (3, 60, 95)]
    assert bases(x[:3] for x in got) == bases(merged)  # all bases once, in order
    assert all(e - s + 1 >= 31 for _, s, e, _ in got) and [x[3] for x in got] == sorted(x[3] for x in got)
    sizes = [sum(e - s + 1 for _, s, e, p in got if p == k) for k in range(4)]
    assert all(x >= len(bases(merged)) // 4 for x in sizes[:3]) and sum(sizes) == len(bases(merged))
    assert intervals.cut_regions(df.where("false"), 4).count() == 0


def test_all_scaled(spark):
    assert len(annotations.FEATURES) == 93 == len(q_tensors.MADE)
    df = view(spark, "/root/testdata/sf0.001", "preds").limit(1).select("id", *[F.lit(float("nan")).alias(c) for c in annotations.FEATURES], F.lit(1).alias("extra"))
    row = annotations.all_scaled(df, ["id"]).first().asDict()
    assert "extra" not in row and row["InDel_Length"] == 0.5 and row["MSI"] == 0.0
    with pytest.raises(ValueError):
        annotations.all_scaled(df.drop("MSI"), ["id"])


def test_write_predictions(spark, tmp_path):
    rec = lambda pos, score, o=0: ("1", pos, None, "A", "C", 1.0, "PASS", "x", "GT", "0/1", o, score)
    rows = [rec(9, 0.9), rec(9, 0.9), rec(5, 0.7), rec(7, 0.2), rec(8, None)]
    df = spark.createDataFrame(rows, "contig string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, sample string, ord int, score double")
    text.write_predictions(df, str(tmp_path / "p"), 0.7)
    assert [r.pos for r in text.read_vcf(spark, str(tmp_path / "p" / "body")).orderBy("pos").collect()] == [5, 9]
