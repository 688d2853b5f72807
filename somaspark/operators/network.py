"""The convolutional scorer and the gate of its output: N1, N6, K12, S17, F6, F7, N10, F28.

Weights are a bounded parameter set that travels with the task; rows are scored in Arrow batches.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaspark.operators.stretches import kept


#: The network's four blocks: two kernel sizes, their dilations, the stride of the pool (fixed values).
BLOCKS = ((3, 5, 1, 1, 1), (3, 5, 1, 1, 2), (3, 5, 2, 1, 2), (3, 5, 4, 2, 2))
HEIGHT, WIDTH, DIM, DENSE = 5, 32, 64, 240


def layers(channels: int) -> dict[str, tuple[int, ...]]:
    """The shapes of all weights by name, in order."""
    out = {"conv1.weight": (DIM, channels, 1, 3), "conv1.bias": (DIM,)}
    norm = lambda n: {f"{n}.{x}": (DIM,) for x in ("weight", "bias", "running_mean", "running_var")}
    out |= norm("bn1")
    for i, block in enumerate(BLOCKS):
        for r in (1, 2):
            name, k = f"res_layers.{i}.conv_r{r}", block[r - 1]
            out |= {f"{name}.weight": (DIM, DIM, k, k), f"{name}.bias": (DIM,)} | norm(f"res_layers.{i}.bn_r{r}")
    flat = DIM * HEIGHT * WIDTH // int(np.prod([b[4] for b in BLOCKS]))
    for name, (o, i) in {"fc1": (DENSE, flat), "fc2": (4, DENSE), "fc3": (1, DENSE), "fc4": (4, DENSE)}.items():
        out |= {f"{name}.weight": (o, i), f"{name}.bias": (o,)}
    return out


def random_weights(channels: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Untrained weights of the full network."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in layers(channels).items():
        ones = len(shape) == 1 and name.endswith(("running_var", ".weight"))
        out[name] = (np.ones(shape) if ones else rng.normal(0, 1 / np.sqrt(np.prod(shape[1:])), shape) if len(shape) > 1 else np.zeros(shape)).astype(np.float32)
    return out


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, dilation: int = 1) -> np.ndarray:
    """(in, rows, height, width) by (out, in, kh, kw), same size: a matrix product a kernel cell."""
    c, n, h, v = x.shape
    kh, kw = w.shape[2:]
    ph, pw = (kh - 1) * dilation // 2, (kw - 1) * dilation // 2
    p = np.pad(x, ((0, 0), (0, 0), (ph, ph), (pw, pw)))
    y = np.repeat(b[:, None], n * h * v, 1)
    for i in range(kh):
        for j in range(kw):
            y += w[:, :, i, j] @ p[:, :, i * dilation : i * dilation + h, j * dilation : j * dilation + v].reshape(c, -1)
    return y.reshape(-1, n, h, v)


def pooled(x: np.ndarray, stride: int) -> np.ndarray:
    """The largest of three along the width."""
    p = np.pad(x, ((0, 0), (0, 0), (0, 0), (1, 1)), constant_values=-np.inf)
    return np.maximum(np.maximum(p[..., :-2], p[..., 1:-1]), p[..., 2:])[..., ::stride]


def forward(x: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Type and length probabilities and the place, for (rows, channels, 5, 32).

    A 1x3 convolution, four residual blocks of two dilated convolutions, each with batch norm (by its
    running values) and pooling along the width, a dense layer and three heads."""

    def layer(h, name, norm, dilation=1):
        m, v, g, b = (w[f"{norm}.{k}"][:, None, None, None] for k in ("running_mean", "running_var", "weight", "bias"))
        return (conv(h, w[f"{name}.weight"], w[f"{name}.bias"], dilation) - m) / np.sqrt(v + np.float32(1e-5)) * g + b

    h = pooled(np.maximum(layer(x.transpose(1, 0, 2, 3), "conv1", "bn1"), 0), 1)
    for i, (_, _, d1, d2, stride) in enumerate(BLOCKS):
        at = f"res_layers.{i}."
        y = np.maximum(layer(h, at + "conv_r1", at + "bn_r1", d1), 0)
        h = pooled(h + layer(y, at + "conv_r2", at + "bn_r2", d2), stride)
    dense = lambda z, n: z @ w[f"{n}.weight"].T + w[f"{n}.bias"]
    z = np.maximum(dense(h.transpose(1, 0, 2, 3).reshape(len(x), -1), "fc1"), 0)
    soft = lambda v: np.exp(v - v.max(1, keepdims=True)) / np.exp(v - v.max(1, keepdims=True)).sum(1, keepdims=True)
    return soft(dense(z, "fc2")), dense(z, "fc3")[:, 0], soft(dense(z, "fc4"))


def scored(df: DataFrame, weights: dict[str, np.ndarray], channels: int, key: str = "id", tensor: str = "tensor", step: int = 64) -> DataFrame:
    """Key, p_type, place, p_len of rows with a flat (channels x 5 x 32) tensor.

    The weights (3.5 MB, whatever the data) are broadcast; ``step`` rows pass the network at once. A
    tensor that is null or of another size has null results."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    size = channels * HEIGHT * WIDTH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), step):
                part = b.iloc[lo : lo + step]
                good = np.array([t is not None and len(t) == size for t in part[tensor]])
                out = pd.DataFrame({key: part[key], "p_type": None, "place": None, "p_len": None}).astype({"p_type": object, "place": object, "p_len": object}).reset_index(drop=True)
                if good.any():
                    x = np.stack(part[tensor].to_numpy()[good]).astype(np.float32).reshape(-1, channels, HEIGHT, WIDTH)
                    p_type, place, p_len = forward(x, shared.value)
                    for i, a, at, n in zip(np.flatnonzero(good), p_type, place, p_len, strict=True):
                        out.at[i, "p_type"], out.at[i, "place"], out.at[i, "p_len"] = a.astype(float).round(4), round(float(at), 4), n.astype(float).round(4)
                yield out

    return df.select(key, tensor).mapInPandas(run, f"{key} long, p_type array<double>, place double, p_len array<double>")


def store_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str, epoch: int) -> None:
    """One row a weight (epoch, name, shape, values); an epoch that is there is written anew."""
    rows = [(epoch, n, list(map(int, w.shape)), w.astype(float).ravel().tolist()) for n, w in weights.items()]
    df = spark.createDataFrame(rows, "epoch int, name string, shape array<int>, values array<double>")
    df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def load_weights(spark: SparkSession, path: str, channels: int, epoch: int | None = None) -> dict[str, np.ndarray]:
    """The weights of an epoch (the last one by default); a prefix ``module.`` of names is dropped.

    Missing, unknown or misshapen weights are an error. What is collected is one model."""
    df = spark.read.parquet(path)
    epoch = df.agg(F.max("epoch")).first()[0] if epoch is None else epoch
    got = {r["name"].removeprefix("module."): np.array(r["values"], np.float32).reshape(r["shape"]) for r in df.where(F.col("epoch") == epoch).collect()}
    want = layers(channels)
    if wrong := sorted(n for n in want.keys() | got.keys() if n not in got or n not in want or got[n].shape != want[n]):
        raise ValueError(f"weights do not fit the network: {wrong}")
    return got


def decoded(df: DataFrame, min_p: float = 0.05, near: float = 0.8, far: float = 3.0) -> DataFrame:
    """The likeliest type and its centre where it is accepted (id, placed, p; from id, centre, place, types DEL INS NONE SNP).

    The gate of rows without columns, where all types share one centre, so that trying a second type
    cannot help; ``decoding.alleles`` is the whole of N4. A centre within ``near`` of the candidate's own
    is the candidate's, others are rounded; one more than ``far`` away is NONE."""
    names = F.array(*map(F.lit, ("DEL", "INS", "NONE", "SNP")))
    moved = F.when(F.abs(F.col("place") - F.col("centre")) <= near, F.col("centre").cast("int")).otherwise(F.rint("place").cast("int"))
    order = F.reverse(F.array_sort(F.zip_with("types", names, lambda p, n: F.struct(p.alias("p"), n.alias("kind")))))
    df = df.withColumn("at", moved).withColumn("best", F.get(order, F.lit(0)))
    accept = (F.col("best.kind") != "NONE") & (F.col("best.p") >= min_p) & (F.abs(F.col("at") - F.col("centre")) <= far)
    return df.select("id", F.when(accept, F.col("best.kind")).otherwise("NONE").alias("kind"), F.when(accept, F.col("at")).alias("placed"), F.col("best.p").alias("p"))


def shifts(df: DataFrame) -> DataFrame:
    """all equivalent places of an indel along its reference: id, pos (0-based in seq), all as text.

    Rows: id, seq, pos, len (of a deletion). A deletion moves by one as long as the base that
    enters equals the base that leaves; the walk ends at the ends of the fetched chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for seq, p, n in zip(b["seq"], b["pos"], b["len"], strict=True):
                lo = hi = p
                while lo > 0 and seq[lo - 1] == seq[lo + n - 1]:
                    lo -= 1
                while hi + n < len(seq) and seq[hi] == seq[hi + n]:
                    hi += 1
                out.append((lo, hi))
            yield pd.DataFrame({"id": b["id"], "first": [x for x, _ in out], "last": [x for _, x in out]})

    return df.select("id", "seq", "pos", "len").mapInPandas(run, "id long, first int, last int")


def haplotypes(df: DataFrame) -> DataFrame:
    """variants of a chunk merged on its haplotype, reference bases between them; variants that
    overlap the one before are left out. Rows: id, seq, edits array<struct<pos,ref_len,alt>>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for seq, edits in zip(b["seq"], b["edits"], strict=True):
                text, at = [], 0
                for e in sorted(edits, key=lambda e: (e["pos"], e["ref_len"], e["alt"])):
                    if e["pos"] >= at:
                        text += [seq[at : e["pos"]], e["alt"]]
                        at = e["pos"] + e["ref_len"]
                out.append("".join(text) + seq[at:])
            yield pd.DataFrame({"id": b["id"], "haplotype": out})

    return df.select("id", "seq", "edits").mapInPandas(run, "id long, haplotype string")


def align(a: str, b: str, match: int = 10, mismatch: int = -8, gap_open: int = -8, gap: int = -6) -> tuple[str, str]:
    """Global alignment of two sequences with affine gaps."""
    n, m = len(a), len(b)
    low = -(10**9)
    # states 0 to 2: both, a only, b only; of equal scores the first one
    best = lambda u, v, w: (u, 0) if u >= v and u >= w else (v, 1) if v >= w else (w, 2)
    above = [(0, low, low)] + [(low, low, gap_open + gap * (j - 1)) for j in range(1, m + 1)]
    back = [[(0, 0, 0)] + [(0, 0, 2)] * m]
    for i in range(1, n + 1):
        row, steps = [(low, gap_open + gap * (i - 1), low)], [(0, 1, 0)]
        for j in range(1, m + 1):
            both, k0 = best(*above[j - 1])
            u, v, w = above[j]
            up, k1 = best(u + gap_open, v + gap, w + gap_open)
            u, v, w = row[-1]
            left, k2 = best(u + gap_open, v + gap_open, w + gap)
            row.append((both + (match if a[i - 1] == b[j - 1] else mismatch), up, left))
            steps.append((k0, k1, k2))
        above = row
        back.append(steps)
    i, j, k, x, y = n, m, best(*above[m])[1], [], []
    while i or j:
        before = back[i][j][k]
        x.append(a[i - 1] if k != 2 else "-")
        y.append(b[j - 1] if k != 1 else "-")
        i, j, k = i - (k != 2), j - (k != 1), before
    return "".join(reversed(x)), "".join(reversed(y))


def aligned_reads(df: DataFrame) -> DataFrame:
    """Each read against its group's reference, gapped, with its new CIGAR. Rows: id, n (the read's
    number within id), reference, read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, read in zip(b["reference"], b["read"], strict=True):
                x, y = align(ref, read)
                ops = "".join("I" if p == "-" else "D" if q == "-" else "M" for p, q in zip(x, y, strict=True))
                runs, at = [], 0
                for i in range(1, len(ops) + 1):
                    if i == len(ops) or ops[i] != ops[at]:
                        runs.append(f"{i - at}{ops[at]}")
                        at = i
                rows.append((x, y, "".join(runs)))
            yield pd.DataFrame({"id": b["id"], "n": b["n"], "reference": [r[0] for r in rows], "read": [r[1] for r in rows], "cigar": [r[2] for r in rows]})

    return df.select("id", "n", "reference", "read").mapInPandas(run, "id long, n int, reference string, read string, cigar string")


def jointly_aligned(df: DataFrame) -> DataFrame:
    """All reads of a group (id) in common columns: id, n, reference, read, cigar.

    Star alignment: each read meets the reference, then the insertions after one reference base share
    columns, left-justified, and rows without them are gapped there. Equal pairs of reference and read
    are aligned once; of a group only the widths of its insertions come together. Of N11 the new CIGARs;
    the excess ends are ``candidates.excess_ends``. Rows: id, n (the read's number within id), reference, read."""
    df = df.where("id is not null")
    pairs = df.groupBy("reference", "read").agg(F.min(F.struct("id", "n")).alias("k")).select("k.id", "k.n", "reference", "read")
    named = pairs.join(aligned_reads(pairs).withColumnsRenamed({"reference": "x", "read": "y"}), ["id", "n"]).drop("id", "n")
    one = kept(df.select("id", "n", "reference", "read").join(named, ["reference", "read"]).select("id", "n", "x", "y", "cigar"))
    # the i-th piece between bases is what is inserted after i bases
    widths = one.select("id", F.posexplode(F.transform(F.split("x", "[^-]"), F.length)).alias("pos", "w")).where("w > 0").groupBy("id", "pos").agg(F.max("w").alias("w"))
    widths = widths.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "w"))).alias("wide"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_spread(x, y, dict(wide) if wide is not None else {}) for x, y, wide in zip(b["x"], b["y"], b["wide"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "n": b["n"], "reference": [r[0] for r in rows], "read": [r[1] for r in rows], "cigar": b["cigar"]})

    return one.join(widths, "id", "left").mapInPandas(run, "id long, n int, reference string, read string, cigar string")


def _spread(x: str, y: str, wide: dict[int, int]) -> tuple[str, str]:
    """A gapped pair in the group's columns: wide[i] of them for what is inserted after i bases of the reference."""
    ref, read, held, pos = [], [], "", 0
    for a, b in zip(x + "$", y + "$", strict=True):  # the end closes as a base does
        if a == "-":
            held += b
            continue
        ref += ["-" * wide.get(pos, 0), a]
        read += [held.ljust(wide.get(pos, 0), "-"), b]
        held, pos = "", pos + 1
    return "".join(ref)[:-1], "".join(read)[:-1]


def packed(df: DataFrame, tensor: str = "tensor") -> DataFrame:
    """A byte tensor as base64 of its zlib form."""
    pack = F.pandas_udf(lambda s: s.map(lambda x: base64.b64encode(zlib.compress(bytes(bytearray(int(v) for v in x)))).decode()), "string")
    return df.withColumn("packed", pack(F.col(tensor)))


def unpacked(df: DataFrame, column: str = "packed") -> DataFrame:
    unpack = F.pandas_udf(lambda s: s.map(lambda x: np.frombuffer(zlib.decompress(base64.b64decode(x)), np.uint8).astype(np.int32)), "array<int>")
    return df.withColumn("unpacked", unpack(F.col(column)))
