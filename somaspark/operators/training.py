"""Training of the network: N7, N8, A19, A20, resumed from stored weights.

Synchronous gradient descent: the rows of a step are a partition folder of a table dealt once, tasks
return the sum of their rows' gradients, and blocks of these are added up on Spark. The driver holds one
model (3.5 MB) and its momentum, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaspark.operators import network as N

NONE_TYPE, NONE_SIZE = 2, 0
CLASSES = 4
EPS = 1e-5
BLOCK = 4096


def conv_back(dy: np.ndarray, x: np.ndarray, w: np.ndarray, dilation: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of ``network.conv`` by its input, weights and bias."""
    c, n, h, v = x.shape
    kh, kw = w.shape[2:]
    ph, pw = (kh - 1) * dilation // 2, (kw - 1) * dilation // 2
    p = np.pad(x, ((0, 0), (0, 0), (ph, ph), (pw, pw)))
    dp, dw, flat = np.zeros_like(p), np.zeros_like(w), dy.reshape(len(dy), -1)
    for i in range(kh):
        for j in range(kw):
            cut = np.s_[:, :, i * dilation : i * dilation + h, j * dilation : j * dilation + v]
            dw[:, :, i, j] = flat @ p[cut].reshape(c, -1).T
            dp[cut] += (w[:, :, i, j].T @ flat).reshape(x.shape)
    return dp[:, :, ph : ph + h, pw : pw + v], dw, flat.sum(1)


def pool_back(dy: np.ndarray, x: np.ndarray, stride: int) -> np.ndarray:
    """Gradient of ``network.pooled``; it goes to the first of equal values."""
    p = np.pad(x, ((0, 0), (0, 0), (0, 0), (1, 1)), constant_values=-np.inf)
    dp, last = np.zeros_like(p), (dy.shape[-1] - 1) * stride + 1
    best = np.stack([p[..., k : k + last : stride] for k in range(3)]).argmax(0)
    for k in range(3):
        dp[..., k : k + last : stride] += dy * (best == k)
    return dp[..., 1:-1]


def cross_entropy(z: np.ndarray, label: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted mean and its gradient."""
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    rows, u = np.arange(len(z)), weights[label] / weights[label].sum()
    loss = -(u * np.log(np.maximum(p[rows, label], 1e-30))).sum()
    p[rows, label] -= 1
    return float(loss), (p * u[:, None]).astype(z.dtype)


def gradients(x: np.ndarray, kind: np.ndarray, place: np.ndarray, size: np.ndarray, w: dict, by_kind: np.ndarray, by_size: np.ndarray) -> tuple[float, dict, dict]:
    """Loss, gradients by weight, and the mean and variance of each norm, over one batch of (rows, channels, 5, 32)."""
    grad: dict[str, np.ndarray] = {}
    stats: dict[str, np.ndarray] = {}
    over = (1, 2, 3)
    wide = lambda v: v[:, None, None, None]

    def layer(h: np.ndarray, name: str, norm: str, dilation: int, active: bool) -> tuple[np.ndarray, Callable]:
        z = N.conv(h, w[f"{name}.weight"], w[f"{name}.bias"], dilation)
        mean, var, count = z.mean(over), z.var(over), z[0].size
        stats[f"{norm}.running_mean"], stats[f"{norm}.running_var"] = mean, var * count / max(1, count - 1)
        sd = np.sqrt(var + z.dtype.type(EPS))
        unit = (z - wide(mean)) / wide(sd)
        y = unit * wide(w[f"{norm}.weight"]) + wide(w[f"{norm}.bias"])
        on = (y > 0) | (not active)

        def back(dy: np.ndarray) -> np.ndarray:
            dy = dy * on
            grad[f"{norm}.weight"], grad[f"{norm}.bias"] = (dy * unit).sum(over), dy.sum(over)
            dz = wide(w[f"{norm}.weight"] / sd) * (dy - wide(dy.mean(over)) - unit * wide((dy * unit).mean(over)))
            dx, grad[f"{name}.weight"], grad[f"{name}.bias"] = conv_back(dz, h, w[f"{name}.weight"], dilation)
            return dx

        return y * on, back

    first, first_back = layer(x.transpose(1, 0, 2, 3), "conv1", "bn1", 1, True)
    h, backs = N.pooled(first, 1), []
    for i, (_, _, d1, d2, stride) in enumerate(N.BLOCKS):
        at = f"res_layers.{i}."
        y, back1 = layer(h, at + "conv_r1", at + "bn_r1", d1, True)
        y, back2 = layer(y, at + "conv_r2", at + "bn_r2", d2, False)
        backs.append((back1, back2, h + y, stride))
        h = N.pooled(h + y, stride)
    flat = h.transpose(1, 0, 2, 3).reshape(len(x), -1)
    dense = lambda z, n: z @ w[f"{n}.weight"].T + w[f"{n}.bias"]
    z = np.maximum(dense(flat, "fc1"), 0)
    off = dense(z, "fc3")[:, 0] - place
    loss_kind, d_kind = cross_entropy(dense(z, "fc2"), kind, by_kind)
    loss_size, d_size = cross_entropy(dense(z, "fc4"), size, by_size)
    loss_place = float(np.where(np.abs(off) < 1, 0.5 * off * off, np.abs(off) - 0.5).mean())

    def dense_back(dy: np.ndarray, into: np.ndarray, n: str) -> np.ndarray:
        grad[f"{n}.weight"], grad[f"{n}.bias"] = dy.T @ into, dy.sum(0)
        return dy @ w[f"{n}.weight"]

    heads = {"fc2": d_kind, "fc3": (np.clip(off, -1, 1) / len(x)).astype(x.dtype)[:, None], "fc4": d_size}
    dz = sum(dense_back(dy, z, n) for n, dy in heads.items())
    dh = dense_back(dz * (z > 0), flat, "fc1").reshape(len(x), *h.transpose(1, 0, 2, 3).shape[1:]).transpose(1, 0, 2, 3)
    for back1, back2, total, stride in reversed(backs):
        d = pool_back(dh, total, stride)
        dh = d + back1(back2(d))
    first_back(pool_back(dh, first, 1))
    return loss_kind + loss_place + loss_size, grad, stats


def class_weights(df: DataFrame, column: str, none: int, boost: float) -> np.ndarray:
    """(1 - share) / classes with a prior of one a class; the class of no variant is boosted."""
    n = np.ones(CLASSES)
    for r in df.groupBy(column).count().collect():  # at most a row a class
        n[r[0]] += r[1]
    w = (1 - n / n.sum()) / CLASSES
    w[none] *= boost
    return w


def dealt(df: DataFrame, path: str, batch: int = 1000) -> int:
    """Rows (id, tensor, kind, place, size) as a table of ``part``, about ``batch`` rows each; returns the parts.

    Rows with a null are left out, as they have no loss. Write it to a folder that all executors share."""
    df = df.select("id", "tensor", "kind", "place", F.least("size", F.lit(CLASSES - 1)).alias("size")).dropna()
    parts = max(1, -(-df.count() // batch))
    df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition("part").write.partitionBy("part").parquet(path)
    return parts


def summed(df: DataFrame, w: dict, by_kind: np.ndarray, by_size: np.ndarray, channels: int, rows: int, tasks: int) -> tuple[float, dict]:
    """The loss, and the gradients and norms' statistics, as means over a step's rows.

    Chunks of ``rows`` have their own batch norm and weighted means, and count by their rows. Tasks
    return blocks of at most BLOCK numbers, so that what is added up in one place stays small."""
    shared = df.sparkSession.sparkContext.broadcast((w, by_kind, by_size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lo in range(0, len(b), rows):
                c = b.iloc[lo : lo + rows]
                x = np.stack(c["tensor"].to_numpy()).astype(np.float32).reshape(-1, channels, N.HEIGHT, N.WIDTH)
                loss, grad, stats = gradients(x, c["kind"].to_numpy(), c["place"].to_numpy(), c["size"].to_numpy(), *shared.value)
                for name, v in (grad | stats | {"loss": np.array([loss]), "rows": np.ones(1)}).items():
                    total[name] = total.get(name, 0) + np.asarray(v, float).ravel() * len(c)
        out = [(n, i // BLOCK, v[i : i + BLOCK]) for n, v in total.items() for i in range(0, len(v), BLOCK)]
        yield pd.DataFrame(out, columns=["name", "block", "values"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": p["name"][:1], "block": p["block"][:1], "values": [np.sum(np.stack(p["values"]), 0)]})

    form = "name string, block int, values array<double>"
    parts = df.repartition(tasks).mapInPandas(run, form).groupBy("name", "block").applyInPandas(add, form)
    got: dict[str, list] = {}
    for r in parts.orderBy("name", "block").collect():  # one model
        got.setdefault(r["name"], []).extend(r["values"])
    shared.unpersist()
    if not got:
        return 0.0, {}
    n = got.pop("rows")[0]
    return got.pop("loss")[0] / n, {k: (np.array(v) / n).reshape(w[k].shape).astype(np.float32) for k, v in got.items()}


def trained(
    spark: SparkSession, path: str, channels: int, epochs: int, store: str | None = None, lr: float = 0.01, momentum: float = 0.9, drop_every: int = 400,
    drop_to: float = 0.1, save_every: int = 50, boost: float = 100.0, rows: int = 64, tasks: int = 8, seed: int = 1,
) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights after ``epochs`` more epochs over a dealt table, and each epoch's mean loss.

    With ``store``, training goes on from its last epoch and adds every ``save_every``-th and the last. After
    every ``drop_every`` epochs the rate falls and the momentum starts anew. An empty table changes nothing."""
    df = spark.read.parquet(path)
    parts = [r[0] for r in df.select("part").distinct().orderBy("part").collect()]
    by_kind, by_size = class_weights(df, "kind", NONE_TYPE, boost), class_weights(df, "size", NONE_SIZE, boost)
    done = stored_epochs(spark, store) if store else 0
    w = N.load_weights(spark, store, channels) if done else N.random_weights(channels, seed)
    losses, speed = [], {}
    for epoch in range(done + 1, done + epochs + 1):
        seen = []
        for part in np.random.default_rng((seed, epoch)).permutation(parts).tolist():
            loss, step = summed(df.where(F.col("part") == part), w, by_kind, by_size, channels, rows, tasks)
            for name, v in step.items():
                if ".running_" in name:
                    w[name] = w[name] * np.float32(0.9) + v * np.float32(0.1)
                else:
                    speed[name] = momentum * speed.get(name, 0) + v
                    w[name] = (w[name] - lr * drop_to ** ((epoch - 1) // drop_every) * speed[name]).astype(np.float32)
            seen.append(loss)
        losses.append(float(np.mean(seen)) if seen else 0.0)
        if epoch % drop_every == 0:
            speed = {}
        if store and (epoch % save_every == 0 or epoch == done + epochs):
            N.store_weights(spark, w, store, epoch)
    return w, losses


def stored_epochs(spark: SparkSession, store: str) -> int:
    """The last stored epoch; 0 where nothing is stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.parquet(store).agg(F.max("epoch")).first()[0] or 0
