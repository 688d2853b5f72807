"""Gradients against differences of the loss; training on Spark against a plain loop."""

import numpy as np

from somaspark.operators import network as N
from somaspark.operators import training as T


def batch(n, channels, seed=3):
    r = np.random.default_rng(seed)
    kind = np.arange(n) % 4
    x = r.normal(0, 0.3, (n, channels, 5, 32))
    x[np.arange(n), 0, kind] += 1.5
    return x, kind, 10.0 + kind, (kind + 1) % 4


def test_gradients_are_differences():
    x, kind, place, size = batch(3, 2)
    r = np.random.default_rng(1)
    w = {n: v.astype(float) for n, v in N.random_weights(2).items()}
    w = {n: v + r.normal(0, 0.05, v.shape) if "running" not in n else v for n, v in w.items()}
    args = (np.array([0.2, 0.3, 1.0, 0.1]), np.array([0.5, 0.2, 0.2, 0.4]))
    _, grad, stats = T.gradients(x, kind, place, size, w, *args)
    assert grad.keys() | stats.keys() == w.keys()
    for name, g in grad.items():
        if name.endswith("bias") and "conv" in name:
            assert np.allclose(g, 0, atol=1e-8)  # the norm takes a bias away
            continue
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for d in (1e-6, -1e-6):
            moved = dict(w)
            moved[name] = w[name].copy()
            moved[name][at] += d
            ends.append(T.gradients(x, kind, place, size, moved, *args)[0])
        want = (ends[0] - ends[1]) / 2e-6
        assert np.isclose(g[at], want, rtol=1e-3, atol=1e-6), (name, g[at], want)


def test_training_on_spark(spark, tmp_path):
    x, kind, place, size = batch(24, 2)
    rows = [(i, x[i].ravel().tolist(), int(kind[i]), float(place[i]), int(size[i])) for i in range(24)] + [(99, None, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, tensor array<float>, kind int, place double, size int")
    assert T.dealt(df, f"{tmp_path}/t", batch=100) == 1
    opts = {"boost": 1.0, "rows": 64, "tasks": 1, "lr": 0.01}
    w, losses = T.trained(spark, f"{tmp_path}/t", 2, 6, store=f"{tmp_path}/w", save_every=4, **opts)
    assert losses[-1] < 0.7 * losses[0]
    # the same in a plain loop over all rows
    v, speed = N.random_weights(2, 1), {}
    by = [T.class_weights(df.dropna(), c, 0, 1.0) for c in ("kind", "size")]
    for want in losses[:3]:
        loss, grad, stats = T.gradients(x.astype(np.float32), kind, place, size, v, *by)
        assert np.isclose(loss, want, rtol=1e-3)
        for n, g in grad.items():
            speed[n] = 0.9 * speed.get(n, 0) + g
            v[n] = (v[n] - 0.01 * speed[n]).astype(np.float32)
    # stored epochs, and going on from the last one
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/w").select("epoch").distinct().collect()) == [4, 6]
    _, more = T.trained(spark, f"{tmp_path}/t", 2, 1, store=f"{tmp_path}/w", **opts)
    assert len(more) == 1 and T.stored_epochs(spark, f"{tmp_path}/w") == 7 and more[0] < losses[0]


def test_parts_add_up(spark):
    x, kind, place, size = batch(8, 2)
    df = spark.createDataFrame([(i, x[i].ravel().tolist(), int(kind[i]), float(place[i]), int(size[i])) for i in range(8)], "id long, tensor array<float>, kind int, place double, size int")
    w, ones = N.random_weights(2), np.ones(4)
    # chunks of one row: the same whatever the tasks
    one, many = (T.summed(df, w, ones, ones, 2, 1, k) for k in (1, 3))
    assert np.isclose(one[0], many[0], rtol=1e-5)
    assert all(np.allclose(one[1][n], many[1][n], atol=1e-4) for n in one[1])
    assert T.summed(df.limit(0), w, ones, ones, 2, 1, 2) == (0.0, {})
