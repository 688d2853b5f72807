"""A bidirectional gated recurrent network over bytes in numpy: inference and training.

Arrays are feature-major, (features, sequences), so that element-wise steps run over long rows.
Each direction holds X (256 rows of 3H gate inputs, one a byte), U (3H, H) and b (H), the bias of
the recurrent part of the candidate. Gates: update z, reset r, candidate n::

    z, r = sigmoid(X + U h);  n = tanh(X + r * (U h + b));  h' = n + z * (h - n)

Every position has class scores V [h forward; h backward] + c.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def start_params(classes: int, hidden: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["X" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
        p["U" + d] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
        p["b" + d] = np.zeros((hidden, 1))
    p["V"], p["c"] = rng.normal(0, 0.3, (classes, 2 * hidden)), np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    k = len(h)
    a = u @ h
    zr = _sigmoid(x[: 2 * k] + a[: 2 * k])
    m = a[2 * k :] + b
    n = np.tanh(x[2 * k :] + zr[k:] * m)
    return n + zr[:k] * (h - n), zr, m, n


def position_probs(p: Params, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Class probabilities summed over the positions of each sequence: (classes, sequences).

    data: (length, sequences) bytes; mask: 1 where there is a byte. A padded tail comes after the
    text, so the backward pass keeps its state at zero there."""
    length, count = data.shape
    hidden = p["bf"].shape[0]
    xf, xb = np.ascontiguousarray(p["Xf"].T), np.ascontiguousarray(p["Xb"].T)
    forward = np.empty((length, hidden, count), np.float32)
    h = np.zeros((hidden, count), np.float32)
    for t in range(length):
        h = forward[t] = _step(xf[:, data[t]], h, p["Uf"], p["bf"])[0]
    h = np.zeros((hidden, count), np.float32)
    total = np.zeros((len(p["c"]), count), np.float32)
    vf, vb = p["V"][:, :hidden], p["V"][:, hidden:]
    for t in range(length - 1, -1, -1):
        h = _step(xb[:, data[t]], h, p["Ub"], p["bb"])[0] * mask[t]
        s = np.exp(np.minimum(vf @ forward[t] + vb @ h + p["c"], 60))
        total += s * (mask[t] / s.sum(0))
    return total


def loss_and_grads(p: Params, data: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean cross entropy over all positions and its gradients by backpropagation through time."""
    length, count = data.shape
    k = p["bf"].shape[0]
    g = {name: np.zeros_like(v) for name, v in p.items()}
    saved, hs = {}, {}
    for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
        h, x = np.zeros((k, count), p["V"].dtype), np.ascontiguousarray(p["X" + d].T)
        for t in order:
            new, zr, m, n = _step(x[:, data[t]], h, p["U" + d], p["b" + d])
            saved[d, t] = (h, zr, m, n)
            h = hs[d, t] = new * mask[t] if d == "b" else new
    total, loss, dh = mask.sum(), 0.0, {}
    for t in range(length):
        both = np.concatenate([hs["f", t], hs["b", t]])
        s = p["V"] @ both + p["c"]
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        loss -= float((np.log(s[labels, np.arange(count)] + 1e-12) * mask[t]).sum() / total)
        s[labels, np.arange(count)] -= 1
        s *= mask[t] / total
        g["V"] += s @ both.T
        g["c"] += s.sum(1, keepdims=True)
        back = p["V"].T @ s
        dh["f", t], dh["b", t] = back[:k], back[k:]
    for d, order in (("f", range(length - 1, -1, -1)), ("b", range(length))):
        carry = np.zeros((k, count), p["V"].dtype)
        inputs = np.empty((length, 3 * k, count), p["V"].dtype)
        for t in order:
            h, zr, m, n = saved[d, t]
            z, r = zr[:k], zr[k:]
            dn = dh[d, t] + carry
            if d == "b":
                dn = dn * mask[t]
            dz, keep = dn * (h - n) * z * (1 - z), dn * z
            da = dn * (1 - z) * (1 - n * n)
            dr = da * m * r * (1 - r)
            dm = da * r
            rec = np.concatenate([dz, dr, dm])
            g["U" + d] += rec @ h.T
            g["b" + d] += dm.sum(1, keepdims=True)
            carry = keep + p["U" + d].T @ rec
            inputs[t] = np.concatenate([dz, dr, da])
        flat = inputs.transpose(0, 2, 1).reshape(-1, 3 * k)
        by = data.reshape(-1)
        order_ = np.argsort(by, kind="stable")
        found, at = np.unique(by[order_], return_index=True)
        g["X" + d][found] += np.add.reduceat(flat[order_], at, axis=0)
    return loss, g


def train(data: np.ndarray, mask: np.ndarray, labels: np.ndarray, classes: int, hidden: int = 8, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Params:
    """Adam on batches of sequences (columns of data), drawn evenly from the classes."""
    rng = np.random.default_rng(seed)
    p = start_params(classes, hidden, seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    groups = [np.flatnonzero(labels == c) for c in range(classes)]
    for i in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // classes)) for x in groups if len(x)])
        _, g = loss_and_grads(p, data[:, pick], mask[:, pick], labels[pick])
        now = rate * min(1.0, i / 20) * (1 - i / (steps + 1))
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - now * (m1[k] / (1 - 0.9**i)) / (np.sqrt(m2[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return p
