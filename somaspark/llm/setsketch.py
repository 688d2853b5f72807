"""Shingle sets and SetSketch registers of texts in numpy.

A text's set holds 64-bit hashes of its distinct shingles, of four words unless told otherwise. Register i of a sketch is
``floor(1 - log_b h)`` of the smallest exponentially distributed hash h over the set, truncated to
[0, Q + 1]: registers merge by maximum and agree with a probability near the Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

REGISTERS, BASE, RATE, Q = 160, 1.001, 20.0, (1 << 16) - 2
WORDS_A_SHINGLE = 4
_rng = np.random.Generator(np.random.PCG64(20240101))
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_HASH, XOR, MUL = _odd(256), _odd(REGISTERS), _odd(REGISTERS)
C = _odd(8)
_low = np.arange(256, dtype=np.uint8)
LOWER = np.where((_low >= 65) & (_low <= 90), _low + 32, _low).astype(np.uint8)
SPACE = (_low == 32) | ((_low >= 9) & (_low <= 13))
POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 5, np.uint64) | np.uint64(1))
HIGH_POWERS = np.cumprod(np.full(1 << 16, POWERS[-1]))  # of whole runs of 65,536 places, for longer words
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * C[0]
    x = (x ^ (x >> np.uint64(29))) * C[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word, A-Z lower-cased; in blocks cut at white space, so memory is bounded."""
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not SPACE[data[end]]:  # a word is not cut
            step = np.flatnonzero(SPACE[data[end : end + BLOCK]])
            end = end + int(step[0]) if len(step) else min(len(data), end + BLOCK)
        part = LOWER[data[at:end]]
        gap = SPACE[part]
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if len(starts):
            index = np.arange(len(part))
            place = index - np.maximum.accumulate(np.where(_marks(starts, len(part)), index, 0))
            value = np.where(gap, np.uint64(0), BYTE_HASH[part] * POWERS[place & 0xFFFF])
            far = np.flatnonzero(place > 0xFFFF)
            value[far] *= HIGH_POWERS[(place[far] >> 16) - 1]
            out.append(mix(np.add.reduceat(value, starts)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _marks(starts: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros(n, bool)
    m[starts] = True
    return m


def shingles(text: str | None, words: int = WORDS_A_SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle has make one, none make none."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    k = min(len(w), words)
    n = len(w) - k + 1
    s = np.full(n, C[(3 + k) % len(C)], np.uint64)
    for i in range(k):
        s = (s ^ w[i : i + n]) * C[2]
        s ^= s >> np.uint64(30)
    return np.unique(mix(s))


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) of the sets that begin at starts in values (none empty)."""
    least = np.empty((len(starts), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((values ^ XOR[i]) * MUL[i], starts)
    u = (least.astype(np.float64) + 1) * 2.0**-64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, Q + 1).astype("<u2")


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity from the counts of larger, smaller and equal
    registers and the known set sizes, for rows of registers; a search over its whole range."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def loglike(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    g = (math.sqrt(5) - 1) / 2
    for _ in range(24):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loglike(c) > loglike(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2
