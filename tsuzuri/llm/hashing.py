"""Rolling hashes over concatenated sequences, and winnowed anchors.

``windows(h, k)``: for each start, sum of h[i+j] * B^j mod 2^64, mixed; equal windows have equal hashes.
``anchors``: local minima of the k-gram hashes. Any stretch of ``k + w - 1`` items holds at least one
anchor, and equal stretches hold the same ones, so two documents that share such a stretch share an anchor.
"""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15
_POW = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n mod 2**64."""
    if base not in _POW or len(_POW[base]) <= n:
        x = np.full(max(n + 1, 1 << 20), base, np.uint64)
        x[0] = 1
        _POW[base] = np.multiply.accumulate(x)
    return _POW[base][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefixes(h: np.ndarray, base: int = _B) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(base, len(h))[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = _B) -> np.ndarray:
    """Hash of items a..b-1, from prefixes()."""
    inv = _powers(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[b] - prefix[a]) * inv[a] + (b - a).astype(np.uint64))


def windows(prefix: np.ndarray, k: int, base: int = _B) -> np.ndarray:
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    inv = _powers(pow(base, -1, 1 << 64), n)
    return mix((prefix[k:] - prefix[:-k]) * inv[:n] + np.uint64(k))


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w items; result has len(x) - w + 1."""
    s = 1
    m = x
    while s * 2 <= w:
        m = f(m[:-s], m[s:])
        s *= 2
    return f(m[: len(m) - (w - s)], m[w - s :]) if s < w else m


def anchors(x: np.ndarray, w: int) -> np.ndarray:
    """Which k-gram hashes are the least of some window of w of them. Of a short sequence, the least of all."""
    n = len(x)
    if n == 0:
        return np.zeros(0, bool)
    if n <= w:
        return x == x.min()
    low = sliding(x, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return sliding(np.concatenate([pad, low, pad]), w, np.maximum) == x
