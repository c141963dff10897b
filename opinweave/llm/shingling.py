"""Word shingles of whole texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, text_bytes

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32


class Powers:
    """Powers of the hash base and of its inverse, as many as were ever asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            steps = [np.full(n, b, np.uint64) for b in (_BASE, inverse)]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s) for s in steps)
        return self.up, self.down


def word_hashes(texts: pa.Array, powers: Powers, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and the offsets of the texts in them."""
    raw, offsets = text_bytes(texts)
    space = _SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    first &= ~space
    last = np.zeros(len(raw), bool)
    last[:-1] = space[1:]
    last[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    last &= ~space
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(raw) + 1)
    value = _VALUE[_LOWER] if lower else _VALUE
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * up[: len(raw)], out=total[1:])
    words = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct ``k``-word shingles.

    A text of fewer words is one shingle, one without words none.
    """
    run = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        run = mix64(run + words[j : j + len(run)])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            h = np.sort(run[a : b - k + 1])
            keep = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h[keep])
        else:
            h = np.full(min(1, b - a), b - a, np.uint64)
            for w in words[a:b]:
                h = mix64(h + w)
            out.append(h)
    return out


def minhash(sets: list[np.ndarray], multipliers: np.ndarray, most: int = 2048) -> np.ndarray:
    """The signatures of non-empty sets: of the least 32-bit product per multiplier the low half."""
    out = np.empty((len(sets), len(multipliers)), np.uint16)
    for i, h in enumerate(sets):
        low = (h >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), most):
            product = multipliers[:, None] * low[None, at : at + most]
            np.minimum(least, product.min(axis=1), out=least)
        out[i] = least.astype(np.uint16)
    return out
