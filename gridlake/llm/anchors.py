"""Polynomial prefix hashes of bytes, and anchors that any two equal strings share."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BASES = [int(b) | 1 for b in _rng.integers(1 << 62, 1 << 63, 2)]
_BYTES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in BASES]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PrefixHashes:
    """Sums of byte values times powers of an odd base, modulo 2^64; the hash of any
    substring is a difference of two sums, scaled to begin at power 0."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        base = BASES[which]
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _powers(base, n), out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo])

    def window(self, size: int) -> np.ndarray:
        """Hashes of all substrings of this size, by where they begin."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _kept.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, 1 << 16), np.uint64)
        known[1:] = np.uint64(base)
        known = _kept[base] = np.multiply.accumulate(known)
    return known[:n]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, from minima towards and from block borders."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    blocks = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n - width + 1], up[width - 1:n])


def anchors(hashes: PrefixHashes, ends: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, its gram's hash, first and last begin of the strings it stands for).

    Every string of `length` bytes inside a text has one anchor: the first place of its
    least gram hash. Equal strings have it at the same place. ends: where the text of each
    byte ends.
    """
    grams = hashes.window(gram)
    empty = np.zeros(0, np.int64)
    if len(grams) < length - gram + 1:
        return empty, grams[:0], empty, empty
    key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_minimum(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.arange(len(least)) + length <= ends[:len(least)])
    if not len(begins):
        return empty, grams[:0], empty, empty
    of = least[begins]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (begins[1:] != begins[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(of)])) - 1
    return of[first], grams[of[first]], begins[first], begins[last]
