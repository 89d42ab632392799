"""Words and shingle sets of many texts at once, hashed to 64 bits on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK = 1 << 18
_U = np.uint64
_BYTES = np.random.default_rng(20260101).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd step and of its inverse modulo 2^64."""
    up, down = np.full(n, _U(_STEP)), np.full(n, _U(pow(_STEP, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, in order; and per text the place of its first word (one more at the end).

    A word's hash is a polynomial of its bytes, taken as the difference of two running sums.
    """
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    up, down = _powers(max(1 << (len(data) - 1).bit_length(), CHUNK * 2))
    edges = np.flatnonzero(np.diff(_SPACE[data].astype(np.int8), prepend=np.int8(1)))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[_FOLD[data]] * up[: len(data)], out=sums[1:])
    words = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raw]))


def shingle_sets(texts, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of fewer words the whole sequence is one; no words, none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) < CHUNK:
            size += len(raw[hi]) + 1
            hi += 1
        words, cut = word_hashes(raw[lo:hi])
        grams = np.full(max(len(words) - k + 1, 0), _U(k))
        for j in range(k if len(grams) else 0):
            grams = mix(grams + words[j : j + len(grams)])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            else:
                one = np.full(min(b - a, 1), _U(b - a))
                for j in range(a, b):
                    one = mix(one + words[j : j + 1])
                yield one
        lo = hi
