"""Vectorised word hashing of one text: numpy over code points, for use inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of _P modulo 2**64.
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a 64-bit constant and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 15)
            grow = lambda c: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, c, np.uint64))])
            self.up, self.down = grow(_P), grow(_Q)
        return self.up, self.down


def code_points(text: str, lower: bool = False) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if lower:
        cp = cp + np.uint32(32) * ((cp >= 65) & (cp <= 90)).astype(np.uint32)
    return cp


def word_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other characters than white space."""
    ink = ((cp != 32) & ((cp < 9) | (cp > 13))).astype(np.int8)
    edge = np.diff(ink, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span's characters, wherever the span stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(cp) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)])])
    return mix64((run[end] - run[start]) * down[start] ^ (end - start).astype(np.uint64) * _M2)


def shingles(text: str | None, k: int, powers: Powers) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles, A-Z lower-cased.

    Fewer words make one shingle of the whole sequence; none make none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    cp = code_points(text, lower=True)
    w = span_hashes(cp, *word_spans(cp), powers)
    n = len(w)
    if not n:
        return w
    size = min(n, k)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = mix64(h * _P + w[j : n - size + 1 + j])
    return np.unique(h)


def set_key(s: np.ndarray) -> bytes:
    """A 128-bit digest of a set of hashes."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
