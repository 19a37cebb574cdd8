"""Polynomial hashes of byte ranges for many ranges at once.

Two hashes modulo the prime 2**31 - 1 with different bases. Modulo a power of two there are words
(Thue-Morse words and their complements) that collide under every odd base; modulo a prime a
collision of two given strings takes a base that is a root of their difference.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64((1 << 31) - 1)
_BITS = np.uint64(31)
_BASES = (0x5BD1E995, 0x2545F491)
#: Tables of powers are kept up to this length; longer ones live as long as their hash.
KEPT = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` (below 2**63) modulo the prime."""
    x = (x & _P) + (x >> _BITS)
    x = (x & _P) + (x >> _BITS)
    return np.where(x >= _P, x - _P, x)


def _table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        ahead = np.uint64(pow(base, len(out), int(_P)))
        out = np.concatenate([out, _reduced(out * ahead)])
    return out[:n]


class Powers:
    """Powers of each base and of its inverse; bounded tables are kept."""

    kept: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def of(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if cls.kept and len(cls.kept[0][0]) >= n:
            return [(up[:n], down[:n]) for up, down in cls.kept]
        size = n if n > KEPT else 1 << (n - 1).bit_length()
        made = [(_table(b, size), _table(pow(b, -1, int(_P)), size)) for b in _BASES]
        if size <= KEPT:
            cls.kept = made
        return [(up[:n], down[:n]) for up, down in made]


class RangeHash:
    """Hashes of ranges of a sequence of numbers; equal ranges hash alike wherever they stand."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.lanes = []
        for up, down in Powers.of(len(values) + 1):
            total = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(_reduced(values * up[:-1]), out=total[1:])
            self.lanes.append((total, down))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = [_reduced(_reduced(total[end] - total[start]) * down[start]) for total, down in self.lanes]
        own = (parts[0] << np.uint64(32)) | parts[1]
        return mix(own + mix((end - start).astype(np.uint64)))
