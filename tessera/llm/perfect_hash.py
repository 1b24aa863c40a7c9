"""A minimal perfect hash over 128-bit keys, as numpy arrays.

Level by level, every key hashes to a slot of a bit array twice as large as
the number of keys left; a slot hit by exactly one key is set and that key is
placed, the others go on to the next level. A key's index is the number of
bits set before its slot, so the indexes are 0 .. n-1 without gaps.
"""

from __future__ import annotations

import numpy as np

# Odd multipliers of a 64-bit finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(a ^ mix(b + seed)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """Over distinct keys (a, b), both uint64."""
        sizes, parts = [], []
        while len(a):
            size = max(64, 2 * len(a))
            slot = _slots(a, b, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = ~alone[slot]
            a, b = a[left], b[left]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, dtype=bool))

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each key; -1, or any index, for a key that was not built in."""
        out = np.full(len(a), -1, dtype=np.int64)
        todo, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            slot = base + _slots(a[todo], b[todo], level, size)
            hit = self.bits[slot]
            out[todo[hit]] = self.rank[slot[hit]]
            todo, base = todo[~hit], base + size
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return np.array(self.sizes, dtype="<i8").tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        n = np.frombuffer(sizes, dtype="<i8").tolist()
        return cls(n, np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=sum(n)).astype(bool))
