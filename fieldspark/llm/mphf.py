"""A minimal perfect hash of distinct 64-bit keys: levels of bit arrays with ranks.

Level by level, keys that fall alone on a bit keep it and the others go on to the next level; a key's number is the
rank of its bit over all levels. A 32-bit fingerprint for each number tells absent keys.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MAGIC = b"MPH1"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class PerfectHash:
    """Numbers 0..n-1 for n distinct keys."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray):
        self.levels = levels
        self.fingerprints = fingerprints
        self.ranks = []
        base = 0
        for bits in levels:
            sums = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(base + sums - bits)
            base += int(sums[-1]) if len(sums) else 0

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        keys = keys.astype(_U)
        left, levels = keys, []
        while len(left):
            size = max(8, int(gamma * len(left)))
            slot = (_mix(left, len(levels)) % _U(size)).astype(np.int64)
            count = np.bincount(slot, minlength=size)
            levels.append((count == 1).astype(np.uint8))
            left = left[count[slot] > 1]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        found = cls(levels, np.empty(0, np.uint32))
        prints = np.zeros(len(keys), np.uint32)
        prints[found._number(keys)] = _mix(keys, 10_007).astype(np.uint32)
        found.fingerprints = prints
        return found

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            slot = (_mix(keys[open_], i) % _U(len(bits))).astype(np.int64)
            hit = bits[slot] == 1
            out[open_[hit]] = self.ranks[i][slot[hit]]
            open_ = open_[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """A number for each key; -1 where no level or the fingerprint denies it."""
        keys = keys.astype(_U)
        n = self._number(keys)
        ok = n >= 0
        ok[ok] = self.fingerprints[n[ok]] == _mix(keys[ok], 10_007).astype(np.uint32)
        return np.where(ok, n, -1)

    def dump(self) -> bytes:
        head = np.array([len(self.levels), len(self.fingerprints), *map(len, self.levels)], "<u4").tobytes()
        return _MAGIC + head + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.fingerprints.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        if raw[:4] != _MAGIC:
            raise ValueError("not an index")
        k, n = np.frombuffer(raw, "<u4", 2, 4).tolist()
        sizes = np.frombuffer(raw, "<u4", k, 12).tolist()
        at, levels = 12 + 4 * k, []
        for s in sizes:
            width = -(-s // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=s))
            at += width
        return cls(levels, np.frombuffer(raw, "<u4", n, at).astype(np.uint32))
