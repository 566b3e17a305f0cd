"""Word-shingle sets as sorted 64-bit hashes, for Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """Word to 64-bit hash, kept between batches of a worker; emptied when it gets large."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes methods touch ASCII only and split at exactly x09-x0D and x20."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; with fewer words the whole sequence is one; empty without words."""
    ws = words(text)
    if not ws:
        return np.empty(0, _U)
    h = np.fromiter(map(_hashes.__getitem__, ws), _U, len(ws))
    n = max(1, len(ws) - k + 1)
    acc = np.full(n, min(len(ws), k), _U)
    for j in range(min(k, len(ws))):
        acc = (acc ^ h[j : j + n]) * _MUL
        acc ^= acc >> _U(29)
    acc *= _MIX
    acc ^= acc >> _U(32)
    return np.unique(acc)


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set as two signed 64-bit integers."""
    d = xxhash.xxh128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
