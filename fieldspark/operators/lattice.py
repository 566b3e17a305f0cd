"""Lattice graphs, sparse precisions and tapers between basis centres; small matrices on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def neighbours(loc: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """First-order adjacency of lattice points: apart by one step on one axis, equal on all others.

    Steps come from the distinct coordinates, so a lattice need not be square nor whole. (Adjacency follows the points'
    own coordinates, whatever their order.)
    """
    loc = np.asarray(loc, float)
    n, dim = loc.shape
    index = np.empty((n, dim), int)
    for a in range(dim):
        v = np.sort(loc[:, a])
        distinct = v[np.concatenate([[True], np.diff(v) > tolerance * max(1.0, np.ptp(v))])]
        index[:, a] = np.abs(loc[:, a, None] - distinct[None, :]).argmin(axis=1)
    apart = np.abs(index[:, None, :] - index[None, :, :]).sum(axis=2)
    return (apart == 1).astype(float)


def precision(adjacency: np.ndarray, kappa: float, rho: float) -> np.ndarray:
    """rho (diag(row sums) + kappa I - A)."""
    return rho * (np.diag(adjacency.sum(axis=1) + kappa) - adjacency)


def block_diagonal(blocks: Sequence[np.ndarray]) -> np.ndarray:
    n = sum(len(b) for b in blocks)
    out, at = np.zeros((n, n)), 0
    for b in blocks:
        out[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return out


def taper_range(d: np.ndarray, taper: float) -> float:
    """taper times the smallest positive distance."""
    positive = d[d > 0]
    return float(taper * positive.min()) if len(positive) else float("inf")


def spherical_taper(d: np.ndarray, beta: float) -> np.ndarray:
    """(1 + d / (2 beta)) max(1 - d / beta, 0)^2."""
    if not np.isfinite(beta):
        return np.ones_like(d)
    return (1 + d / (2 * beta)) * np.maximum(1 - d / beta, 0) ** 2


def triplets(m: np.ndarray) -> list[tuple[int, int, float]]:
    """Non-zero entries (i, j, x)."""
    i, j = np.nonzero(m)
    return [(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)]


def ar1_precision(sigma2: float, rho: float, n: int) -> np.ndarray:
    """Precision of a stationary first-order autoregression with innovation variance sigma2 (1 - rho^2)."""
    if n == 1:
        return np.array([[1 / sigma2]])
    main = np.full(n, 1 + rho * rho)
    main[[0, -1]] = 1
    q = np.diag(main) - rho * (np.eye(n, k=1) + np.eye(n, k=-1))
    return q / (sigma2 * (1 - rho * rho))
