"""Small dense linear algebra and optimisers in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def chol(a: np.ndarray, jitter: float = 0.0) -> np.ndarray:
    return np.linalg.cholesky(a + jitter * np.eye(len(a)) if jitter else a)


def logdet(a: np.ndarray) -> float:
    return float(2 * np.log(np.diag(chol(a))).sum())


def spd_inverse(a: np.ndarray) -> np.ndarray:
    c = np.linalg.inv(chol(a))
    return c.T @ c


def trace_product(a: np.ndarray, b: np.ndarray) -> float:
    """tr(A B) without the product."""
    return float((a * b.T).sum())


def quadratic_rows(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Diagonal of M Q M'."""
    return np.einsum("ij,jk,ik->i", m, q, m, optimize=True)


def kron_inverse_logdet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of kron(a, b) from its factors."""
    return np.kron(spd_inverse(a), spd_inverse(b)), len(b) * logdet(a) + len(a) * logdet(b)


def bisect(f: Callable[[float], float], low: float, high: float, tol: float = 1e-10, most: int = 200) -> float:
    """A root of f between ends of different sign."""
    a = f(low)
    for _ in range(most):
        mid = (low + high) / 2
        b = f(mid)
        if b == 0 or high - low <= tol * max(1.0, abs(mid)):
            return mid
        if (a < 0) == (b < 0):
            low, a = mid, b
        else:
            high = mid
    return (low + high) / 2


def nelder_mead(f: Callable[[np.ndarray], float], x0, step: float = 0.1, tol: float = 1e-4, most: int = 100) -> tuple[np.ndarray, float]:
    """Downhill simplex until the relative spread of values is below tol."""
    x0 = np.atleast_1d(np.asarray(x0, float))
    n = len(x0)
    pts = [x0] + [x0 + np.eye(n)[i] * (step * abs(x0[i]) or step) for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(most * max(1, n)):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol):
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(val))
    return pts[i], val[i]


def bfgs(f: Callable[[np.ndarray], float], x0, low=None, high=None, tol: float = 1e-5, most: int = 60, h: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton descent with central differences; box limits by projection. (x, value, converged)."""
    x = np.asarray(x0, float).copy()
    low = np.full(len(x), -np.inf) if low is None else np.asarray(low, float)
    high = np.full(len(x), np.inf) if high is None else np.asarray(high, float)

    def grad(p: np.ndarray) -> np.ndarray:
        g = np.empty(len(p))
        for i in range(len(p)):
            e = np.zeros(len(p))
            e[i] = h * max(1.0, abs(p[i]))
            g[i] = (f(p + e) - f(p - e)) / (2 * e[i])
        return g

    b, fx, g = np.eye(len(x)), f(x), grad(x)
    for _ in range(most):
        step = -b @ g
        if step @ g > 0:
            b, step = np.eye(len(x)), -g
        scale = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        for _ in range(30):
            new = np.clip(x + scale * step, low, high)
            fn = f(new)
            if np.isfinite(fn) and fn <= fx + 1e-4 * (new - x) @ g:
                break
            scale /= 2
        else:
            return x, fx, True
        gn = grad(new)
        s, y = new - x, gn - g
        done = abs(fx - fn) <= tol * (abs(fx) + tol) and np.abs(s).max() < 1e-2
        x, fx, g = new, fn, gn
        if done:
            return x, fx, True
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            v = np.eye(len(x)) - r * np.outer(s, y)
            b = v @ b @ v.T + r * np.outer(s, s)
    return x, fx, False
