"""Expectation-maximisation for Gaussian data on the driver, over statistics of distributed rows."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np

from ..operators.basis import AnyBasis, TensorBasis, centre_distances
from ..operators.lattice import block_diagonal, spherical_taper, taper_range
from .linalg import bisect, logdet, nelder_mead, spd_inverse, trace_product
from .stats import Moments, Statistics


@dataclass
class EMState:
    """Parameters, and the conditional mean and covariance of the basis coefficients of the last E step."""

    alpha: np.ndarray
    k: np.ndarray
    sigma2: float
    mu: np.ndarray
    s_eta: np.ndarray
    loglik: list[float] = field(default_factory=list)
    converged: bool = False
    iterations: int = 0
    seconds: float = 0.0
    tau: dict = field(default_factory=dict)
    omega: dict = field(default_factory=dict)


def start(st: Statistics, r: int, p: int) -> EMState:
    """Least-squares fixed effects, K = var(z) I, fine-scale variance a quarter of the mean error variance."""
    g = st.unweighted()
    xx, xz = g[r : r + p, r : r + p], g[r : r + p, -1]
    if np.linalg.matrix_rank(xx) < p:
        raise ValueError("fixed effects are collinear")
    return EMState(np.linalg.solve(xx, xz), st.var_z * np.eye(r), st.mean_ve / 4, np.zeros(r), np.eye(r))


def _split(m: np.ndarray, r: int, p: int):
    return m[:r, :r], m[:r, r : r + p], m[:r, -1], m[r : r + p, r : r + p], m[r : r + p, -1], m[-1, -1]


def e_step(mo: Moments, state: EMState, r: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    ss, sx, sz, *_ = _split(mo.a0, r, p)
    s_eta = spd_inverse(ss + spd_inverse(state.k))
    return s_eta @ (sz - sx @ state.alpha), s_eta


def log_likelihood(mo: Moments, state: EMState, r: int, p: int, m: int, const: float = 0.0) -> float:
    """By the Woodbury identity and the determinant lemma; ``const`` belongs to collapsed observations (in -2 logL)."""
    ss, sx, sz, xx, xz, zz = _split(mo.a0, r, p)
    a = state.alpha
    k_inv = spd_inverse(state.k)
    big = ss + k_inv
    u = sz - sx @ a
    e = zz - 2 * a @ xz + a @ xx @ a
    quad = e - u @ np.linalg.solve(big, u)
    return -0.5 * (m * math.log(2 * math.pi) + logdet(big) + logdet(state.k) + mo.logd + quad + const)


def alpha_at(mo: Moments, mu: np.ndarray, r: int, p: int) -> np.ndarray:
    _, sx, _, xx, xz, _ = _split(mo.a0, r, p)
    return np.linalg.solve(xx, xz - sx.T @ mu)


def score(mo: Moments, alpha: np.ndarray, second: np.ndarray, mu: np.ndarray, r: int, p: int) -> float:
    """Derivative of the expected log likelihood (times -1) in the fine-scale variance; ``second`` is E[eta eta']."""
    ss, sx, sz, xx, xz, zz = _split(mo.a1, r, p)
    e2 = zz - 2 * alpha @ xz + alpha @ xx @ alpha
    cross = mu @ (sz - sx @ alpha)
    return 0.5 * mo.vd - 0.5 * (trace_product(ss, second) - 2 * cross + e2)


def fine_scale(st: Statistics, state: EMState, mu: np.ndarray, s_eta: np.ndarray, r: int, p: int) -> float:
    """Root of the score: in closed form where all rows have one pair (ve, v), else bracketed by factors of 100, 1000, ...; 0 where there is none."""
    second = s_eta + np.outer(mu, mu)
    if st.groups is not None and len(st.groups) == 1:
        ve, v, n, g = st.groups[0]
        a = alpha_at(Moments(g, g, 0, 0), mu, r, p)
        ss, sx, sz, xx, xz, zz = _split(g, r, p)
        omega = trace_product(ss, second) - 2 * mu @ (sz - sx @ a) + zz - 2 * a @ xz + a @ xx @ a
        return max(0.0, (omega / n - ve) / v) if v > 0 else 0.0

    def j(s2: float) -> float:
        mo = st.at(s2)
        return score(mo, alpha_at(mo, mu, r, p), second, mu, r, p)

    now = max(state.sigma2, 1e-10)
    factor = 100.0
    while factor <= 1e9:
        low, high = now / factor, now * factor
        if j(low) * j(high) < 0:
            return bisect(j, low, high, 1e-6, 60)
        factor *= 10
    return 0.0


def regularise(second: np.ndarray, res: np.ndarray, ridge) -> np.ndarray:
    """K = E[eta eta'], with a ridge on its precision, one for all or one for each resolution."""
    if not np.any(ridge):
        return second
    lam = np.full(len(res), float(ridge)) if np.isscalar(ridge) else np.asarray(ridge, float)[np.searchsorted(np.unique(res), res)]
    return spd_inverse(spd_inverse(second) + np.diag(lam))


def _exponential(d: np.ndarray, tau: float) -> np.ndarray:
    return np.exp(-d / tau) if np.isfinite(tau) and tau > 0 else np.eye(len(d))


def block_exponential(second: np.ndarray, basis: AnyBasis, state: EMState, taper: float | None = None) -> np.ndarray:
    """K with one block for each spatial resolution: exp(-d / tau) / omega, times exp(-d_t / tau_t) for products.

    omega has a closed form given tau; tau minimises the expected negative log likelihood by a simplex search.
    """
    spatial = basis.space if isinstance(basis, TensorBasis) else basis
    n_time = basis.time.n if isinstance(basis, TensorBasis) else 1
    ds, dt = centre_distances(basis) if isinstance(basis, TensorBasis) else (centre_distances(basis), None)
    n_space, out = spatial.n, np.zeros_like(second)
    for level, d in zip(np.unique(spatial.res), ds, strict=True):
        here = np.flatnonzero(spatial.res == level)
        index = (np.arange(n_time)[:, None] * n_space + here[None, :]).ravel()
        m = second[np.ix_(index, index)]
        t = spherical_taper(d, taper_range(d, taper)) if taper else 1.0

        def corr(x: np.ndarray, d=d, t=t) -> np.ndarray:
            k = _exponential(d, float(np.exp(x[0]))) * t
            return np.kron(_exponential(dt[0], float(np.exp(x[1]))), k) if dt is not None else k

        def loss(x: np.ndarray, m=m, corr=corr) -> float:
            try:
                k = corr(x) + 1e-9 * np.eye(len(m))
                tr = trace_product(spd_inverse(k), m)
                return logdet(k) + len(m) * math.log(max(tr / len(m), 1e-300))
            except np.linalg.LinAlgError:
                return 1e12

        first = state.tau.get(int(level)) or [math.log(max(d.max() / 10, 1e-6))] + ([math.log(max(dt[0].max() / 10, 1e-6))] if dt is not None else [])
        x, _ = nelder_mead(loss, first, 0.2, 1e-4, 100)
        k = corr(x) + 1e-9 * np.eye(len(m))
        omega = len(m) / trace_product(spd_inverse(k), m)
        state.tau[int(level)], state.omega[int(level)] = list(map(float, x)), float(omega)
        out[np.ix_(index, index)] = k / omega
    return out


def fit(
    st: Statistics, basis: AnyBasis, r: int, p: int, n_em: int = 100, tol: float = 0.01, k_type: str = "block-exponential", ridge=0.0,
    known_sigma2: float | None = None, taper: float | None = None, const: float = 0.0,
) -> EMState:
    """Log likelihood, E step, M step, until the log likelihood moves by less than ``tol``."""
    if k_type not in ("block-exponential", "unstructured"):
        raise ValueError("EM needs K of type block-exponential or unstructured")
    if taper and isinstance(basis, TensorBasis):
        raise ValueError("no taper for space-time bases under EM")
    begun = time.time()
    state = start(st, r, p)
    if known_sigma2 is not None:
        state.sigma2 = known_sigma2
    mo = st.at(state.sigma2)
    for i in range(n_em):
        state.loglik.append(log_likelihood(mo, state, r, p, st.m, const))
        state.iterations = i + 1
        if i > 1 and abs(state.loglik[-1] - state.loglik[-2]) < tol:
            state.converged = True
            break
        state.mu, state.s_eta = e_step(mo, state, r, p)
        second = state.s_eta + np.outer(state.mu, state.mu)
        if k_type == "unstructured":
            state.k = regularise(second, basis.res, ridge)
            if taper:
                blocks = [spherical_taper(d, taper_range(d, taper)) for d in centre_distances(basis)]
                state.k = state.k * block_diagonal(blocks)
        else:
            state.k = block_exponential(second, basis, state, taper)
        if known_sigma2 is None:
            state.sigma2 = fine_scale(st, state, state.mu, state.s_eta, r, p)
        mo = st.at(state.sigma2)
        state.alpha = alpha_at(mo, state.mu, r, p)
    state.seconds = time.time() - begun
    return state
