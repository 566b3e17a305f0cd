"""Laplace approximation for non-Gaussian data, each observation in one unit.

Latent values are x'alpha + s'eta + xi. Given eta, each row's xi is found by its own Newton steps, so that a pass over
rows returns the joint density, its gradient and the Schur complement for eta: r and r x r sums. Rows stay distributed
above ``DRIVER_CELLS`` matrix cells; below, the same function runs on the driver's copy (a bounded exception, as the
outer search evaluates it hundreds of times).
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import families
from ..operators.basis import AnyBasis, TensorBasis
from ..operators.lattice import ar1_precision, block_diagonal, neighbours, precision, spherical_taper, taper_range
from .linalg import bfgs, chol, logdet, spd_inverse

DRIVER_CELLS = 20_000_000
EPS = 1e-7


def profile_fine(response, link, z, fixed, phi, k, q, xi=None, steps: int = 30):
    """(xi, log density, g, h) at each row's best fine-scale value; q is its prior precision (inf: no fine-scale part)."""
    xi = np.zeros(len(z)) if xi is None else xi.copy()
    free = np.isfinite(q)
    if free.any():
        for _ in range(steps):
            _, g, h = families.derivatives(response, link, z, fixed + xi, phi, k)
            step = np.where(free, (g - np.where(free, q, 1) * xi) / np.maximum(h + np.where(free, q, 1), 1e-8), 0.0)
            step = np.clip(step, -2, 2)
            xi = xi + step
            if np.abs(step).max(initial=0) < 1e-9:
                break
    return (xi, *families.derivatives(response, link, z, fixed + xi, phi, k))


def row_sums(response, link, z, x, s, v, k, alpha, eta, sigma2, phi) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(joint log density with xi at its best, gradient and Schur weight sums for eta, sum of log(h + q) - log q)."""
    q = 1 / (sigma2 * v) if sigma2 > 0 else np.full(len(z), np.inf)
    xi, ll, g, h = profile_fine(response, link, z, x @ alpha + s @ eta, phi, k, q)
    if sigma2 > 0:
        w = np.maximum(h, 1e-10) * q / (np.maximum(h, 1e-10) + q)
        value = float((ll - 0.5 * q * xi * xi).sum())
        extra = float(np.log1p(np.maximum(h, 1e-10) / q).sum())
    else:
        w, value, extra = np.maximum(h, 1e-10), float(ll.sum()), 0.0
    return value, s.T @ g, (s * w[:, None]).T @ s, extra


class Rows:
    """Observed rows (z, x, s, v, k): a driver copy if small, else distributed."""

    def __init__(self, df: DataFrame, r: int, p: int):
        self.df, self.r, self.p = df, r, p
        self.m = df.count()
        self.local = None
        if self.m * (r + p) <= DRIVER_CELLS:
            t = df.select("z", "x", "s", "v", "k").toArrow().combine_chunks()
            arr = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(self.m, -1)
            num = lambda c: t.column(c).cast(pa.float64()).to_numpy()
            self.local = (num("z"), arr("x"), arr("s"), num("v"), num("k"))

    def sums(self, response, link, alpha, eta, sigma2, phi):
        if self.local is not None:
            z, x, s, v, k = self.local
            return row_sums(response, link, z, x, s, v, k, alpha, eta, sigma2, phi)
        r = self.r

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + r + r * r)
            for b in it:
                if b.num_rows:
                    arr = lambda c, b=b: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    num = lambda c, b=b: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    value, g, w, extra = row_sums(response, link, num("z"), arr("x"), arr("s"), num("v"), num("k"), alpha, eta, sigma2, phi)
                    total += np.concatenate([[value, extra], g, w.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["i", "v"])

        got = self.df.select("z", "x", "s", "v", "k").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        t = np.array([x["v"] for x in got])
        return t[0], t[2 : 2 + r], t[2 + r :].reshape(r, r), t[1]


@dataclass
class LaplaceState:
    response: str
    link: str
    alpha: np.ndarray
    sigma2: float
    phi: float
    precision: np.ndarray
    eta: np.ndarray
    cov_eta: np.ndarray
    loglik: float
    theta: np.ndarray
    converged: bool
    cov_alpha: np.ndarray | None = None
    iterations: int = 0
    seconds: float = 0.0
    names: list[str] = field(default_factory=list)


def prior_precision(theta: np.ndarray, basis: AnyBasis, kind: str, taper: float | None, random: tuple[int, ...] = ()) -> np.ndarray:
    """Precision of the coefficients from log parameters: (variance, range) of each spatial resolution, then (variance, rho) of time,
    then the variance of each group of random effects, whose levels follow the basis coefficients."""
    if random:
        inner = prior_precision(theta[: -len(random)], basis, kind, taper)
        return block_diagonal([inner, *[np.eye(n) * math.exp(-np.clip(t, -8, 8)) for n, t in zip(random, theta[-len(random) :], strict=True)]])
    spatial = basis.space if isinstance(basis, TensorBasis) else basis
    blocks = []
    for i, level in enumerate(np.unique(spatial.res)):
        a, b = np.exp(np.clip(theta[2 * i : 2 * i + 2], -8, 8))
        if kind == "neighbour":
            blocks.append(precision(neighbours(spatial.loc[spatial.res == level]), a + EPS, b))
        else:
            d = spatial.manifold.distance(spatial.loc[spatial.res == level])
            beta = taper_range(d, taper) if taper else math.inf
            scale = d[d > 0].min() if (d > 0).any() else 1.0
            if kind == "block-exponential":
                k = (a + EPS) * np.exp(-d / (b * scale + EPS)) * spherical_taper(d, beta)
                blocks.append(spd_inverse(k + 1e-9 * a * np.eye(len(d))))
            else:
                off = -a * np.exp(-d / (b * scale)) * spherical_taper(d, beta)
                np.fill_diagonal(off, 0.0)
                blocks.append(off + np.diag(1.0 - off.sum(axis=1)))
    q = block_diagonal(blocks)
    if isinstance(basis, TensorBasis):
        s2, rho = math.exp(np.clip(theta[-2], -8, 8)), math.tanh(theta[-1])
        q = np.kron(ar1_precision(s2, rho, basis.time.n), q)
    return q


def inner(rows: Rows, response, link, alpha, sigma2, phi, q, eta) -> tuple[float, np.ndarray, np.ndarray]:
    """(log of the Laplace approximation, eta, Schur complement) by damped Newton steps on eta."""
    value, g, w, extra = rows.sums(response, link, alpha, eta, sigma2, phi)
    joint = value - 0.5 * eta @ q @ eta
    for _ in range(50):
        h = q + w
        step = np.linalg.solve(h, g - q @ eta)
        scale = 1.0
        while scale > 1e-6:
            new = eta + scale * step
            value, g2, w2, extra2 = rows.sums(response, link, alpha, new, sigma2, phi)
            at = value - 0.5 * new @ q @ new
            if np.isfinite(at) and at >= joint - 1e-10 * abs(joint):
                break
            scale /= 2
        else:
            break
        gain = at - joint
        eta, joint, g, w, extra = new, at, g2, w2, extra2
        if gain < 1e-8 * (1 + abs(joint)):
            break
    h = q + w
    return joint + 0.5 * (logdet(q) - logdet(h) - extra), eta, h


def fit(
    rows: Rows, basis: AnyBasis, response: str, link: str, alpha0: np.ndarray, kind: str | None = None, taper: float | None = 3.0,
    known_sigma2: float | None = None, fine: bool = True, optimiser=bfgs, most: int = 40, random: tuple[int, ...] = (),
) -> LaplaceState:
    """Fixed effects and variance parameters by the outer search, coefficients by the inner one."""
    families.check(response, link)
    begun = time.time()
    spatial = basis.space if isinstance(basis, TensorBasis) else basis
    if kind is None:
        kind = "neighbour" if spatial.regular and not spatial.manifold.is_sphere else "precision-block-exponential"
    p, nres = rows.p, spatial.nres
    t0 = []
    for i in range(nres):
        t0 += [0.0, 0.0] if kind == "neighbour" else [math.log(0.1**i + 1e-3), 0.0]
    if isinstance(basis, TensorBasis):
        t0 += [0.0, math.atanh(0.1)]
    t0 += [math.log(0.5)] * len(random)
    dispersed = response in families.DISPERSED
    free_s2 = fine and known_sigma2 is None
    x0 = np.concatenate([alpha0, t0, [math.log(0.05)] if free_s2 else [], [0.0] if dispersed else []])
    names = [f"alpha{i}" for i in range(p)] + [f"theta{i}" for i in range(len(t0))] + ["log_sigma2fs"] * free_s2 + ["log_phi"] * dispersed
    warm = {"eta": np.zeros(rows.r)}

    def unpack(x: np.ndarray):
        at = p + len(t0)
        s2 = math.exp(x[at]) if free_s2 else (known_sigma2 if fine and known_sigma2 is not None else 0.0)
        return x[:p], x[p:at], s2, math.exp(x[at + free_s2]) if dispersed else 1.0

    def loss(x: np.ndarray) -> float:
        alpha, theta, s2, phi = unpack(x)
        try:
            q = prior_precision(theta, basis, kind, taper, random)
            value, eta, _ = inner(rows, response, link, alpha, s2, phi, q, warm["eta"])
        except (np.linalg.LinAlgError, FloatingPointError, OverflowError):
            return 1e12
        if not np.isfinite(value):
            return 1e12
        warm["eta"] = eta
        return -value

    n_log = len(x0) - p
    low = np.concatenate([np.full(p, -np.inf), np.full(n_log, -8.0)])
    high = np.concatenate([np.full(p, np.inf), np.full(n_log, 8.0)])
    x, value, ok = optimiser(loss, x0, low, high, most=most)
    alpha, theta, s2, phi = unpack(x)
    q = prior_precision(theta, basis, kind, taper, random)
    value, eta, h = inner(rows, response, link, alpha, s2, phi, q, warm["eta"])
    cov_alpha = _alpha_covariance(loss, x, p)
    return LaplaceState(response, link, alpha, s2, phi, q, eta, spd_inverse(h), value, x, ok, cov_alpha, 0, time.time() - begun, names)


def _alpha_covariance(loss, x: np.ndarray, p: int) -> np.ndarray:
    """Inverse of the numerical Hessian in the fixed effects, variance parameters held."""
    h = np.zeros((p, p))
    e = 1e-3 * np.maximum(1, np.abs(x[:p]))
    f0 = loss(x)
    for i in range(p):
        for j in range(i, p):
            a, b = np.zeros(len(x)), np.zeros(len(x))
            a[i], b[j] = e[i], e[j]
            v = (loss(x + a + b) - loss(x + a - b) - loss(x - a + b) + loss(x - a - b)) / (4 * e[i] * e[j]) if i != j else (loss(x + a) - 2 * f0 + loss(x - a)) / e[i] ** 2
            h[i, j] = h[j, i] = v
    try:
        return spd_inverse(h)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(h)


def predict(
    units: DataFrame, state: LaplaceState, nsim: int = 400, percentiles=(5, 95), seed: int = 1, universal: bool = False, response_draws: bool = True, keep_samples: bool = False,
) -> DataFrame:
    """``units`` (bau_id, x, s, v, z, k; z null where unobserved) with means, root mean squared errors and percentiles of
    the latent value Y, the mean mu, the probability prob (binomial and negative-binomial) and the response Z.

    Coefficients are drawn once and sent to tasks (nsim x r numbers); each row's fine-scale draws come from a generator
    seeded by its own id, so results do not depend on the layout.
    """
    rng = np.random.default_rng(seed)
    eta = state.eta + rng.standard_normal((nsim, len(state.eta))) @ chol(state.cov_eta + 1e-12 * np.eye(len(state.eta))).T
    alpha = np.tile(state.alpha, (nsim, 1))
    if universal and state.cov_alpha is not None:
        alpha = alpha + rng.standard_normal(alpha.shape) @ chol(state.cov_alpha + 1e-12 * np.eye(alpha.shape[1])).T
    quantities = ["Y", "mu"] + (["prob"] if state.response in families.SIZED and state.link in families.PROBABILITY else []) + (["Z"] if response_draws else [])
    names = [c for q in quantities for c in (f"p_{q}", f"RMSPE_{q}", *[f"{q}_percentile_{t:g}" for t in percentiles])]
    kept = [f.name for f in units.schema.fields]
    schema = StructType(list(units.schema.fields))
    for n in names:
        schema = schema.add(n, "double")
    if keep_samples:
        schema = schema.add("samples_mu", "array<double>")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.num_rows
            out = {c: np.empty(n) for c in names}
            samples = []
            if n:
                arr = lambda c, b=b, n=n: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                num = lambda c, b=b: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x, s, v, z, k = arr("x"), arr("s"), num("v"), num("z"), num("k")
                seen = np.isfinite(z)
                centre = x @ state.alpha + s @ state.eta
                xi, sd, slope = np.zeros(n), np.zeros(n), np.zeros(n)
                if state.sigma2 > 0:
                    q = 1 / (state.sigma2 * v)
                    sd = 1 / np.sqrt(q)
                    if seen.any():
                        xs, _, _, h = profile_fine(state.response, state.link, z[seen], centre[seen], state.phi, k[seen], q[seen])
                        h = np.maximum(h, 1e-10)
                        xi[seen], sd[seen], slope[seen] = xs, 1 / np.sqrt(h + q[seen]), h / (h + q[seen])
                for i, unit in enumerate(b.column("bau_id").to_pylist()):
                    g = np.random.default_rng([seed, int(unit) & 0x7FFFFFFFFFFFFFFF])
                    line = alpha @ x[i] + eta @ s[i]
                    y = line + xi[i] - slope[i] * (line - centre[i]) + sd[i] * g.standard_normal(nsim)
                    mu = families.mean_np(state.response, state.link, y, k[i])
                    draws = {"Y": y, "mu": mu}
                    if "prob" in quantities:
                        draws["prob"] = families.inverse_link_np(state.link, y)
                    if response_draws:
                        draws["Z"] = families.sample(g, state.response, mu, state.phi, k[i])
                    for t in quantities:
                        out[f"p_{t}"][i], out[f"RMSPE_{t}"][i] = draws[t].mean(), draws[t].std(ddof=1)
                        for c, value in zip(percentiles, np.percentile(draws[t], percentiles), strict=True):
                            out[f"{t}_percentile_{c:g}"][i] = value
                    if keep_samples:
                        samples.append(mu)
            cols = [pa.array(out[c]) for c in names] + ([pa.array(samples, pa.list_(pa.float64()))] if keep_samples else [])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *cols], names=[*kept, *names, *(["samples_mu"] if keep_samples else [])])

    return units.mapInArrow(run, schema)

