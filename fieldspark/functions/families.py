"""Response families and links: Column expressions and numpy twins, densities with derivatives, samplers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTINUOUS = ("identity", "inverse", "log", "inverse-squared", "sqrt")
PROBABILITY = ("logit", "probit", "cloglog")
#: Links that each response may have.
ALLOWED = {
    "gaussian": CONTINUOUS,
    "poisson": CONTINUOUS,
    "gamma": CONTINUOUS,
    "inverse-gaussian": CONTINUOUS,
    "negative-binomial": ("log", "sqrt", *PROBABILITY),
    "binomial": PROBABILITY,
}
COUNTS = ("poisson", "binomial", "negative-binomial")
SIZED = ("binomial", "negative-binomial")
DISPERSED = ("gaussian", "gamma", "inverse-gaussian")


def check(response: str, link: str) -> None:
    if response not in ALLOWED:
        raise ValueError(f"responses are {', '.join(ALLOWED)}")
    if link not in ALLOWED[response]:
        raise ValueError(f"links of {response} are {', '.join(ALLOWED[response])}")


def risky(response: str, link: str) -> str | None:
    """A warning where a link may leave the mean's domain."""
    if response in ("poisson", "gamma", "inverse-gaussian") and link in ("identity", "inverse", "inverse-squared"):
        return f"{link} does not keep the mean of {response} data positive; log or sqrt do"
    return None


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a rational approximation (error below 7.5e-8)."""
    t = 1 / (1 + F.abs(x) * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(x * x / -2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def link(name: str, mu: Column) -> Column:
    if name == "probit":
        raise ValueError("probit has no Column form of its quantile; use the numpy twin")
    return {
        "identity": lambda: mu,
        "log": lambda: F.log(mu),
        "sqrt": lambda: F.sqrt(mu),
        "inverse": lambda: 1 / mu,
        "inverse-squared": lambda: 1 / (mu * mu),
        "logit": lambda: F.log(mu / (1 - mu)),
        "cloglog": lambda: F.log(-F.log(1 - mu)),
    }[name]()


def inverse_link(name: str, y: Column) -> Column:
    return {
        "identity": lambda: y,
        "log": lambda: F.exp(y),
        "sqrt": lambda: y * y,
        "inverse": lambda: 1 / y,
        "inverse-squared": lambda: 1 / F.sqrt(y),
        "logit": lambda: 1 / (1 + F.exp(-y)),
        "probit": lambda: normal_cdf(y),
        "cloglog": lambda: 1 - F.exp(-F.exp(y)),
    }[name]()


def mean(response: str, link_name: str, y: Column, k: Column | None = None) -> Column:
    """Mean of a response given the latent value; k is the size parameter of binomial and negative-binomial data."""
    value = inverse_link(link_name, y)
    if response == "binomial":
        return k * value
    if response == "negative-binomial":
        return k * (1 / value - 1) if link_name in PROBABILITY else k * value
    return value


def log_density(response: str, z: Column, mu: Column, phi: Column | float = 1.0, k: Column | None = None) -> Column:
    """The part of the log density that depends on the mean: (z lambda - b(lambda)) / a(phi)."""
    p = F.lit(phi) if isinstance(phi, float | int) else phi
    if response == "gaussian":
        return (z * mu - mu * mu / 2) / p
    if response == "poisson":
        return z * F.log(mu) - mu
    if response == "gamma":
        return (z / mu + F.log(mu)) / -p
    if response == "inverse-gaussian":
        return (z / (2 * mu * mu) - 1 / mu) / -p
    if response == "binomial":
        return z * F.log(mu / (k - mu)) + k * F.log((k - mu) / k)
    return z * F.log(mu / (mu + k)) + k * F.log(k / (mu + k))


def nudged(response: str, link_name: str, z: Column, k: Column | None = None) -> Column:
    """Data moved off the edge of the mean's domain, for starting values."""
    if response == "binomial":
        return F.when(z == 0, z + 0.1).when(z == k, z - 0.1).otherwise(z)
    if link_name in ("log", "sqrt", "inverse", "inverse-squared", *PROBABILITY):
        return F.when(z <= 0, F.lit(0.1 if response in COUNTS else 0.05)).otherwise(z)
    return z


def start_value(response: str, link_name: str, z: Column, k: Column | None = None) -> Column:
    """Latent starting values of observations: the link of the nudged response."""
    x = nudged(response, link_name, z, k)
    if response == "binomial":
        x = x / k
    elif response == "negative-binomial":
        x = k / (k + x) if link_name in PROBABILITY else x / k
    return link(link_name, x)


# numpy twins ------------------------------------------------------------------------------------------------------


def _phi(x: np.ndarray) -> np.ndarray:
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


_erf = np.vectorize(math.erf, otypes=[float])


def ncdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def nquantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles by Newton steps from a logistic start."""
    p = np.asarray(p, float)
    x = np.log(p / (1 - p)) / 1.702
    for _ in range(30):
        step = (ncdf(x) - p) / np.maximum(_phi(x), 1e-300)
        x = x - np.clip(step, -1, 1)
    return x


def link_np(name: str, mu: np.ndarray) -> np.ndarray:
    return {
        "identity": lambda: mu,
        "log": lambda: np.log(mu),
        "sqrt": lambda: np.sqrt(mu),
        "inverse": lambda: 1 / mu,
        "inverse-squared": lambda: mu**-2.0,
        "logit": lambda: np.log(mu / (1 - mu)),
        "probit": lambda: nquantile(mu),
        "cloglog": lambda: np.log(-np.log1p(-mu)),
    }[name]()


def inverse_link_np(name: str, y: np.ndarray) -> np.ndarray:
    return {
        "identity": lambda: y,
        "log": lambda: np.exp(np.minimum(y, 700)),
        "sqrt": lambda: y * y,
        "inverse": lambda: 1 / y,
        "inverse-squared": lambda: 1 / np.sqrt(np.maximum(y, 1e-12)),
        "logit": lambda: 1 / (1 + np.exp(-np.clip(y, -700, 700))),
        "probit": lambda: ncdf(y),
        "cloglog": lambda: -np.expm1(-np.exp(np.minimum(y, 700))),
    }[name]()


def mean_np(response: str, link_name: str, y: np.ndarray, k=1.0) -> np.ndarray:
    v = inverse_link_np(link_name, y)
    if response == "binomial":
        return k * v
    if response == "negative-binomial":
        return k * (1 / np.maximum(v, 1e-12) - 1) if link_name in PROBABILITY else k * v
    return v


def loglik_np(response: str, link_name: str, z, y, phi: float = 1.0, k=1.0) -> np.ndarray:
    """Log density of each observation as a function of the latent value, constants in z left out but not those in phi."""
    mu = mean_np(response, link_name, y, k)
    tiny = 1e-10
    if response == "gaussian":
        return -((z - mu) ** 2) / (2 * phi) - 0.5 * math.log(2 * math.pi * phi)
    if response == "poisson":
        return z * np.log(np.maximum(mu, tiny)) - mu
    if response == "gamma":
        mu = np.maximum(mu, tiny)
        return -(z / mu + np.log(mu)) / phi + (1 / phi - 1) * np.log(z) - math.log(phi) / phi - math.lgamma(1 / phi)
    if response == "inverse-gaussian":
        mu = np.maximum(mu, tiny)
        return -((z - mu) ** 2) / (2 * phi * mu * mu * z) - 0.5 * np.log(2 * math.pi * phi * z**3)
    if response == "binomial":
        p = np.clip(mu / k, tiny, 1 - tiny)
        return z * np.log(p) + (k - z) * np.log1p(-p)
    mu = np.maximum(mu, tiny)
    return z * np.log(mu / (mu + k)) + k * np.log(k / (mu + k))


def derivatives(response: str, link_name: str, z, y, phi: float = 1.0, k=1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log density, first derivative, minus second derivative) in the latent value.

    Closed forms for the common pairs; central differences elsewhere, which keep the exact Hessian's meaning.
    """
    if response == "gaussian" and link_name == "identity":
        return loglik_np(response, link_name, z, y, phi), (z - y) / phi, np.full_like(y, 1 / phi)
    if response == "poisson" and link_name == "log":
        mu = np.exp(np.minimum(y, 700))
        return z * y - mu, z - mu, mu
    if response == "poisson" and link_name == "sqrt":
        safe = np.where(np.abs(y) < 1e-6, 1e-6, y)
        return z * 2 * np.log(np.abs(safe)) - y * y, 2 * z / safe - 2 * y, 2 * z / safe**2 + 2
    if response == "binomial" and link_name == "logit":
        p = inverse_link_np("logit", y)
        return z * y - k * np.logaddexp(0, y), z - k * p, k * p * (1 - p)
    if response == "gamma" and link_name == "log":
        r = z * np.exp(-y)
        return loglik_np(response, link_name, z, y, phi), (r - 1) / phi, r / phi
    e = 1e-4 * np.maximum(1, np.abs(y))
    a, b, c = (loglik_np(response, link_name, z, v, phi, k) for v in (y - e, y, y + e))
    return b, (c - a) / (2 * e), -(c - 2 * b + a) / (e * e)


def sample(rng: np.random.Generator, response: str, mu: np.ndarray, phi: float = 1.0, k=1.0) -> np.ndarray:
    """Draws of the response given its mean."""
    if response == "gaussian":
        return rng.normal(mu, math.sqrt(phi))
    if response == "poisson":
        return rng.poisson(np.clip(mu, 0, 1e15)).astype(float)
    if response == "gamma":
        return rng.gamma(1 / phi, np.maximum(mu, 1e-12) * phi)
    if response == "inverse-gaussian":
        return rng.wald(np.maximum(mu, 1e-12), 1 / phi)
    if response == "binomial":
        return rng.binomial(np.asarray(k).astype(int), np.clip(mu / k, 0, 1)).astype(float)
    return rng.negative_binomial(k, k / (k + np.maximum(mu, 1e-12))).astype(float)
