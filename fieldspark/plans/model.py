"""One-call models: data, units and basis in, a fitted model with predictions out.

The model object holds small numpy arrays and handles to two written tables: units (centres, fixed effects, basis
values) and observations on them. All data-sized work is in DataFrames.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import families
from ..functions.geometry import Manifold, plane
from ..operators import basis as B
from ..operators import bau as U
from ..operators import formula as Fm
from ..operators import support as S
from ..operators import variogram as V
from ..session import stash
from . import em, laplace, stats
from .linalg import chol
from .predict import Predictor, at_points, observation_weights

RESERVED = ("std", "fs", "wts", "k_Z", "k_BAU", "t", "n", "bau_id", "res", "s", "x_fixed")


def check_arguments(response: str, link: str, method: str, k_type: str, random: bool) -> None:
    """The combinations that a model may have."""
    families.check(response, link)
    if method not in ("EM", "Laplace"):
        raise ValueError("methods are EM and Laplace")
    plain = response == "gaussian" and link == "identity"
    if method == "EM" and not plain:
        raise ValueError("EM is for gaussian data with the identity link")
    if method == "EM" and k_type not in ("block-exponential", "unstructured"):
        raise ValueError("EM needs k_type block-exponential or unstructured")
    if method == "Laplace" and k_type not in ("precision", "block-exponential"):
        raise ValueError("Laplace needs k_type precision or block-exponential")
    if random and method == "EM":
        raise ValueError("random effects need the Laplace method")
    note = families.risky(response, link)
    if note:
        warnings.warn(note, stacklevel=3)


@dataclass
class Model:
    """A fitted model. ``units``: bau_id, loc1.., x, s, v, k; ``obs``: obs_id, bau_id, z, ve, v, x, s, k."""

    formula: Fm.Formula
    names: tuple[str, ...]
    manifold: Manifold
    grid: U.Grid
    coords: tuple[str, ...]
    basis: B.AnyBasis
    units: DataFrame
    obs: DataFrame
    method: str
    response: str
    link: str
    k_type: str
    m: int
    em: em.EMState | None = None
    laplace: laplace.LaplaceState | None = None
    statistics: stats.Statistics | None = None
    const: float = 0.0
    info: dict = field(default_factory=dict)

    # Prediction ---------------------------------------------------------------------------------------------------

    def predict(self, regions: DataFrame | None = None, points: DataFrame | None = None, obs_fs: bool = False, percentiles: Sequence[float] = (5, 95), nsim: int = 400, seed: int = 1, normalise: bool = True, times: Sequence[int] | None = None, universal: bool = False) -> DataFrame:
        """Units with predictions; or regions (areas with rings and ``region_id``), or points, by way of their units."""
        if self.method == "EM":
            p = Predictor(self.em, self.statistics, self.basis.n, len(self.names), obs_fs)
            out = p.units(self.units, observation_weights(self.obs))
            if regions is not None:
                c = S.incidence_areas(regions, self.grid, self.units.select("bau_id", "wts"), "region_id")
                return p.regions(out, S.normalise(c, "region_id") if normalise else c)
            out = self._named(out.drop("shrink", "own"))
        else:
            if regions is not None:
                raise ValueError("regions of Laplace models: predict units with samples and average those")
            seen = self.obs.groupBy("bau_id").agg(F.first("z").alias("z"), F.first("k").alias("k_seen"))
            u = self.units.join(seen, "bau_id", "left").withColumn("k", F.coalesce("k_seen", "k")).drop("k_seen")
            out = self._named(laplace.predict(u, self.laplace, nsim, percentiles, seed, universal))
        if times is not None:
            out = out.filter(F.col("t").isin(list(times)))
        if points is not None:
            return at_points(out.drop(*self.coords), points, self.key())
        return out

    def _named(self, out: DataFrame) -> DataFrame:
        """Coordinates under their own names; design and basis values go."""
        out = out.drop("s", "x")
        for i, c in enumerate(self.coords):
            out = out.withColumnRenamed(f"loc{i + 1}", c)
        return out

    def covariance(self, obs_fs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers, covariance matrix) of predictions over all units, 4000 at most."""
        if self.method != "EM":
            raise ValueError("covariances need the EM method")
        p = Predictor(self.em, self.statistics, self.basis.n, len(self.names), obs_fs)
        return p.covariance(p.units(self.units, observation_weights(self.obs)))

    def key(self) -> Column:
        return self.grid.key([F.col(c) for c in self.coords])

    # Accessors ----------------------------------------------------------------------------------------------------

    def coef(self) -> dict[str, float]:
        a = self.em.alpha if self.method == "EM" else self.laplace.alpha
        return dict(zip(self.names, map(float, a), strict=True))

    def coef_uncertainty(self, percentiles: Sequence[float] = (5, 95), nsim: int = 400, seed: int = 1) -> dict[str, list[float]]:
        """Percentiles of fixed effects by draws from their approximate posterior."""
        if self.method != "Laplace" or self.laplace.cov_alpha is None:
            raise ValueError("uncertainty of coefficients needs a Laplace model with free fixed effects")
        rng = np.random.default_rng(seed)
        a = self.laplace.alpha + rng.standard_normal((nsim, len(self.names))) @ chol(self.laplace.cov_alpha + 1e-12 * np.eye(len(self.names))).T
        q = np.percentile(a, list(percentiles), axis=0)
        return {n: [float(v) for v in q[:, i]] for i, n in enumerate(self.names)}

    def random_effects(self) -> dict[str, dict[str, float]]:
        """Conditional modes of random effects by group and level."""
        out, at = {}, self.basis.n
        for (_, group), levels in zip(self.formula.random, self.info.get("random_levels", []), strict=True):
            out[group] = {v: float(self.laplace.eta[at + i]) for i, v in enumerate(levels)}
            at += len(levels)
        return out

    def nobs(self) -> int:
        return self.m

    def loglik(self) -> float:
        if self.method == "Laplace":
            return self.laplace.loglik
        mo = self.statistics.at(self.em.sigma2)
        return em.log_likelihood(mo, self.em, self.basis.n, len(self.names), self.statistics.m, self.const)

    def n_parameters(self) -> int:
        """Fixed effects, fine-scale variance, dispersion, and those of the coefficients' covariance."""
        r = self.basis.n
        st = isinstance(self.basis, B.TensorBasis)
        nres = self.basis.space.nres if st else self.basis.nres
        k = r * (r + 1) // 2 if self.k_type == "unstructured" else 2 * nres + 2 * st
        return len(self.names) + 1 + k + len(self.formula.random) + (self.method == "Laplace" and self.response in families.DISPERSED)

    def aic(self, k: float = 2.0) -> float:
        return -2 * self.loglik() + k * self.n_parameters()

    def bic(self) -> float:
        return self.aic(float(np.log(self.nobs())))

    def fitted(self) -> DataFrame:
        """(obs_id, z, fitted): the mean at each observation's unit."""
        p = self.predict().select("bau_id", F.col("mu" if self.method == "EM" else "p_mu").alias("fitted"))
        return self.obs.select("obs_id", "bau_id", "z").join(p, "bau_id")

    def residuals(self, kind: str = "pearson") -> DataFrame:
        """Fitted minus observed; pearson residuals are divided by the standard deviation of predicted data."""
        if kind not in ("pearson", "response"):
            raise ValueError("kinds are pearson and response")
        sd = F.sqrt(F.col("var") + F.col("ve")) if self.method == "EM" else F.col("RMSPE_Z")
        p = self.predict()
        p = p.select("bau_id", F.col("mu" if self.method == "EM" else "p_mu").alias("fitted"), *(["var"] if self.method == "EM" else ["RMSPE_Z"]))
        r = self.obs.select("obs_id", "bau_id", "z", "ve").join(p, "bau_id").withColumn("residual", F.col("fitted") - F.col("z"))
        return (r.withColumn("residual", F.col("residual") / sd) if kind == "pearson" else r).select("obs_id", "residual")

    def simulate(self, nsim: int = 400, seed: int = 1) -> DataFrame:
        """(obs_id, samples): posterior-predictive data at observed units."""
        seen = self.obs.select("bau_id", "obs_id", "ve")
        if self.method == "Laplace":
            u = self.units.join(self.obs.select("bau_id", "obs_id", "z", F.col("k").alias("k_seen")), "bau_id").withColumn("k", F.coalesce("k_seen", "k")).drop("k_seen")
            out = laplace.predict(u, self.laplace, nsim, seed=seed, keep_samples=True, response_draws=False)
            means = out.select("obs_id", F.col("samples_mu").alias("m"), "k")
            response, phi = self.response, self.laplace.phi
        else:
            p = self.predict().select("bau_id", "mu", "sd")
            means = p.join(seen, "bau_id").select("obs_id", F.array("mu", F.sqrt(F.col("sd") * F.col("sd") + F.col("ve"))).alias("m"), F.lit(1.0).alias("k"))
            response, phi = None, 1.0

        def run(it):
            import pyarrow as pa

            for b in it:
                out = []
                for i, m, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    g = np.random.default_rng([seed + 1, int(i) & 0x7FFFFFFFFFFFFFFF])
                    out.append(g.normal(m[0], m[1], nsim) if response is None else families.sample(g, response, np.array(m), phi, k))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["obs_id", "samples"])

        return means.mapInArrow(run, "obs_id long, samples array<double>")

    def info_fit(self) -> dict:
        s = self.em or self.laplace
        out = {"method": self.method, "converged": s.converged, "iterations": s.iterations, "time": s.seconds, "sigma2fs": s.sigma2, "sigma2fs_is_0": s.sigma2 == 0}
        return out | ({"loglik": self.em.loglik} if self.em else {"loglik": [self.laplace.loglik]}) | self.info

    def summary(self) -> dict:
        return {"formula": str(self.formula), "coef": self.coef(), "nobs": self.nobs(), "n_basis": self.basis.n, "response": self.response, "link": self.link, "loglik": self.loglik(), "aic": self.aic(), "bic": self.bic()}

    def __repr__(self) -> str:
        return f"Model({self.formula}, {self.response}/{self.link}, {self.basis.n} basis functions, {self.m} observations, {self.method})"


def default_budget(n: int, k_type: str, spacetime: bool) -> int:
    """Most basis functions: 2000, or the root of n if unstructured; a tenth in space-time."""
    most = min(int(np.sqrt(n)), 2000) if k_type == "unstructured" else 2000
    return max(1, most // 10 if spacetime else most)


def random_columns(f: Fm.Formula, units: DataFrame, most: int = 1000) -> tuple[list[Column], list[list[str]]]:
    """An indicator array for each group of random effects, and its levels over all units: levels without data keep their prior."""
    columns, levels = [], []
    for inner, group in f.random:
        found = sorted(r[0] for r in units.select(F.col(group).cast("string")).distinct().limit(most + 1).collect() if r[0] is not None)
        if len(found) > most:
            raise ValueError(f"{group} has more than {most} levels")
        x = F.lit(1.0) if inner == "1" else F.expr(inner).cast("double")
        columns.append(F.array(*[F.when(F.col(group).cast("string") == v, x).otherwise(0.0) for v in found]))
        levels.append(found)
    return columns, levels


def fit_points(
    formula: str, data: DataFrame, coords: Sequence[str], manifold: Manifold | None = None, cellsize=None, xlims=None, ylims=None, covariates: DataFrame | None = None,
    basis: B.AnyBasis | None = None, nres: int | None = None, regular: int = 1, kind: str = "bisquare", average: bool = True, sums: Sequence[str] = (), std: float | str | None = None,
    k_type: str | None = None, method: str | None = None, response: str = "gaussian", link: str = "identity", n_em: int = 100, tol: float = 0.01, ridge=0.0,
    known_sigma2: float | None = None, taper: float | None = None, normalise_basis: bool = True, id_col: str = "obs_id", k_col: str | None = None, max_outer: int = 40, optimiser=None,
) -> Model:
    """A model of point data on a line, a plane or a sphere.

    Covariates come from units (``covariates``: bau_id and columns), never from data. ``std`` is a column or a number;
    without it the variogram near the origin gives the measurement error (gaussian data).
    """
    manifold = manifold or plane()
    coords = tuple(coords)
    f = Fm.parse(formula)
    method = method or ("EM" if response == "gaussian" and link == "identity" else "Laplace")
    k_type = k_type or ("block-exponential" if method == "EM" else "precision")
    check_arguments(response, link, method, k_type, bool(f.random))
    if covariates is not None:
        both = set(covariates.columns) & set(data.columns) - {"bau_id"}
        if both:
            raise ValueError(f"data and units share columns: {', '.join(sorted(both))}")

    d = data.select(F.col(id_col).cast("long").alias("obs_id"), *[F.col(c).cast("double").alias(c) for c in coords], F.expr(f.response).cast("double").alias("z"), *([F.col(std).cast("double").alias("std")] if isinstance(std, str) else []), *([F.col(k_col).cast("double").alias("k")] if k_col else []))
    d = Fm.checked(d, ["z", *coords])
    units, grid = U.auto_baus(d, manifold, coords, cellsize, xlims, ylims)
    if covariates is not None:
        units = units.join(covariates, "bau_id")
    info: dict = {}
    if std is None:
        if response == "gaussian":
            two = coords if len(coords) > 1 else (coords[0], coords[0])
            sd, how = V.measurement_error(d, two, "z")
            info["measurement_error"] = {"std": sd, "from": how}
        else:
            sd = 1.0
        d = d.withColumn("std", F.lit(max(sd, 1e-6)))
    elif not isinstance(std, str):
        d = d.withColumn("std", F.lit(float(std)))

    if basis is None:
        ranges = U.extent(d, coords)
        if nres is None:
            budget = default_budget(d.count(), k_type, False)
            basis = B.auto_basis(manifold, ranges, regular=regular, kind=kind, max_basis=budget) if method == "EM" else B.auto_basis(manifold, ranges, 3, regular, kind)
        else:
            basis = B.auto_basis(manifold, ranges, nres, regular, kind)
    design = Fm.design(f, units)
    n_cells = grid.cells
    units = B.unit_basis(units, n_cells, basis, coords, grid.size, normalise_basis)
    effects, levels = random_columns(f, units)
    units = units.select("bau_id", *[F.col(c).alias(f"loc{i + 1}") for i, c in enumerate(coords)], F.col("fs").alias("v"), "wts", F.concat("s", *effects).alias("s"), design.array().alias("x"), F.lit(1.0).alias("k"))
    units = stash(units, "units")

    counts = response in families.COUNTS
    b = S.bin_points(d, grid.key([F.col(c) for c in coords]), average=average, sums=[*sums, *(["z", "k"] if response in families.SIZED else [])], drop=list(coords))
    if average:
        b = b.withColumn("obs_id", F.col("bau_id"))
    if "k" not in b.columns:
        b = b.withColumn("k", F.lit(1.0))
    z = F.round("z") if counts else F.col("z")
    obs = b.select("obs_id", "bau_id", z.alias("z"), (F.col("std") * F.col("std")).alias("ve"), "k").join(units.select("bau_id", "v", "x", "s"), "bau_id")
    obs = stash(obs, "obs")
    m, r, p = obs.count(), basis.n + sum(map(len, levels)), len(design.names)
    if m == 0:
        raise ValueError("no data fall in any unit")
    info["random_levels"] = levels
    model = Model(f, design.names, manifold, grid, coords, basis, units, obs, method, response, link, k_type, m, info=info)
    if method == "EM":
        rows, const = obs, 0.0
        if not average:
            c = stash(stats.collapse(obs), "collapsed")
            const = float(c.agg(F.sum("const")).first()[0])
            rows = stash(c.drop("const", "n").join(units.select("bau_id", "v", "x", "s"), "bau_id"), "rows")
        model.statistics = stats.Statistics(rows, r, p)
        model.const = const
        model.em = em.fit(model.statistics, basis, r, p, n_em, tol, k_type, ridge, known_sigma2, taper, const)
        if not model.em.converged and n_em > 10:
            warnings.warn("EM stopped before it converged", stacklevel=2)
    else:
        if not average and obs.groupBy("bau_id").count().filter("count > 1").limit(1).count():
            raise ValueError("the Laplace method needs one observation for each unit; average or sum in units")
        rows = laplace.Rows(obs, r, p)
        start = obs.select("x", families.start_value(response, link, F.col("z"), F.col("k")).alias("z")) if link != "probit" else obs.select("x", F.lit(0.0).alias("z"))
        g = stats.cross_products(start.select("x", F.array(F.lit(0.0)).alias("s"), "z", F.lit(1.0).alias("ve"), F.lit(1.0).alias("v")), [lambda ve, v: np.ones_like(ve)], p + 2)[0]
        alpha0 = np.linalg.solve(g[1 : p + 1, 1 : p + 1] + 1e-9 * np.eye(p), g[1 : p + 1, -1])
        prior = None if k_type == "precision" else "block-exponential"
        model.laplace = laplace.fit(rows, basis, response, link, alpha0, prior, taper or 3.0, known_sigma2, True, *([optimiser] if optimiser else []), most=max_outer, random=tuple(map(len, levels)))
    return model


def fit_space_time(
    formula: str, data: DataFrame, coords: Sequence[str], ts: str, manifold: Manifold | None = None, cellsize=None, unit: str | None = None, every: int = 1,
    basis: B.TensorBasis | None = None, nres: int = 1, regular: int = 1, n_time: int = 10, std: float | str = 1.0, n_em: int = 20, tol: float = 0.01, k_type: str = "block-exponential",
    known_sigma2: float | None = None, id_col: str = "obs_id",
) -> Model:
    """A Gaussian model on units x time slots, with products of spatial and temporal functions.

    Units that no observation meets are made when predictions need them: here all spatial units at all slots are kept.
    """
    from ..functions.geometry import plane as make_plane

    manifold = manifold or make_plane()
    coords = tuple(coords)
    f = Fm.parse(formula)
    d = data.select(
        F.col(id_col).cast("long").alias("obs_id"), *[F.col(c).cast("double").alias(c) for c in coords], F.col(ts).cast("timestamp").alias("ts"),
        F.expr(f.response).cast("double").alias("z"), (F.col(std) if isinstance(std, str) else F.lit(float(std))).cast("double").alias("std"),
    )
    d = Fm.checked(d, ["z", *coords])
    first, last, a, b = d.agg(F.min("ts").cast("string"), F.max("ts").cast("string"), F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    unit = unit or U.default_time_unit(a, b)
    spark = data.sparkSession
    slots = stash(U.time_slots(spark, first, last, unit, every), "slots")
    n_slots = slots.count()
    space, grid = U.auto_baus(d, manifold, coords, cellsize)
    if basis is None:
        spatial = B.auto_basis(manifold, U.extent(d, coords), nres, regular)
        basis = B.tensor(spatial, B.time_basis(n_slots, n_time, "bisquare"))
    st = U.space_time(space, slots.select("t"), grid.cells).withColumn("time", F.col("t").cast("double"))
    design = Fm.design(f, st)
    st = B.evaluate(st, basis, (*coords, "time"), normalise=True)
    units = stash(st.select("bau_id", "t", *[F.col(c).alias(f"loc{i + 1}") for i, c in enumerate(coords)], F.col("fs").alias("v"), "wts", "s", design.array().alias("x"), F.lit(1.0).alias("k")), "units")
    binned = S.bin_space_time(d, grid.key([F.col(c) for c in coords]), "ts", slots, grid.cells, obs_id="obs_id")
    obs = binned.select(F.col("bau_id").alias("obs_id"), "bau_id", "z", (F.col("std") * F.col("std")).alias("ve"), F.lit(1.0).alias("k")).join(units.select("bau_id", "v", "x", "s"), "bau_id")
    obs = stash(obs, "obs")
    m = obs.count()
    if m == 0:
        raise ValueError("no data fall in any slot and unit")
    model = Model(f, design.names, manifold, grid, coords, basis, units, obs, "EM", "gaussian", "identity", k_type, m, info={"slots": n_slots, "unit": unit})
    model.statistics = stats.Statistics(obs, basis.n, len(design.names))
    model.em = em.fit(model.statistics, basis, basis.n, len(design.names), n_em, tol, k_type, known_sigma2=known_sigma2)
    return model


def areal_rows(areas: DataFrame, grid: U.Grid, units: DataFrame, id_col: str = "obs_id", normalise: bool = True) -> DataFrame:
    """Observations (obs_id, z, std, ring) of footprints as rows of weighted means (sums without ``normalise``) of their units.

    ``v`` is the footprint's fine-scale weight, sum of squared weights times the units'. Footprints that overlap have
    correlated fine-scale parts, which this diagonal form leaves out; ``overlap`` counts units shared with others.
    """
    c = S.incidence_areas(areas, grid, units.select("bau_id", "wts"), id_col)
    c = S.normalise(c, id_col) if normalise else c
    shared = c.groupBy("bau_id").agg(F.count(F.lit(1)).alias("_n"))
    j = c.join(units.select("bau_id", "v", "x", "s").withColumnRenamed("x", "x_fixed"), "bau_id").join(shared, "bau_id")
    j = j.select(
        F.col(id_col).cast("long").alias(id_col), F.concat("x_fixed", "s").alias("all"), "x", (F.col("x") * F.col("x") * F.col("v")).alias("v"), F.when(F.col("_n") > 1, 1.0).otherwise(0.0).alias("overlap"), F.size("x_fixed").alias("p")
    )
    p = j.select("p").first()[0]
    weighted = j.select(id_col, F.transform("all", lambda t: t * F.col("x")).alias("all"), "v", "overlap")
    g = stats.vector_sums(weighted, id_col, "all", ["v", "overlap"])
    g = g.select(id_col, F.slice("all", 1, p).alias("x"), F.expr(f"slice(all, {p + 1}, size(all))").alias("s"), "v", "overlap")
    return areas.select(id_col, "z", (F.col("std") * F.col("std")).alias("ve")).join(g, id_col)


def fit_areas(formula: str, areas: DataFrame, units: DataFrame, grid: U.Grid, basis: B.AnyBasis, coords: Sequence[str], n_em: int = 50, tol: float = 0.01, k_type: str = "block-exponential", known_sigma2: float | None = None, normalise: bool = True, points: DataFrame | None = None) -> Model:
    """A Gaussian model of footprints (and, as a second dataset, of binned points: obs_id, bau_id, z, std).

    Footprints must not share units, as their errors would be correlated beyond the diagonal form; those that do are an error
    unless the fine-scale variance is held at 0.
    """
    f = Fm.parse(formula)
    design = Fm.design(f, units)
    u = B.evaluate(units, basis, coords, normalise=True)
    u = stash(u.select("bau_id", *[F.col(c).alias(f"loc{i + 1}") for i, c in enumerate(coords)], F.col("fs").alias("v"), "wts", "s", design.array().alias("x"), F.lit(1.0).alias("k")), "units")
    rows = areal_rows(areas, grid, u, "obs_id", normalise).withColumn("bau_id", F.lit(None).cast("long"))
    if points is not None:
        q = points.join(u.select("bau_id", "v", "x", "s"), "bau_id").select("obs_id", "z", (F.col("std") * F.col("std")).alias("ve"), "x", "s", "v", F.lit(0.0).alias("overlap"), "bau_id")
        rows = S.bind_datasets(rows, q).drop("dataset_id")
    rows = stash(rows.withColumn("k", F.lit(1.0)), "obs")
    if known_sigma2 != 0 and rows.filter("overlap > 0").limit(1).count():
        raise ValueError("footprints share units: hold the fine-scale variance at 0 (known_sigma2=0)")
    m, r, p = rows.count(), basis.n, len(design.names)
    model = Model(f, design.names, plane(), grid, tuple(coords), basis, u, rows, "EM", "gaussian", "identity", k_type, m)
    model.statistics = stats.Statistics(rows, r, p)
    model.em = em.fit(model.statistics, basis, r, p, n_em, tol, k_type, known_sigma2=known_sigma2)
    # Units inside a footprint are not observed themselves: predictions use coefficients only.
    model.obs = rows if points is not None else rows.filter("bau_id IS NOT NULL")
    return model
