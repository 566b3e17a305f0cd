"""Prediction over units, regions and points: row-local closed forms with small matrices sent to tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .em import EMState, e_step
from .linalg import quadratic_rows
from .stats import Statistics, vector_sums


def observation_weights(obs: DataFrame) -> DataFrame:
    """(bau_id, w, zt): precision sums and weighted means of observations that each lie in one unit."""
    g = obs.filter("bau_id IS NOT NULL").groupBy("bau_id").agg(F.sum(1 / F.col("ve")).alias("w"), F.sum(F.col("z") / F.col("ve")).alias("wz"))
    return g.select("bau_id", "w", (F.col("wz") / F.col("w")).alias("zt"))


class Predictor:
    """Case 2 (fine-scale variation belongs to the process) uses parameters after the last M step; case 1, and a fine-scale
    variance of 0, use the conditional mean and covariance of the last E step."""

    def __init__(self, state: EMState, st: Statistics, r: int, p: int, obs_fs: bool = False):
        self.state, self.obs_fs = state, obs_fs
        self.fine = not obs_fs and state.sigma2 > 0
        self.mu, self.s_eta = e_step(st.at(state.sigma2), state, r, p) if self.fine else (state.mu, state.s_eta)

    def units(self, units: DataFrame, weights: DataFrame) -> DataFrame:
        """``units`` (bau_id, x, s, v, ...) with mu, var, sd and, for regions, shrink (1 - b) and own (variance of its own)."""
        u = units.join(weights, "bau_id", "left")
        kept = [c for c in units.columns if c not in ("mu", "var", "sd", "shrink", "own")]
        mu_eta, s_eta, alpha, s2, fine = self.mu, self.s_eta, self.state.alpha, self.state.sigma2, self.fine

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                n = b.num_rows
                arr = lambda c, b=b, n=n: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                num = lambda c, b=b: np.nan_to_num(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False))
                s, x = (arr("s"), arr("x")) if n else (np.empty((0, len(mu_eta))), np.empty((0, len(alpha))))
                trend = x @ alpha + s @ mu_eta
                spread = quadratic_rows(s, s_eta)
                if fine:
                    w, zt, q = num("w"), num("zt"), 1 / (s2 * num("v"))
                    k = w / (w + q)
                    mean, shrink, own = trend + k * (zt - trend), 1 - k, 1 / (w + q)
                else:
                    mean, shrink, own = trend, np.ones(n), np.zeros(n)
                var = shrink**2 * spread + own
                new = [pa.array(c) for c in (mean, var, np.sqrt(var), shrink, own)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], names=[*kept, "mu", "var", "sd", "shrink", "own"])

        from pyspark.sql.types import StructType

        schema = StructType([f for f in units.schema.fields if f.name in kept])
        for c in ("mu", "var", "sd", "shrink", "own"):
            schema = schema.add(c, "double")
        return u.select(*kept, "w", "zt").mapInArrow(run, schema)

    def regions(self, predicted: DataFrame, c: DataFrame, key: str = "region_id") -> DataFrame:
        """(region, mu, var, sd) of weighted sums of units; c is (region, bau_id, x) with weights as wanted."""
        s_eta = self.s_eta
        j = c.join(predicted.select("bau_id", "mu", "shrink", "own", "s"), "bau_id")
        j = j.select(
            F.col(key).cast("long").alias(key), F.transform("s", lambda v: v * F.col("x") * F.col("shrink")).alias("a"),
            (F.col("x") * F.col("mu")).alias("mu"), (F.col("x") * F.col("x") * F.col("own")).alias("h"),
        )

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                a = b.column("a").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                var = quadratic_rows(a, s_eta) + b.column("h").to_numpy() if b.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("mu"), pa.array(var), pa.array(np.sqrt(var))], names=[key, "mu", "var", "sd"])

        return vector_sums(j, key, "a", ["mu", "h"]).mapInArrow(run, f"{key} long, mu double, var double, sd double")

    def covariance(self, predicted: DataFrame, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """(bau_ids, matrix) over at most ``most`` units, on the driver; more are an error."""
        rows = predicted.select("bau_id", "s", "shrink", "own").orderBy("bau_id").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"covariances are for {most} targets at most")
        a = np.array([r["s"] for r in rows]) * np.array([r["shrink"] for r in rows])[:, None]
        return np.array([r["bau_id"] for r in rows]), a @ self.s_eta @ a.T + np.diag([r["own"] for r in rows])


def at_points(predicted: DataFrame, points: DataFrame, key) -> DataFrame:
    """Predictions of the units that hold points."""
    p = points.withColumn("bau_id", key)
    return p.join(predicted.select("bau_id", *[c for c in predicted.columns if c != "bau_id" and c not in points.columns]), "bau_id")


def interval90(df: DataFrame, quantity: str) -> DataFrame:
    return df.withColumn(f"interval90_{quantity}", F.col(f"{quantity}_percentile_95") - F.col(f"{quantity}_percentile_5"))
