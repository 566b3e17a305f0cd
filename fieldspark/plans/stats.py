"""Sufficient statistics of the Gaussian model from distributed rows.

A row has z, ve (error variance), v (fine-scale weight), x (fixed effects) and s (basis values). Everything a fit needs
are weighted cross-products of [s, x, z]: a batch is multiplied in numpy, partial matrices are summed by matrix row
over tasks, and only a (r + p + 1) square matrix reaches the driver. With few distinct pairs (ve, v) one pass serves
all iterations, as weights are then constants of groups; else each set of weights is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block(batch: pa.RecordBatch) -> np.ndarray:
    """[s, x, z] of a batch as a matrix."""
    n = batch.num_rows
    wide = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("s", "x")]
    return np.column_stack([*wide, batch.column("z").to_numpy(zero_copy_only=False)])


def _sum_rows(t: pa.Table) -> pa.Table:
    k = len(t.column("row")[0])
    total = t.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k).sum(axis=0)
    return pa.table({"what": t.column("what")[:1], "i": t.column("i")[:1], "row": pa.array([total], pa.list_(pa.float64()))})


def cross_products(rows: DataFrame, weights: list, size: int) -> dict[int, np.ndarray]:
    """For each weight function w(ve, v) the matrix sum of w * [s, x, z]'[s, x, z]; one pass for all."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), size, size))
        for b in it:
            if b.num_rows:
                m = block(b)
                ve, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ve", "v"))
                for k, w in enumerate(weights):
                    total[k] += (m * w(ve, v)[:, None]).T @ m
        k, i = np.divmod(np.arange(len(weights) * size), size)
        data = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, size), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64()), data], names=["what", "i", "row"])

    parts = rows.select("s", "x", "z", "ve", "v").mapInArrow(run, "what long, i long, row array<double>")
    got = parts.groupBy("what", "i").applyInArrow(_sum_rows, "what long, i long, row array<double>").collect()
    out = {k: np.zeros((size, size)) for k in range(len(weights))}
    for r in got:
        out[r["what"]][r["i"]] = r["row"]
    return out


@dataclass
class Moments:
    """At a value of the fine-scale variance: a0 = sum d G, a1 = sum v d^2 G, sum v d, sum log(1/d), with d = 1/(s2 v + ve)."""

    a0: np.ndarray
    a1: np.ndarray
    vd: float
    logd: float


class Statistics:
    """Moments of rows at any fine-scale variance."""

    MAX_GROUPS = 64

    def __init__(self, rows: DataFrame, r: int, p: int):
        self.rows, self.r, self.p, self.size = rows, r, p, r + p + 1
        groups = rows.groupBy("ve", "v").agg(F.count(F.lit(1)).alias("n")).limit(self.MAX_GROUPS + 1).collect()
        self.m = int(sum(g["n"] for g in groups)) if len(groups) <= self.MAX_GROUPS else rows.count()
        if not self.m:
            raise ValueError("there are no observations in any unit")
        self.groups = None
        if len(groups) <= self.MAX_GROUPS:
            pairs = [(float(g["ve"]), float(g["v"])) for g in groups]
            weights = [lambda ve, v, a=a, b=b: ((ve == a) & (v == b)).astype(float) for a, b in pairs]
            g = cross_products(rows, weights, self.size)
            self.groups = [(a, b, int(x["n"]), g[i]) for i, ((a, b), x) in enumerate(zip(pairs, groups, strict=True))]
        total = self.unweighted()
        self.mean_ve = rows.agg(F.avg("ve")).first()[0]
        z_mean = total[-1, r] / self.m if p else 0.0
        self.var_z = max((total[-1, -1] - self.m * z_mean**2) / max(1, self.m - 1), 1e-12)

    def unweighted(self) -> np.ndarray:
        if self.groups is not None:
            return sum(g for *_, g in self.groups)
        return cross_products(self.rows, [lambda ve, v: np.ones_like(ve)], self.size)[0]

    def at(self, sigma2: float) -> Moments:
        if self.groups is not None:
            d = [1 / (sigma2 * v + ve) for ve, v, *_ in self.groups]
            return Moments(
                sum(w * g for w, (*_, g) in zip(d, self.groups, strict=True)),
                sum(v * w * w * g for w, (_, v, _, g) in zip(d, self.groups, strict=True)),
                sum(v * w * n for w, (_, v, n, _) in zip(d, self.groups, strict=True)),
                -sum(np.log(w) * n for w, (_, _, n, _) in zip(d, self.groups, strict=True)),
            )
        g = cross_products(self.rows, [lambda ve, v: 1 / (sigma2 * v + ve), lambda ve, v: v / (sigma2 * v + ve) ** 2], self.size)
        d = f"(1D / ({float(sigma2)!r} * v + ve))"
        vd, logd = self.rows.agg(F.sum(F.expr(f"v * {d}")), F.sum(F.expr(f"-ln({d})"))).first()
        return Moments(g[0], g[1], float(vd), float(logd))


def collapse(obs: DataFrame) -> DataFrame:
    """Observations that share units, each in one unit, as one pseudo-observation per unit, with the likelihood's constant.

    w = sum 1/ve, z = sum (z/ve) / w, ve = 1/w; ``const`` adds to -2 log likelihood: sum log ve + log w + sum (z_j - z)^2 / ve_j
    + (n - 1) log 2 pi. (x, s and v are the unit's, so residuals differ by z only.)
    """
    o = obs.withColumn("iv", 1 / F.col("ve"))
    g = o.groupBy("bau_id").agg(
        F.sum("iv").alias("w"), F.sum(F.col("iv") * F.col("z")).alias("wz"), F.sum(F.col("iv") * F.col("z") * F.col("z")).alias("wzz"),
        F.sum(F.log("ve")).alias("lv"), F.count(F.lit(1)).alias("n"),
    )
    z = F.col("wz") / F.col("w")
    const = F.col("lv") + F.log("w") + F.greatest(F.col("wzz") - F.col("w") * z * z, F.lit(0.0)) + (F.col("n") - 1) * float(np.log(2 * np.pi))
    return g.select("bau_id", z.alias("z"), (1 / F.col("w")).alias("ve"), "n", const.alias("const"))


def vector_sums(df: DataFrame, key: str, vector: str, scalars: list[str]) -> DataFrame:
    """Sums of an array column and scalars by key: batches add up first, so a key with many rows is summed in parts."""
    cols = [key, vector, *scalars]
    schema = f"{key} long, {vector} array<double>, " + ", ".join(f"{s} double" for s in scalars)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield _sums(pa.Table.from_batches([b]), key, vector, scalars).to_batches()[0]

    def final(t: pa.Table) -> pa.Table:
        return _sums(t, key, vector, scalars)

    return df.select(*cols).mapInArrow(partial, schema).groupBy(key).applyInArrow(final, schema)


def _sums(t: pa.Table, key: str, vector: str, scalars: list[str]) -> pa.Table:
    t = t.combine_chunks()
    keys, inv = np.unique(t.column(key).to_numpy(), return_inverse=True)
    m = t.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    out = np.zeros((len(keys), m.shape[1]))
    np.add.at(out, inv, m)
    data = {key: pa.array(keys, pa.int64()), vector: pa.array(list(out), pa.list_(pa.float64()))}
    for s in scalars:
        data[s] = pa.array(np.bincount(inv, weights=t.column(s).to_numpy(), minlength=len(keys)))
    return pa.table(data)
