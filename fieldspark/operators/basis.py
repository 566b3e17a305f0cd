"""Local basis functions: kernels, placement, evaluation and set operations.

A basis is small (a few thousand centres at most) and lives on the driver as numpy arrays; evaluation is where the
data are. Compact or few functions become Column expressions; many functions are evaluated in Arrow batches against
the centres, which go to tasks in the closure.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.geometry import Manifold, in_ring, real_line

KINDS = ("bisquare", "Gaussian", "exp", "Matern32")
#: Factor from nearest-neighbour distance to scale, by kind.
SCALE_FACTOR = {"bisquare": 1.5, "Gaussian": 0.7, "exp": 0.7, "Matern32": 0.7}
ROOT3 = math.sqrt(3.0)


def kernel(kind: str, d: Column, scale: float) -> Column:
    """A kernel of a distance column."""
    u = d / float(scale)
    if kind == "bisquare":
        return F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(0.0)
    if kind == "Gaussian":
        return F.exp(u * u / -2)
    if kind == "exp":
        return F.exp(-u)
    if kind == "Matern32":
        return (1 + u * ROOT3) * F.exp(u * -ROOT3)
    raise ValueError(f"kinds are {', '.join(KINDS)}")


def kernel_array(kind: str, d: np.ndarray, scale: np.ndarray) -> np.ndarray:
    u = d / scale
    if kind == "bisquare":
        return np.where(u < 1, (1 - u * u) ** 2, 0.0)
    if kind == "Gaussian":
        return np.exp(-u * u / 2)
    if kind == "exp":
        return np.exp(-u)
    if kind == "Matern32":
        return (1 + ROOT3 * u) * np.exp(-ROOT3 * u)
    raise ValueError(f"kinds are {', '.join(KINDS)}")


@dataclass(frozen=True)
class Basis:
    """Centres with scale and resolution; ``custom`` evaluates functions of one's own on a matrix of points."""

    manifold: Manifold
    loc: np.ndarray
    scale: np.ndarray
    res: np.ndarray
    kind: str = "bisquare"
    regular: bool = False
    custom: Callable[[np.ndarray], np.ndarray] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.loc.ndim != 2 or self.loc.shape[1] != self.manifold.dimensions:
            raise ValueError("centres are a matrix with a column for each coordinate")
        if len(self.scale) != len(self.loc) or len(self.res) != len(self.loc):
            raise ValueError("one scale and one resolution for each centre")
        if not np.issubdtype(np.asarray(self.scale).dtype, np.number) or (np.asarray(self.scale) <= 0).any():
            raise ValueError("scales are positive numbers")
        if self.kind not in KINDS and self.custom is None:
            raise ValueError(f"kinds are {', '.join(KINDS)}")

    @property
    def n(self) -> int:
        return len(self.loc)

    @property
    def nres(self) -> int:
        return len(np.unique(self.res))

    def count_res(self) -> dict[int, int]:
        values, n = np.unique(self.res, return_counts=True)
        return dict(zip(values.tolist(), n.tolist(), strict=True))

    def matrix(self, points: np.ndarray) -> np.ndarray:
        """Values at a matrix of points, a column for each function."""
        points = np.atleast_2d(np.asarray(points, float))
        if self.custom is not None:
            return self.custom(points)
        return kernel_array(self.kind, self.manifold.distance(points, self.loc), self.scale)

    def columns(self, coords: Sequence[Column]) -> list[Column]:
        """Values as Column expressions, for bases of a few dozen functions."""
        return [
            kernel(self.kind, self.manifold.measure.between(coords, [F.lit(float(v)) for v in c]), s) for c, s in zip(self.loc, self.scale, strict=True)
        ]

    def frame(self, spark) -> DataFrame:
        """(k, res, loc1.., scale): the basis as a table."""
        rows = [(k, int(r), *map(float, c), float(s)) for k, (c, s, r) in enumerate(zip(self.loc, self.scale, self.res, strict=True))]
        names = ", ".join(f"loc{i + 1} double" for i in range(self.loc.shape[1]))
        return spark.createDataFrame(rows, f"k long, res int, {names}, scale double")

    def __repr__(self) -> str:
        return f"Basis({self.n} {self.kind} functions, {self.nres} resolutions, on a {self.manifold.type})"

    def summary(self) -> dict:
        return {"manifold": self.manifold.type, "n": self.n, "nres": self.nres, "regular": self.regular, "count_res": self.count_res()}


@dataclass(frozen=True)
class TensorBasis:
    """Products of spatial and temporal functions; function k = kt * n_space + ks, time slowest."""

    space: Basis
    time: Basis

    def __post_init__(self) -> None:
        if self.time.nres > 1:
            raise ValueError("the second basis has one resolution")

    @property
    def n(self) -> int:
        return self.space.n * self.time.n

    @property
    def nres(self) -> int:
        return self.space.nres * self.time.nres

    @property
    def res(self) -> np.ndarray:
        return np.tile(self.space.res, self.time.n)

    @property
    def regular(self) -> bool:
        return self.space.regular and self.time.regular

    @property
    def manifold(self) -> Manifold:
        return self.space.manifold

    def count_res(self) -> dict[int, int]:
        return {k: v * self.time.n for k, v in self.space.count_res().items()}

    def matrix(self, points: np.ndarray) -> np.ndarray:
        points = np.atleast_2d(np.asarray(points, float))
        s, t = self.space.matrix(points[:, :-1]), self.time.matrix(points[:, -1:])
        return (t[:, :, None] * s[:, None, :]).reshape(len(points), -1)

    def columns(self, coords: Sequence[Column]) -> list[Column]:
        s, t = self.space.columns(coords[:-1]), self.time.columns(coords[-1:])
        return [b * a for b in t for a in s]

    def __repr__(self) -> str:
        return f"TensorBasis({self.space.n} x {self.time.n} functions)"


AnyBasis = Basis | TensorBasis


def tensor(space: Basis, time: Basis) -> TensorBasis:
    return TensorBasis(space, time)


def local_basis(manifold: Manifold, loc, scale, kind: str = "bisquare", res=1, regular: bool | None = None) -> Basis:
    """A basis from centres and scales. Equally spaced centres on a line at one resolution are regular."""
    loc = np.asarray(loc, float)
    loc = loc.reshape(-1, manifold.dimensions) if loc.ndim < 2 else loc
    scale = np.broadcast_to(np.asarray(scale, float), (len(loc),)).copy()
    res = np.broadcast_to(np.asarray(res, int), (len(loc),)).copy()
    if regular is None:
        gaps = np.diff(np.sort(loc[:, 0])) if manifold.dimensions == 1 else np.empty(0)
        regular = bool(len(gaps) and len(np.unique(res)) == 1 and np.ptp(gaps) <= 1e-8 * max(1.0, abs(gaps.mean())))
    return Basis(manifold, loc, scale, res, kind, bool(regular))


def custom_basis(manifold: Manifold, fn: Callable[[np.ndarray], np.ndarray], n: int) -> Basis:
    """Functions of one's own: ``fn`` takes a matrix of points and returns a column for each function."""
    return Basis(manifold, np.zeros((n, manifold.dimensions)), np.ones(n), np.ones(n, int), "bisquare", False, fn)


def neighbour_scale(manifold: Manifold, loc: np.ndarray, ranges: Sequence[tuple[float, float]], aperture: float, batch: int = 2000) -> np.ndarray:
    """Distance to the nearest other centre times the aperture; half the larger range for a single centre."""
    if len(loc) == 1:
        return np.array([max(b - a for a, b in ranges) / 2])
    out = []
    for i in range(0, len(loc), batch):
        d = manifold.distance(loc[i : i + batch], loc)
        d[d == 0] = np.inf
        out.append(d.min(axis=1))
    return np.concatenate(out) * aperture


def plane_counts(ranges: Sequence[tuple[float, float]], regular: int, res: int) -> tuple[int, int]:
    """Centres on each axis of a plane: ``regular`` on the shorter side at resolution 0, three times as many at each next."""
    (x0, x1), (y0, y1) = ranges
    ratio = (y1 - y0) / (x1 - x0)
    nx, ny = (regular / ratio, regular) if ratio < 1 else (regular, regular * ratio)
    return round(nx * 3**res), round(ny * 3**res)


def _plane_loc(ranges, nx: int, ny: int) -> np.ndarray:
    xs, ys = (np.linspace(a, b, n) if n > 1 else np.array([(a + b) / 2]) for (a, b), n in zip(ranges, (nx, ny), strict=True))
    return np.array([(x, y) for y in ys for x in xs])


def scattered_centres(points: np.ndarray, n: int) -> np.ndarray:
    """Irregular placement: farthest-point sample of the data, which spreads centres where data are."""
    chosen = [0]
    d = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)):
        k = int(d.argmax())
        chosen.append(k)
        d = np.minimum(d, np.linalg.norm(points - points[k], axis=1))
    return points[chosen]


def sample_coords(data: DataFrame, coords: Sequence[str], rows: int = 10_000) -> np.ndarray:
    """A bounded sample for placement only: rows with the smallest hashes of their coordinates, the same on each run."""
    c = [F.col(x).cast("double").alias(f"c{i}") for i, x in enumerate(coords)]
    got = data.select(*c).orderBy(F.xxhash64(*[F.col(x).cast("double") for x in coords])).limit(rows).toPandas()
    return got.to_numpy(float)


def auto_basis(
    manifold: Manifold,
    ranges: Sequence[tuple[float, float]],
    nres: int = 3,
    regular: int = 1,
    kind: str = "bisquare",
    scale_aperture: float | None = None,
    max_basis: int | None = None,
    prune: float = 0.0,
    buffer: float = 0.0,
    points: np.ndarray | None = None,
    isea3h_lo: int = 2,
) -> Basis:
    """Multi-resolution placement over a domain's ranges (and, for irregular or pruned sets, sampled points)."""
    if max_basis is not None:
        best = None
        for k in range(1, 12):
            b = auto_basis(manifold, ranges, k, regular, kind, scale_aperture, None, prune, buffer, points, isea3h_lo)
            if b.n > max_basis:
                break
            best = b
        if best is None:
            raise ValueError("max_basis is too small for one resolution")
        return best
    aperture = scale_aperture if scale_aperture is not None else (1.0 if manifold.is_sphere else 1.25)
    parts = []
    for i in range(nres):
        if manifold.is_sphere:
            from ..sources.dggs import isea3h_centres

            loc = isea3h_centres(i + isea3h_lo)
            if points is not None and len(points):
                (x0, x1), (y0, y1) = ranges
                dx, dy = 0.2 * (x1 - x0), 0.2 * (y1 - y0)
                near = (loc[:, 0] >= x0 - dx) & (loc[:, 0] <= x1 + dx) & (loc[:, 1] >= y0 - dy) & (loc[:, 1] <= y1 + dy)
                loc = loc[near] if near.any() else loc
        elif manifold.dimensions == 1:
            n = max(1, (i + 1) * regular)
            loc = np.linspace(*ranges[0], n).reshape(-1, 1) if n > 1 else np.array([[sum(ranges[0]) / 2]])
        elif regular:
            loc = _plane_loc(ranges, *(max(1, v) for v in plane_counts(ranges, regular, i)))
        else:
            if points is None:
                raise ValueError("irregular placement needs points")
            loc = scattered_centres(points, round(9 * 2.5 ** (2 * i)))
        for again in range(2):
            s = neighbour_scale(manifold, loc, ranges, aperture) * SCALE_FACTOR[kind]
            b = local_basis(manifold, loc, s, kind, i + 1, bool(regular))
            if not prune or again or points is None:
                break
            keep = b.matrix(points).sum(axis=0) >= prune
            if not keep.any():
                raise ValueError("prune removes all functions of a resolution")
            loc = loc[keep]
        parts.append(b)
    out = concat(parts)
    return add_buffer(out, buffer) if buffer else out


def prune_on_data(basis: Basis, data: DataFrame, coords: Sequence[str], least: float) -> Basis:
    """Drop functions whose sum over all data is below ``least``: one pass over the data, sums of arrays."""
    totals = np.array(column_sums(evaluate(data, basis, coords, "_s").select("_s"), "_s", basis.n))
    return remove(basis, np.flatnonzero(totals < least))


def column_sums(df: DataFrame, array: str, n: int) -> list[float]:
    """Sums of each place of an array column: partial sums in batches, then one small aggregate."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in it:
            if b.num_rows:
                total += b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int64()), pa.array(total)], names=["k", "v"])

    got = df.select(array).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return [r["v"] for r in got] or [0.0] * n


def add_buffer(basis: Basis, buffer: float) -> Basis:
    """Extend each axis by ceil(buffer / 2 * n) equally spaced centres at both ends, at every resolution (regular planes)."""
    if not basis.regular or basis.manifold.dimensions != 2:
        raise ValueError("a buffer needs a regular basis on a plane")
    parts = []
    for r in np.unique(basis.res):
        mine = basis.res == r
        axes = []
        for a in range(2):
            v = np.unique(basis.loc[mine, a])
            k = math.ceil(buffer / 2 * len(v))
            step = v[1] - v[0] if len(v) > 1 else float(basis.scale[mine][0])
            axes.append(np.concatenate([v[0] - step * np.arange(k, 0, -1), v, v[-1] + step * np.arange(1, k + 1)]))
        loc = np.array([(x, y) for y in axes[1] for x in axes[0]])
        parts.append(local_basis(basis.manifold, loc, float(basis.scale[mine][0]), basis.kind, int(r), True))
    return concat(parts)


def concat(bases: Sequence[Basis]) -> Basis:
    """Functions of bases on one manifold, resolutions as they are."""
    first = bases[0]
    if any(b.manifold != first.manifold for b in bases):
        raise ValueError("bases are on different manifolds")
    join = lambda f: np.concatenate([f(b) for b in bases])
    return Basis(first.manifold, join(lambda b: b.loc), join(lambda b: b.scale), join(lambda b: b.res), first.kind, all(b.regular for b in bases))


def combine(bases: Sequence[Basis]) -> Basis:
    """Single-resolution bases as resolutions 1..n of one."""
    if any(b.nres > 1 for b in bases):
        raise ValueError("only bases of one resolution can be combined")
    return concat([replace(b, res=np.full(b.n, i + 1)) for i, b in enumerate(bases)])


def remove(basis: Basis, index: Sequence[int]) -> Basis:
    """The basis without functions by number."""
    keep = np.setdiff1d(np.arange(basis.n), np.asarray(index, int))
    return replace(basis, loc=basis.loc[keep], scale=basis.scale[keep], res=basis.res[keep])


def keep_inside(basis: Basis, rings: Sequence[np.ndarray]) -> Basis:
    """The functions whose centre lies in one of the polygons (planes)."""
    if basis.manifold.type != "plane":
        raise ValueError("only on a plane")
    inside = np.zeros(basis.n, bool)
    for r in rings:
        inside |= in_ring(np.asarray(r, float), basis.loc[:, 0], basis.loc[:, 1])
    return remove(basis, np.flatnonzero(~inside))


def time_basis(n_slots: float, n: int = 10, kind: str = "Gaussian") -> Basis:
    """Equally spaced temporal functions on [0, n_slots]; Gaussian: scale a tenth of the end; bisquare: 1.7 times that."""
    scale = n_slots / 10 * (1.7 if kind == "bisquare" else 1.0)
    return local_basis(real_line(), np.linspace(0, n_slots, n).reshape(-1, 1), scale, kind, 1, True)


def centre_distances(basis: AnyBasis) -> list[np.ndarray] | tuple[list[np.ndarray], list[np.ndarray]]:
    """Distances between centres, for each resolution; for products those of space and of time."""
    if isinstance(basis, TensorBasis):
        return centre_distances(basis.space), centre_distances(basis.time)
    return [basis.manifold.distance(basis.loc[basis.res == r]) for r in np.unique(basis.res)]


def evaluate(df: DataFrame, basis: AnyBasis, coords: Sequence[str], out: str = "s", normalise: bool = False) -> DataFrame:
    """``df`` with an array of basis values at its coordinates, in Arrow batches; rows of norm 1 with ``normalise``."""
    names = list(coords)
    others = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*others]).add(out, ArrayType(DoubleType()))
    kept = [f.name for f in others]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            points = np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names])
            m = basis.matrix(points) if len(points) else np.empty((0, basis.n))
            if normalise:
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, basis.n), pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], values], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, schema)


def evaluate_columns(df: DataFrame, basis: AnyBasis, coords: Sequence[str], out: str = "s", normalise: bool = False) -> DataFrame:
    """The same by Column expressions, for small bases: stays in generated code."""
    df = df.withColumn(out, F.array(*basis.columns([F.col(c) for c in coords])))
    return unit_norm(df, out) if normalise else df


def unit_norm(df: DataFrame, array: str = "s") -> DataFrame:
    """Arrays divided by their 2-norm; zero arrays stay."""
    norm = F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("_norm", norm).withColumn(array, F.expr(f"CASE WHEN _norm > 0 THEN transform({array}, x -> x / _norm) ELSE {array} END")).drop("_norm")


def area_average(units: DataFrame, basis: AnyBasis, size: Sequence[float], coords: Sequence[str], k: int = 5, out: str = "s", normalise: bool = False) -> DataFrame:
    """Mean of basis functions over rectangular cells, by k x k midpoints: deterministic, in one pass without shuffle."""
    names = list(coords)
    fields = [f for f in units.schema.fields if f.name != out]
    schema = StructType([*fields]).add(out, ArrayType(DoubleType()))
    kept = [f.name for f in fields]
    mid = (np.arange(k) + 0.5) / k - 0.5
    shifts = np.array(np.meshgrid(*[mid * s for s in size], indexing="ij")).reshape(len(size), -1).T

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            points = np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names])
            m = np.zeros((len(points), basis.n))
            for s in shifts:
                moved = points.copy()
                moved[:, : len(s)] += s
                m += basis.matrix(moved)
            m /= len(shifts)
            if normalise:
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, basis.n), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], values], names=[*kept, out])

    return units.select(*kept).mapInArrow(run, schema)


def unit_basis(units: DataFrame, n_spatial_units: int, basis: AnyBasis, coords: Sequence[str], size: Sequence[float], normalise: bool = True) -> DataFrame:
    """Basis values of units: at centres, or averaged over cells where there are fewer units than spatial functions."""
    n_space = basis.space.n if isinstance(basis, TensorBasis) else basis.n
    if n_spatial_units < n_space:
        return area_average(units, basis, size, coords, normalise=normalise)
    return evaluate(units, basis, coords, normalise=normalise)

