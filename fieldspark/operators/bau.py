"""Basic areal units: regular cells of a line, a plane, a sphere, time, and their products.

Units are generated where they are used, by ``range`` and arithmetic: cell numbers are their keys, so binning needs no
spatial index. A lattice carries its origin and cell size as ``Grid``; the same numbers give a point's cell as a
Column expression. Centre i of an axis is ``origin + i * size``, and its cell is half-open: [centre - size/2, centre + size/2).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Manifold, pushed_hull, ring_contains, steps

TIME_UNITS = ("secs", "mins", "hours", "days", "weeks", "months", "years")
_SECONDS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 7 * 86400, "months": 30.4375 * 86400, "years": 365.25 * 86400}
_TRUNC = {"secs": "SECOND", "mins": "MINUTE", "hours": "HOUR", "days": "DAY", "weeks": "WEEK", "months": "MONTH", "years": "YEAR"}
_STEP = {"secs": "second", "mins": "minute", "hours": "hour", "days": "day", "weeks": "week", "months": "month", "years": "year"}


@dataclass(frozen=True)
class Grid:
    """A regular lattice: per axis the first centre, the cell size and the number of cells."""

    origin: tuple[float, ...]
    size: tuple[float, ...]
    n: tuple[int, ...]

    @property
    def cells(self) -> int:
        return int(np.prod(self.n))

    def index(self, axis: int, x: Column) -> Column:
        """Number of the cell along an axis that holds x; null outside of the lattice."""
        i = F.floor((x - self.origin[axis]) / self.size[axis] + 0.5).cast("long")
        return F.when((i >= 0) & (i < self.n[axis]), i)

    def key(self, coords: Sequence[Column]) -> Column:
        """Number of the cell that holds a point; first axis fastest; null outside."""
        out, stride = None, 1
        for axis, x in enumerate(coords):
            part = self.index(axis, x) * stride
            out = part if out is None else out + part
            stride *= self.n[axis]
        return out

    def centres(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """(bau_id, names...): all cells."""
        df, stride = spark.range(self.cells).withColumnRenamed("id", "bau_id"), 1
        columns = {}
        for axis, name in enumerate(names):
            i = F.floor(F.col("bau_id") / stride) % self.n[axis]
            columns[name] = F.lit(self.origin[axis]) + i.cast("double") * self.size[axis]
            stride *= self.n[axis]
        return df.withColumns(columns)


def axis_grid(low: float, high: float, by: float) -> tuple[float, float, int]:
    return float(low), float(by), steps(low, high, by)


def extent(df: DataFrame, names: Sequence[str]) -> list[tuple[float, float]]:
    """(min, max) of each coordinate: one aggregate."""
    row = df.agg(*[f(c).cast("double") for c in names for f in (F.min, F.max)]).first()
    if row[0] is None:
        raise ValueError("there are no data to take an extent from")
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(names))]


def default_cellsize(ranges: Sequence[tuple[float, float]], has_time: bool = False) -> tuple[float, ...]:
    """A hundredth of the range on each axis, and one time unit."""
    return (*[(b - a) / 100 for a, b in ranges], *([1.0] if has_time else []))


def default_time_unit(first: float, last: float) -> str:
    """The first of days, weeks, months, years that gives fewer than 40 slots, else years. Times in seconds."""
    for unit in ("days", "weeks", "months", "years"):
        if (last - first) / _SECONDS[unit] < 40:
            return unit
    return "years"


def line_grid(ranges: tuple[float, float], cellsize: float = 1.0) -> Grid:
    """Cells of a line over the range with a fifth of it added at both ends, also where limits are given."""
    low, high = ranges
    pad = 0.2 * (high - low)
    o, s, n = axis_grid(low - pad, high + pad, cellsize)
    return Grid((o,), (s,), (n,))


def plane_grid(xrange: tuple[float, float], yrange: tuple[float, float], cellsize: Sequence[float], limits: tuple[bool, bool] = (False, False)) -> Grid:
    """Cells of a plane; a fifth of the range is added on each axis without limits."""
    axes = []
    for (low, high), by, fixed in zip((xrange, yrange), cellsize, limits, strict=True):
        pad = 0.0 if fixed else 0.2 * (high - low)
        axes.append(axis_grid(low - pad, high + pad, by))
    return Grid(*(tuple(a[i] for a in axes) for i in range(3)))


def sphere_grid(cellsize: Sequence[float], lims: tuple[tuple[float, float], tuple[float, float]] | None = None, data: list[tuple[float, float]] | None = None) -> Grid:
    """Longitude-latitude cells: inside the limits, else around the data, else on the globe."""
    world = ((-180.0, 180.0), (-90.0, 90.0))
    if lims is None and data is not None:
        lims = tuple((a - 0.2 * (b - a), b + 0.2 * (b - a)) for a, b in data)
    lims = world if lims is None else tuple((max(a, w[0]), min(b, w[1])) for (a, b), w in zip(lims, world, strict=True))
    axes = [axis_grid(a + by / 2, b - by / 2, by) for (a, b), by in zip(lims, cellsize, strict=True)]
    return Grid(*(tuple(a[i] for a in axes) for i in range(3)))


def extreme_points(points: DataFrame, names: Sequence[str], directions: int = 64) -> np.ndarray:
    """The furthest point in each of so many directions, of equally far ones the least: vertices of the data's convex hull.

    A task keeps one point for each direction while its batches pass, and sends those; the rest is a small aggregate.
    """
    x, y = names
    angles = np.linspace(0, 2 * np.pi, directions, endpoint=False)
    ways = np.column_stack([np.cos(angles), np.sin(angles)])

    def furthest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, best = np.full(directions, -np.inf), np.zeros((directions, 2))
        for b in it:
            if b.num_rows:
                p = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
                p = p[np.lexsort((p[:, 1], p[:, 0]))]
                reach = ways @ p.T
                at = reach.argmax(axis=1)
                top, p = reach[np.arange(directions), at], p[at]
                better = (top > far) | (top == far) & ((p[:, 0] < best[:, 0]) | (p[:, 0] == best[:, 0]) & (p[:, 1] < best[:, 1]))
                far, best = np.where(better, top, far), np.where(better[:, None], p, best)
        if np.isfinite(far).all():
            yield pa.RecordBatch.from_arrays([pa.array(range(directions), pa.int32()), pa.array(-far), pa.array(best[:, 0]), pa.array(best[:, 1])], names=["way", "near", "x", "y"])

    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("abs(x) < 'Infinity' AND abs(y) < 'Infinity'")
    found = p.mapInArrow(furthest, "way int, near double, x double, y double").groupBy("way").agg(F.min(F.struct("near", "x", "y")).alias("p"))
    return np.array(sorted((r.p.x, r.p.y) for r in found.collect()), float).reshape(-1, 2)


def hull_filter(cells: DataFrame, grid: Grid, points: DataFrame, names: Sequence[str], convex: float = -0.05) -> DataFrame:
    """Cells whose centre lies in the data's pushed hull, or that hold a hull vertex or a point.

    The hull comes from extreme points only, so what the driver sees has a fixed size.
    """
    x, y = names
    extreme = extreme_points(points, names)
    hull = pushed_hull(extreme, convex)
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in hull])
    vertices = [grid_key(grid, v) for v in hull]
    data_cells = points.select(grid.key([F.col(x), F.col(y)]).alias("bau_id")).filter("bau_id IS NOT NULL").distinct().withColumn("_data", F.lit(True))
    inside = cells.withColumn("_ring", ring).withColumn("_in", ring_contains("_ring", f"`{x}`", f"`{y}`")).drop("_ring")
    keep = inside.join(data_cells, "bau_id", "left")
    on_hull = F.col("bau_id").isin([k for k in vertices if k is not None])
    return keep.filter(F.col("_in") | on_hull | F.coalesce("_data", F.lit(False))).drop("_in", "_data")


def grid_key(grid: Grid, point: Sequence[float]) -> int | None:
    key, stride = 0, 1
    for axis, v in enumerate(point):
        i = int(np.floor((v - grid.origin[axis]) / grid.size[axis] + 0.5))
        if not 0 <= i < grid.n[axis]:
            return None
        key += i * stride
        stride *= grid.n[axis]
    return key


def hex_cells(spark: SparkSession, xrange: tuple[float, float], yrange: tuple[float, float], size: float) -> DataFrame:
    """(bau_id, x, y): centres of pointy-top hexagons ``size`` apart over the ranges; rows alternate by half a cell."""
    dy = size * np.sqrt(3) / 2
    nx, ny = steps(xrange[0], xrange[1], size), steps(yrange[0], yrange[1], dy)
    row = F.floor(F.col("id") / nx)
    x = F.lit(xrange[0]) + (F.col("id") % nx).cast("double") * size + F.when(row % 2 == 1, size / 2).otherwise(0.0)
    return spark.range(nx * ny).select(F.col("id").alias("bau_id"), x.alias("x"), (F.lit(yrange[0]) + row.cast("double") * dy).alias("y"))


def hex_key(x: Column, y: Column, xrange: tuple[float, float], yrange: tuple[float, float], size: float) -> Column:
    """Number of the hexagon whose centre is nearest: the better of the two rows around a point; null outside all of them.

    Of equally near centres, as computed in doubles, the one in the lower row, then the one further right.
    """
    dy = size * np.sqrt(3) / 2
    nx, ny = steps(xrange[0], xrange[1], size), steps(yrange[0], yrange[1], dy)

    def candidate(row: Column) -> tuple[Column, Column]:
        shift = F.when(F.pmod(row, F.lit(2)) == 1, size / 2).otherwise(0.0)
        col = F.floor((x - xrange[0] - shift) / size + 0.5)
        d = F.pow(x - xrange[0] - shift - col * size, 2) + F.pow(y - yrange[0] - row * dy, 2)
        return d, F.when((col >= 0) & (col < nx) & (row >= 0) & (row < ny), (row * nx + col).cast("long"))

    low = F.floor((y - yrange[0]) / dy)
    (d1, k1), (d2, k2) = candidate(low), candidate(low + 1)
    return F.when(d1 <= d2, k1).otherwise(k2)


def hex_ring(size: float) -> Column:
    """Ring of the hexagon around columns x, y."""
    r = size / np.sqrt(3)
    corners = [(r * np.cos(a), r * np.sin(a)) for a in np.pi / 6 + np.arange(6) * np.pi / 3]
    return F.array(*[F.struct((F.col("x") + float(a)).alias("x"), (F.col("y") + float(b)).alias("y")) for a, b in corners])


def time_slots(spark: SparkSession, first: str, last: str, unit: str, every: int = 1) -> DataFrame:
    """(t, start): slots from the first time cut to the unit to the last, plus a second, rounded up to it; t counts from 1."""
    if unit not in TIME_UNITS:
        raise ValueError(f"time units are {', '.join(TIME_UNITS)}")
    low = f"date_trunc('{_TRUNC[unit]}', TIMESTAMP '{first}')"
    high = f"TIMESTAMP '{last}' + INTERVAL 1 SECOND"
    cut = f"date_trunc('{_TRUNC[unit]}', {high})"
    ceil = f"CASE WHEN {cut} = {high} THEN {high} ELSE {cut} + INTERVAL 1 {_STEP[unit]} END"
    df = spark.range(1).select(F.explode(F.expr(f"sequence({low}, {ceil}, INTERVAL {every} {_STEP[unit]})")).alias("start"))
    # One row holds all slots: their number is that of time units, not of data.
    return df.select(F.expr("start").alias("start")).withColumn("t", F.row_number().over(_by("start")).cast("long")).select("t", "start")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(column)


def space_time(space: DataFrame, slots: DataFrame, n_space: int) -> DataFrame:
    """Spatial units times slots; ``bau_id`` = (t - 1) * n_space + spatial number, time slowest."""
    s = space.withColumnRenamed("bau_id", "s_id")
    return s.crossJoin(F.broadcast(slots)).withColumn("bau_id", (F.col("t") - 1) * n_space + F.col("s_id"))


def auto_baus(
    data: DataFrame,
    manifold: Manifold,
    coords: Sequence[str],
    cellsize: Sequence[float] | float | None = None,
    xlims: tuple[float, float] | None = None,
    ylims: tuple[float, float] | None = None,
    convex: float = -0.05,
    prune: bool = True,
) -> tuple[DataFrame, Grid]:
    """Units for point data on a line, a plane or a sphere, with ``fs`` and ``wts`` of 1, and their lattice."""
    spark = data.sparkSession
    names = list(coords)
    ranges = extent(data, names)
    if manifold.type == "real_line":
        grid = line_grid(xlims or ranges[0], float(cellsize if cellsize is not None else 1.0))
        cells = grid.centres(spark, names)
    else:
        size = default_cellsize(ranges) if cellsize is None else cellsize
        size = (float(size),) * 2 if isinstance(size, (int, float)) else tuple(map(float, size))
        if len(size) != 2:
            raise ValueError("cellsize needs one number or one for each axis")
        if manifold.is_sphere:
            lims = (xlims, ylims) if xlims and ylims else None
            grid = sphere_grid(size, lims, None if lims else ranges)
            cells = grid.centres(spark, names)
        else:
            grid = plane_grid(xlims or ranges[0], ylims or ranges[1], size, (xlims is not None, ylims is not None))
            cells = grid.centres(spark, names)
            if prune and xlims is None and ylims is None:
                cells = hull_filter(cells, grid, data, names, convex)
    return cells.withColumns({"fs": F.lit(1.0), "wts": F.lit(1.0)}), grid
