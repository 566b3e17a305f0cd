"""Measures, manifolds, distances and planar predicates.

Every measure has two forms of the same formula: Column expressions, which stay in generated code next to the data,
and numpy matrices, for the few hundred basis centres that the driver handles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Columns = Sequence[Column]
#: Mean radius of the Earth in km for manifolds, and the equatorial one that a bare great-circle distance uses.
EARTH_RADIUS = 6371.0
DISTANCE_RADIUS = 6378.137


@dataclass(frozen=True)
class Measure:
    """A distance between points of ``dim`` coordinates."""

    name: str
    dim: int
    column: Callable[[Columns, Columns], Column] = field(compare=False)
    matrix: Callable[[np.ndarray, np.ndarray], np.ndarray] = field(compare=False)

    def __post_init__(self) -> None:
        if not callable(self.column) or not callable(self.matrix):
            raise TypeError("a measure is made of functions")
        if int(self.dim) != self.dim or self.dim < 1:
            raise ValueError("the dimension of a measure is a positive integer")

    def between(self, a: Columns, b: Columns) -> Column:
        if len(a) != self.dim or len(b) != self.dim:
            raise ValueError(f"{self.name} needs {self.dim} coordinates")
        return self.column(a, b)

    def pairs(self, x1, x2=None) -> np.ndarray:
        """Distances between all rows of two small matrices."""
        x1 = np.atleast_2d(np.asarray(x1, float))
        x2 = x1 if x2 is None else np.atleast_2d(np.asarray(x2, float))
        if x1.shape[1] != x2.shape[1]:
            raise ValueError("matrices have different numbers of columns")
        return self.matrix(x1, x2)


def _hypot(deltas: list[Column]) -> Column:
    total = deltas[0] * deltas[0]
    for d in deltas[1:]:
        total = total + d * d
    return F.sqrt(total)


def euclidean(dim: int = 2, scales: Sequence[float] | None = None) -> Measure:
    """Euclidean distance; ``scales`` stretches axes first (anisotropy)."""
    s = np.ones(dim) if scales is None else np.asarray(scales, float)
    if len(s) != dim:
        raise ValueError("one scale for each axis")

    def column(a: Columns, b: Columns) -> Column:
        return _hypot([(x - y) * float(k) if k != 1 else x - y for x, y, k in zip(a, b, s, strict=True)])

    def matrix(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        d = (x1[:, None, :] - x2[None, :, :]) * s
        return np.sqrt((d * d).sum(axis=2))

    return Measure("euclidean" if scales is None else "anisotropic", dim, column, matrix)


def great_circle(radius: float | None = None) -> Measure:
    """Great-circle distance of (lon, lat) in degrees; the cosine is clamped to [-1, 1]."""
    r = DISTANCE_RADIUS if radius is None else float(radius)

    def column(a: Columns, b: Columns) -> Column:
        lon1, lat1, lon2, lat2 = (F.radians(x) for x in (a[0], a[1], b[0], b[1]))
        c = F.cos(lat1) * F.cos(lat2) * F.cos(lon1 - lon2) + F.sin(lat1) * F.sin(lat2)
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) * r

    def matrix(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        p, q = np.radians(x1), np.radians(x2)
        c = np.cos(p[:, None, 1]) * np.cos(q[None, :, 1]) * np.cos(p[:, None, 0] - q[None, :, 0]) + np.sin(p[:, None, 1]) * np.sin(q[None, :, 1])
        return r * np.arccos(np.clip(c, -1, 1))

    return Measure("great circle", 2, column, matrix)


def great_circle_time(radius: float | None = None) -> Measure:
    """Great-circle distance and time difference as legs of a right angle."""
    space = great_circle(radius)

    def column(a: Columns, b: Columns) -> Column:
        return _hypot([space.column(a[:2], b[:2]), a[2] - b[2]])

    def matrix(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        return np.sqrt(space.matrix(x1[:, :2], x2[:, :2]) ** 2 + (x1[:, None, 2] - x2[None, :, 2]) ** 2)

    return Measure("great circle and time", 3, column, matrix)


@dataclass(frozen=True)
class Manifold:
    """A domain with its measure; coordinates are named by position."""

    type: str
    measure: Measure
    coordnames: tuple[str, ...]
    radius: float | None = None

    @property
    def dimensions(self) -> int:
        return self.measure.dim

    @property
    def is_sphere(self) -> bool:
        return "sphere" in self.type

    @property
    def is_spacetime(self) -> bool:
        return self.type.startswith("ST")

    def distance(self, x1, x2=None) -> np.ndarray:
        return self.measure.pairs(x1, x2)

    def spatial(self) -> Manifold:
        """The manifold without time."""
        return {"STplane": plane, "STsphere": lambda: sphere(self.radius or EARTH_RADIUS)}.get(self.type, lambda: self)()

    def __repr__(self) -> str:
        return f"Manifold({self.type}, {self.dimensions} coordinates, {self.measure.name})"


def real_line(measure: Measure | None = None) -> Manifold:
    return Manifold("real_line", _of_dim(measure or euclidean(1), 1), ("x",))


def plane(measure: Measure | None = None) -> Manifold:
    return Manifold("plane", _of_dim(measure or euclidean(2), 2), ("x", "y"))


def st_plane(measure: Measure | None = None) -> Manifold:
    return Manifold("STplane", _of_dim(measure or euclidean(3), 3), ("x", "y", "t"))


def sphere(radius: float = EARTH_RADIUS) -> Manifold:
    return Manifold("sphere", great_circle(radius), ("lon", "lat"), radius)


def st_sphere(radius: float = EARTH_RADIUS) -> Manifold:
    return Manifold("STsphere", great_circle_time(radius), ("lon", "lat", "t"), radius)


def _of_dim(measure: Measure, dim: int) -> Measure:
    if measure.dim != dim:
        raise ValueError(f"this manifold needs a measure of dimension {dim}")
    return measure


def choose_manifold(lonlat: bool, has_time: bool) -> Manifold:
    """Longitude and latitude mean a sphere, else a plane; with time, its space-time version."""
    if lonlat:
        return st_sphere() if has_time else sphere()
    return st_plane() if has_time else plane()


def ring_contains(ring: str, x: str, y: str) -> Column:
    """Ray casting: whether (x, y) lies in the ring, an array of structs (x, y), closed or not. Edges count half-open."""
    edge = (
        f"CASE WHEN ({ring}[i].y > {y}) <> ({ring}[j].y > {y}) AND "
        f"{x} < ({ring}[j].x - {ring}[i].x) * ({y} - {ring}[i].y) / ({ring}[j].y - {ring}[i].y) + {ring}[i].x THEN 1 ELSE 0 END"
    )
    pairs = f"transform(sequence(0, size({ring}) - 1), i -> named_struct('i', i, 'j', (i + size({ring}) - 1) % size({ring})))"
    edge = edge.replace("[i]", "[p.i]").replace("[j]", "[p.j]")
    return F.expr(f"size({ring}) > 2 AND aggregate({pairs}, 0, (a, p) -> a + {edge}) % 2 = 1")


def ring_box(ring: Column) -> dict[str, Column]:
    """Bounding box of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise (monotone chain)."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(seq) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1:
                a, b = out[-1] - out[-2], q - out[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def pushed_hull(points: np.ndarray, convex: float = -0.05) -> np.ndarray:
    """The convex hull with vertices pushed away from their centre by -convex times the larger range on each axis."""
    hull = convex_hull(points)
    span = float(np.ptp(points, axis=0).max()) if len(points) else 0.0
    return hull + np.sign(hull - hull.mean(axis=0)) * span * -convex


def in_ring(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """numpy twin of ``ring_contains``."""
    inside = np.zeros(np.shape(x), bool)
    j = len(ring) - 1
    for i in range(len(ring)):
        (xi, yi), (xj, yj) = ring[i], ring[j]
        if yi != yj:
            inside ^= ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
        j = i
    return inside


def lonlat_to_xyz(lonlat: np.ndarray) -> np.ndarray:
    a = np.radians(np.atleast_2d(lonlat))
    return np.column_stack([np.cos(a[:, 1]) * np.cos(a[:, 0]), np.cos(a[:, 1]) * np.sin(a[:, 0]), np.sin(a[:, 1])])


def xyz_to_lonlat(xyz: np.ndarray) -> np.ndarray:
    v = np.atleast_2d(xyz)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.column_stack([np.degrees(np.arctan2(v[:, 1], v[:, 0])), np.degrees(np.arcsin(np.clip(v[:, 2], -1, 1)))])


def steps(low: float, high: float, by: float) -> int:
    """How many values low, low + by, ... do not pass high, with the slack of floating-point grids."""
    if by <= 0:
        raise ValueError("a step is positive")
    return max(0, int(math.floor((high - low) / by + 1e-10)) + 1)
