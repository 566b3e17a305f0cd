"""ISEA3H-like global grid: hexagon centres of an aperture-3 subdivision of the icosahedron, 10 * 3^k + 2 at resolution k.

Centres are lattice points of the icosahedron's faces put on the sphere through their barycentric coordinates, with
shared edges and corners counted once. Every other resolution the lattice turns by 30 degrees, as aperture 3 does.
Cells are the points nearest to their centre. Areas differ from cell to cell by more than in the equal-area projection;
counts, nesting and neighbourhoods are the same.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.geometry import lonlat_to_xyz, xyz_to_lonlat


@functools.cache
def icosahedron() -> tuple[np.ndarray, np.ndarray]:
    """(12 vertices, 20 faces) with two vertices at latitudes +-58.28 on one meridian and an edge's middle at a pole's distance."""
    g = (1 + math.sqrt(5)) / 2
    v = np.array([(s1 * a, s2 * b, 0) for a, b in ((1, g),) for s1 in (1, -1) for s2 in (1, -1)], float)
    v = np.concatenate([v, v[:, [2, 0, 1]], v[:, [1, 2, 0]]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    edge = np.sort(np.linalg.norm(v[0] - v, axis=1))[1]
    near = np.abs(np.linalg.norm(v[:, None] - v[None], axis=2) - edge) < 1e-6
    faces = [(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if near[i, j] and near[j, k] and near[i, k]]
    turn = math.radians(11.25)
    c, s = math.cos(turn), math.sin(turn)
    return v @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T, np.array(faces)


@functools.cache
def isea3h_centres(res: int) -> np.ndarray:
    """(lon, lat) of the centres at a resolution of 0 to 9."""
    if not 0 <= res <= 9:
        raise ValueError("resolutions are 0 to 9")
    v, faces = icosahedron()
    # Even resolutions: lattice of n = 3^(res/2) steps on an edge. Odd ones: every third point of n = 3^((res+1)/2), turned.
    n = 3 ** ((res + 1) // 2)
    i, j = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    keep = i + j <= n
    i, j = i[keep], j[keep]
    if res % 2:
        keep = (i - j) % 3 == 0
        i, j = i[keep], j[keep]
    bary = np.column_stack([i, j, n - i - j]) / n
    points = np.concatenate([bary @ v[f] for f in faces])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    _, first = np.unique(np.round(points, 9) + 0.0, axis=0, return_index=True)
    out = xyz_to_lonlat(points[np.sort(first)])
    out.setflags(write=False)
    return out


def isea3h_cells(spark: SparkSession, res: int) -> DataFrame:
    """(id, lon, lat, ring): cells with the ring of points half-way (on the sphere) between triples of neighbouring centres."""
    lonlat = isea3h_centres(res)
    xyz = lonlat_to_xyz(lonlat)
    rows = []
    for i, p in enumerate(xyz):
        d = np.linalg.norm(xyz - p, axis=1)
        order = np.argsort(d)[1:7]
        order = order[d[order] < 1.5 * d[order[0]]]
        north = np.array([0, 0, 1.0]) if abs(p[2]) < 0.9 else np.array([1.0, 0, 0])
        e = np.cross(north, p)
        e /= np.linalg.norm(e)
        angle = np.arctan2(xyz[order] @ np.cross(p, e), xyz[order] @ e)
        order = order[np.argsort(angle)]
        corners = xyz_to_lonlat(np.array([p + xyz[a] + xyz[b] for a, b in zip(order, np.roll(order, -1), strict=True)]))
        rows.append((i, float(lonlat[i, 0]), float(lonlat[i, 1]), [(float(a), float(b)) for a, b in corners]))
    return spark.createDataFrame(rows, "id long, lon double, lat double, ring array<struct<x:double,y:double>>")


def nearest_cell(df: DataFrame, res: int, lon: str = "lon", lat: str = "lat", out: str = "bau_id") -> DataFrame:
    """``df`` with the number of the cell that holds each point: the nearest centre, in Arrow batches."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.types import StructType

    xyz = lonlat_to_xyz(isea3h_centres(res))
    fields = [f for f in df.schema.fields if f.name != out]
    kept = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = lonlat_to_xyz(np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (lon, lat)])) if b.num_rows else np.empty((0, 3))
            best = np.concatenate([(p[i : i + 256] @ xyz.T).argmax(axis=1) for i in range(0, len(p), 256)]) if len(p) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(best, pa.int64())], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, StructType(fields).add(out, "long"))
