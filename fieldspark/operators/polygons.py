"""Polygons as rows: rings are arrays of structs (x, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ring_box, ring_contains


def vertices_to_polygons(df: DataFrame, keys: Sequence[str], coords: Sequence[str], order: str) -> DataFrame:
    """(keys, ring): the rows of a key, in the order of a column, are one ring. A ring is one value of one row."""
    x, y = coords
    point = F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return df.groupBy(*keys).agg(ring.alias("ring"))


def polygons_to_vertices(polygons: DataFrame, key: str, attributes: DataFrame | None = None) -> DataFrame:
    """(key, ord, x, y, attributes): a row for each vertex, attributes joined by key."""
    out = polygons.select(key, F.posexplode("ring").alias("ord", "p")).select(key, "ord", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return out if attributes is None else out.join(attributes, key, "left")


def space_time_vertices(polygons: DataFrame, key: str, slots: DataFrame) -> DataFrame:
    """Vertices of every polygon at every slot."""
    return polygons_to_vertices(polygons, key).crossJoin(F.broadcast(slots))


def squares_around(points: DataFrame, coords: Sequence[str], offset: float = 1e-10) -> DataFrame:
    """``points`` with the ring of a square of half-width ``offset``; repeated coordinates are an error."""
    x, y = coords
    if points.groupBy(x, y).count().filter("count > 1").limit(1).count():
        raise ValueError("points have repeated coordinates")
    corners = [(-offset, -offset), (offset, -offset), (offset, offset), (-offset, offset)]
    return points.withColumn("ring", F.array(*[F.struct((F.col(x) + a).alias("x"), (F.col(y) + b).alias("y")) for a, b in corners]))


def boxes(df: DataFrame, xmin, xmax, ymin, ymax) -> DataFrame:
    """``df`` with the ring of a rectangle given by four columns."""
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return df.withColumn("ring", F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax)))


def interleave(*frames: DataFrame, order: str) -> DataFrame:
    """Rows of frames of one shape by turns: first rows of all, then second rows, by an order column."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_src", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out.orderBy(order, "_src").drop("_src")


def split_dateline(cells: DataFrame, key: str = "id") -> DataFrame:
    """Rings that span more than 180 degrees of longitude become two: the western part (id suffix w) and the eastern (e).

    Longitudes are unwrapped to [0, 360), the ring is clipped at 180 (each half keeps its vertices and both crossings),
    and the western half is wrapped back; edges sit at +-179.999. ``lon`` and ``lat`` are centroids of the parts.
    """
    p = cells.withColumns(ring_box(F.col("ring"))).withColumn("_cross", F.col("xmax") - F.col("xmin") > 180)
    whole = p.filter(~F.col("_cross")).select(F.col(key).cast("string").alias(key), "ring")
    wide = p.filter("_cross").withColumn("r", F.expr("transform(ring, p -> named_struct('x', CASE WHEN p.x < 0 THEN p.x + 360D ELSE p.x END, 'y', p.y))"))

    def half(side: str, keep: str, edge: float, shift: str):
        inside = f"{{p}}.x {keep} 180D"
        pieces = (
            "flatten(transform(sequence(0, size(r) - 1), i -> concat("
            f"CASE WHEN {inside.format(p='r[i]')} THEN array(named_struct('x', r[i].x, 'y', r[i].y)) ELSE array() END, "
            f"CASE WHEN ({inside.format(p='r[i]')}) <> ({inside.format(p='r[(i + 1) % size(r)]')}) THEN array(named_struct('x', 180D, 'y', "
            "r[i].y + (180D - r[i].x) * (r[(i + 1) % size(r)].y - r[i].y) / (r[(i + 1) % size(r)].x - r[i].x))) ELSE array() END)))"
        )
        ring = f"transform({pieces}, p -> named_struct('x', CASE WHEN p.x = 180D THEN {edge}D ELSE p.x{shift} END, 'y', p.y))"
        return wide.select(F.concat(F.col(key).cast("string"), F.lit(side)).alias(key), F.expr(ring).alias("ring"))

    out = whole.unionByName(half("e", "<=", 179.999, "")).unionByName(half("w", ">", -179.999, " - 360D"))
    mean = lambda f: F.expr(f"aggregate(ring, 0D, (a, p) -> a + p.{f}) / size(ring)")
    return out.withColumns({"lon": mean("x"), "lat": mean("y")})


def contains(ring: str = "ring", x: str = "x", y: str = "y"):
    return ring_contains(ring, x, y)
