"""Change of support: binning of points, areas and space-time data onto areal units, and incidence tables.

Points meet lattice cells by an equi-join on the computed cell number: binning is one aggregate with map-side combine
and no spatial index. Areas meet cells by the lattice columns and rows of their bounding box (bounded by the area
itself), then by point in polygon. An incidence table is (obs_id, bau_id, x).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.geometry import ring_box, ring_contains
from .bau import Grid


def _aggregates(df: DataFrame, columns: Sequence[str], sums: Sequence[str]) -> list[Column]:
    """Means of numbers and truth values, sums where asked, first values of all else."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, NumericType | BooleanType):
            value = F.col(c).cast("double")
            out.append((F.sum(value) if c in sums else F.avg(value)).alias(c))
        else:
            out.append(F.min_by(c, "_ord").alias(c))
    return out


def bin_points(
    data: DataFrame, key: Column, units: DataFrame | None = None, average: bool = True, sums: Sequence[str] = (), drop: Sequence[str] = (), obs_id: str | None = None
) -> DataFrame:
    """Point data on units: ``key`` gives a point's unit, null outside. Points outside all units are dropped.

    With ``average`` a row for each unit: numeric columns are averaged (summed if in ``sums``), others keep the first
    value. Columns of ``units``, coordinates among them, come from there; data columns of the same names go.
    """
    theirs = set(units.columns) if units is not None else set()
    mine = [c for c in data.columns if c not in theirs and c not in drop]
    d = data.select(*mine, key.alias("bau_id")).filter("bau_id IS NOT NULL")
    if average:
        order = F.col(obs_id) if obs_id else F.xxhash64(*[F.col(c) for c in mine])
        d = d.withColumn("_ord", order)
        d = d.groupBy("bau_id").agg(*_aggregates(data, [c for c in mine if c != obs_id], sums))
    return d if units is None else d.join(units, "bau_id")


def outside_count(data: DataFrame, key: Column) -> int:
    """How many points lie in no unit (the reason for a warning)."""
    return data.filter(key.isNull()).count()


def slot_key(ts: Column, slots: DataFrame) -> tuple[DataFrame, str]:
    """Slots as half-open intervals (t, start, stop); the last is open for one more second."""
    w = Window.partitionBy(F.lit(0)).orderBy("start")
    return slots.withColumn("stop", F.coalesce(F.lead("start").over(w), F.col("start") + F.expr("INTERVAL 1 SECOND"))), "start <= ts AND ts < stop"


def bin_space_time(data: DataFrame, key: Column, ts: str, slots: DataFrame, n_space: int, sums: Sequence[str] = (), obs_id: str | None = None) -> DataFrame:
    """Data on units x slots: the slot whose half-open interval holds the time, then the spatial unit.

    Slots are generated (their number is that of time units), so they are sent to all tasks.
    """
    s, condition = slot_key(F.col(ts), slots)
    d = data.withColumn("ts", F.col(ts)).join(F.broadcast(s), F.expr(condition)).drop("start", "stop", "ts")
    return bin_points(d, (F.col("t") - 1) * n_space + key, average=True, sums=sums, drop=["t", ts], obs_id=obs_id)


def box_candidates(areas: DataFrame, grid: Grid, id_col: str = "obs_id") -> DataFrame:
    """(id, ring, bau_id, bx, by): units whose centre may lie in an area, from its bounding box on the lattice."""
    b = areas.withColumns(ring_box(F.col("ring")))

    def span(axis: int, low: str, high: str) -> Column:
        first = F.ceil((F.col(low) - grid.origin[axis]) / grid.size[axis]).cast("long")
        last = F.floor((F.col(high) - grid.origin[axis]) / grid.size[axis]).cast("long")
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(grid.n[axis] - 1))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    b = b.withColumn("_i", F.explode(span(0, "xmin", "xmax"))).withColumn("_j", F.explode(span(1, "ymin", "ymax")))
    return b.select(
        id_col,
        "ring",
        (F.col("_j") * grid.n[0] + F.col("_i")).alias("bau_id"),
        (F.lit(grid.origin[0]) + F.col("_i").cast("double") * grid.size[0]).alias("bx"),
        (F.lit(grid.origin[1]) + F.col("_j").cast("double") * grid.size[1]).alias("by"),
    )


def cells_in_areas(areas: DataFrame, grid: Grid, id_col: str = "obs_id") -> DataFrame:
    """(id, bau_id): units whose centre lies in the area."""
    return box_candidates(areas, grid, id_col).filter(ring_contains("ring", "bx", "by")).select(id_col, "bau_id")


def incidence_points(binned: DataFrame, id_col: str = "obs_id") -> DataFrame:
    return binned.select(id_col, "bau_id", F.lit(1.0).alias("x"))


def incidence_areas(areas: DataFrame, grid: Grid, units: DataFrame, id_col: str = "obs_id") -> DataFrame:
    """Weights of units whose centre lies in an area; an area with none takes the unit that holds its own middle.

    ``units`` has bau_id and wts; a missing weight is an error at run time.
    """
    hit = cells_in_areas(areas, grid, id_col).join(units.select("bau_id", "wts"), "bau_id")
    middle = areas.withColumns({"_x": F.expr("aggregate(ring, 0D, (a, p) -> a + p.x) / size(ring)"), "_y": F.expr("aggregate(ring, 0D, (a, p) -> a + p.y) / size(ring)")})
    alone = middle.join(hit.select(id_col).distinct(), id_col, "left_anti").select(id_col, grid.key([F.col("_x"), F.col("_y")]).alias("bau_id"))
    alone = alone.join(units.select("bau_id", "wts"), "bau_id")
    out = hit.select(id_col, "bau_id", "wts").unionByName(alone.select(id_col, "bau_id", "wts"))
    weight = F.coalesce("wts", F.raise_error(F.lit("a unit has no weight")).cast("double"))
    return out.select(id_col, "bau_id", weight.alias("x"))


def incidence_slots(binned: DataFrame, id_col: str = "obs_id") -> DataFrame:
    """Incidence of space-time data: each observation at its own unit number."""
    return incidence_points(binned, id_col)


def repeat_over_slots(spatial: DataFrame, obs_slots: DataFrame, n_space: int, id_col: str = "obs_id") -> DataFrame:
    """Spatial incidence repeated at each observation's slot; an observation at two slots is an error (no change of temporal support)."""
    if obs_slots.groupBy(id_col).count().filter("count > 1").limit(1).count():
        raise ValueError("an observation matches more than one slot")
    return spatial.join(obs_slots.select(id_col, "t"), id_col).select(id_col, ((F.col("t") - 1) * n_space + F.col("bau_id")).alias("bau_id"), F.lit(1.0).alias("x"))


def normalise(c: DataFrame, id_col: str = "obs_id") -> DataFrame:
    """Weights of an observation sum to one (a weighted mean); a zero sum is an error."""
    total = F.sum("x").over(Window.partitionBy(id_col))
    safe = F.when(total == 0, F.raise_error(F.lit("weights of an observation sum to zero")).cast("double")).otherwise(total)
    return c.withColumn("x", F.col("x") / safe)


def area_means(areas: DataFrame, grid: Grid, units: DataFrame, covariates: Sequence[str], id_col: str = "obs_id") -> DataFrame:
    """``areas`` with the means of covariates over units whose centre lies inside."""
    hit = cells_in_areas(areas, grid, id_col).join(units.select("bau_id", *covariates), "bau_id")
    means = hit.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in covariates])
    return areas.join(means, id_col, "left")


def observed(units: DataFrame, c: DataFrame) -> DataFrame:
    return units.join(c.select("bau_id").distinct(), "bau_id", "left_semi")


def unobserved(units: DataFrame, c: DataFrame) -> DataFrame:
    return units.join(c.select("bau_id").distinct(), "bau_id", "left_anti")


def binned_data(units: DataFrame, binned: DataFrame, z: str = "z") -> DataFrame:
    """(bau_id, z): the binned response, null where a unit is unobserved."""
    return units.select("bau_id").join(binned.select("bau_id", z), "bau_id", "left")


def apply_incidence(c: DataFrame, values: DataFrame, columns: Sequence[str], id_col: str = "obs_id") -> DataFrame:
    """Weighted sums of unit columns for each observation."""
    j = c.join(values.select("bau_id", *columns), "bau_id")
    return j.groupBy(id_col).agg(*[F.sum(F.col("x") * F.col(k)).alias(k) for k in columns])


def bind_datasets(*frames: DataFrame) -> DataFrame:
    """Several datasets as one, told apart by ``dataset_id`` from 0."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("dataset_id", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
