"""Driver queries of the spatial engine and their DuckDB equivalents.

The tables have no geography, so line items stand for points: x = quantity, y = price in thousands, z = a signal over
them; customers get longitudes and latitudes from their keys; events are space-time data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import families
from .functions.geometry import euclidean, great_circle, great_circle_time, plane, real_line
from .operators import basis as B
from .operators import bau as U
from .operators import formula as Fm
from .operators import lattice as L
from .operators import polygons as P
from .operators import support as S
from .operators import variogram as V
from .plans import em, stats
from .plans.predict import Predictor, observation_weights

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}

GRID = U.Grid((0.0, 0.0), (5.0, 5.0), (11, 22))
VE = 0.02
R6 = lambda c: F.round(c, 6)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s is not None}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """obs_id, x, y, z, ts, tag of line items."""
    t = table(spark, d, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    z = F.col("l_discount") * 10 + F.sin(x / 8) + F.cos(y / 20)
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"), x.alias("x"), y.alias("y"), z.alias("z"),
        F.col("l_discount").alias("disc"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("tag"),
    )


def key() -> Column:
    return GRID.key([F.col("x"), F.col("y")])


def units(spark: SparkSession) -> DataFrame:
    return GRID.centres(spark, ("ux", "uy")).withColumns({"fs": F.lit(1.0), "wts": F.lit(1.0)})


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Rectangular footprints: one for each supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs_id"))
    k = F.col("obs_id")
    x0, y0 = (k * 7 % 40).cast("double") + 0.3, (k * 13 % 90).cast("double") + 0.7
    w, h = (k % 5 + 1).cast("double") * 2.1, (k % 7 + 1).cast("double") * 2.3
    return P.boxes(s, x0, x0 + w, y0, y0 + h)


_KEY = "(floor(x / 5.0 + 0.5) + 11 * floor(y / 5.0 + 0.5))::BIGINT"
_IN = "floor(x / 5.0 + 0.5) BETWEEN 0 AND 10 AND floor(y / 5.0 + 0.5) BETWEEN 0 AND 21"
_PTS = """pts AS (SELECT l_orderkey * 10 + l_linenumber AS obs_id, l_quantity AS x, l_extendedprice / 1000 AS y,
  l_discount * 10 + sin(l_quantity / 8) + cos(l_extendedprice / 1000 / 20) AS z, l_discount AS disc, l_shipdate AS ts, l_returnflag AS tag FROM lineitem)"""
_UNITS = "units AS (SELECT (i + 11 * j)::BIGINT AS bau_id, 5.0::DOUBLE * i AS ux, 5.0::DOUBLE * j AS uy FROM range(11) a(i), range(22) b(j))"
_BIN = f"bin AS (SELECT {_KEY} AS bau_id, avg(z) AS z, count(*) AS n FROM pts WHERE {_IN} GROUP BY 1)"
_AREAS = """areas AS (SELECT s_suppkey AS obs_id, (s_suppkey * 7 % 40) + 0.3::DOUBLE AS x0, (s_suppkey * 13 % 90) + 0.7::DOUBLE AS y0,
  (s_suppkey * 7 % 40) + 0.3::DOUBLE + (s_suppkey % 5 + 1) * 2.1::DOUBLE AS x1, (s_suppkey * 13 % 90) + 0.7::DOUBLE + (s_suppkey % 7 + 1) * 2.3::DOUBLE AS y1 FROM supplier)"""
_HIT = "hit AS (SELECT obs_id, bau_id, ux, uy FROM areas JOIN units ON ux > x0 AND ux < x1 AND uy > y0 AND uy < y1)"

# Areal units ------------------------------------------------------------------------------------------------------


@query("bau_line", "SELECT i::BIGINT AS bau_id, i - 2.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM range(15) t(i)")
def bau_line(spark, d):
    return U.line_grid((0.0, 10.0), 1.0).centres(spark, ("x",)).withColumn("y", F.lit(0.0))


@query("bau_plane_grid", "SELECT (i + 9 * j)::BIGINT AS bau_id, -2 + 0.5::DOUBLE * i AS x, -2 + 0.5::DOUBLE * j AS y FROM range(9) a(i), range(9) b(j)")
def bau_plane(spark, d):
    return U.plane_grid((-2.0, 2.0), (-2.0, 2.0), (0.5, 0.5), (True, True)).centres(spark, ("x", "y"))


@query("bau_sphere_grid", "SELECT (i + 18 * j)::BIGINT AS bau_id, -170 + 20.0::DOUBLE * i AS lon, -85 + 10.0::DOUBLE * j AS lat FROM range(18) a(i), range(18) b(j)")
def bau_sphere(spark, d):
    return U.sphere_grid((20.0, 10.0)).centres(spark, ("lon", "lat"))


@query("bau_sphere_limits", "SELECT (i + 11 * j)::BIGINT AS bau_id, -90 + 20.0::DOUBLE * i AS lon, -75 + 10.0::DOUBLE * j AS lat FROM range(11) a(i), range(15) b(j)")
def bau_sphere_limits(spark, d):
    return U.sphere_grid((20.0, 10.0), ((-100, 120), (-80, 70))).centres(spark, ("lon", "lat"))


def slots(spark: SparkSession, d: str, unit: str = "days") -> DataFrame:
    a, b = table(spark, d, "events").agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    return U.time_slots(spark, a, b, unit)


_SLOTS = """slots AS (SELECT row_number() OVER (ORDER BY start) AS t, start FROM (
  SELECT unnest(generate_series(date_trunc('day', min(ts)), CASE WHEN date_trunc('day', max(ts) + INTERVAL 1 SECOND) = max(ts) + INTERVAL 1 SECOND THEN max(ts) + INTERVAL 1 SECOND
    ELSE date_trunc('day', max(ts) + INTERVAL 1 SECOND) + INTERVAL 1 DAY END, INTERVAL 1 DAY)) AS start FROM events))"""


@query("bau_time", f"WITH {_SLOTS} SELECT t, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM slots")
def bau_time(spark, d):
    return slots(spark, d).select("t", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("bau_space_time", f"WITH {_SLOTS} SELECT ((t - 1) * 10 + i)::BIGINT AS bau_id, t, i::BIGINT AS s_id, i::DOUBLE AS x FROM slots, range(10) a(i)")
def bau_st(spark, d):
    line = U.Grid((0.0,), (1.0,), (10,)).centres(spark, ("x",))
    return U.space_time(line, slots(spark, d), 10).select("bau_id", "t", "s_id", "x")


@query("bau_default_cellsize", "SELECT round((max(l_quantity) - min(l_quantity)) / 100, 6) AS cx, round((max(l_extendedprice) - min(l_extendedprice)) / 100, 6) AS cy FROM lineitem")
def bau_cellsize(spark, d):
    a, b = U.default_cellsize(U.extent(table(spark, d, "lineitem"), ("l_quantity", "l_extendedprice")))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "cx double, cy double")


@query(
    "bau_time_unit",
    """SELECT CASE WHEN s / 86400 < 40 THEN 'days' WHEN s / 604800 < 40 THEN 'weeks' WHEN s / 2629800 < 40 THEN 'months' ELSE 'years' END AS tunit
    FROM (SELECT epoch(max(l_shipdate)) - epoch(min(l_shipdate)) AS s FROM lineitem)""",
)
def bau_time_unit(spark, d):
    a, b = table(spark, d, "lineitem").agg(F.min(F.unix_timestamp("l_shipdate")), F.max(F.unix_timestamp("l_shipdate"))).first()
    return spark.createDataFrame([(U.default_time_unit(a, b),)], "tunit string")


@query(
    "bau_hex",
    f"""WITH {_PTS}, h AS (SELECT (i + 11 * j)::BIGINT AS bau_id, 5.0::DOUBLE * i + CASE WHEN j % 2 = 1 THEN 2.5 ELSE 0 END AS hx, j * (5 * sqrt(3.0::DOUBLE) / 2) AS hy FROM range(11) a(i), range(25) b(j)),
    q AS (SELECT obs_id, arg_min(bau_id, (x - hx) * (x - hx) + (y - hy) * (y - hy)) AS bau_id FROM pts JOIN h ON abs(x - hx) < 5 AND abs(y - hy) < 5 WHERE x < 47 AND y < 100 AND obs_id % 7 = 3 AND x % 5 <> 0 GROUP BY obs_id, x, y, z)
    SELECT bau_id, count(*) AS n FROM q GROUP BY 1""",
)
def bau_hex(spark, d):
    p = points(spark, d).filter("x < 47 AND y < 100 AND obs_id % 7 = 3 AND x % 5 <> 0")
    return p.groupBy(U.hex_key(F.col("x"), F.col("y"), (0.0, 50.0), (0.0, 105.0), 5.0).alias("bau_id")).agg(F.count(F.lit(1)).alias("n"))


@query("bau_hex_points")
def bau_hex_points(spark, d):
    """Every point; ``bau_hex`` is its comparison with SQL on some of them, away from ties and edges."""
    k = U.hex_key(F.col("x"), F.col("y"), (0.0, 50.0), (0.0, 105.0), 5.0)
    return points(spark, d).groupBy(k.alias("bau_id")).agg(F.count(F.lit(1)).alias("n"))


@query("bau_hull", None)
def bau_hull(spark, d):
    u, _ = U.auto_baus(points(spark, d), plane(), ("x", "y"), (5.0, 5.0))
    return u


# Change of support ------------------------------------------------------------------------------------------------


@query("bin_avg", f"WITH {_PTS} SELECT {_KEY} AS bau_id, round(avg(z), 6) AS z, round(avg(disc), 6) AS disc FROM pts WHERE {_IN} GROUP BY 1")
def bin_avg(spark, d):
    return S.bin_points(points(spark, d), key(), drop=["x", "y", "ts", "tag"], obs_id="obs_id").select("bau_id", R6("z").alias("z"), R6("disc").alias("disc"))


@query("bin_sum_vars", f"WITH {_PTS} SELECT {_KEY} AS bau_id, round(avg(z), 6) AS z, round(sum(disc), 6) AS disc, arg_min(tag, obs_id) AS tag FROM pts WHERE {_IN} GROUP BY 1")
def bin_sum(spark, d):
    b = S.bin_points(points(spark, d), key(), sums=["disc"], drop=["x", "y", "ts"], obs_id="obs_id")
    return b.select("bau_id", R6("z").alias("z"), R6("disc").alias("disc"), "tag")


@query("bin_noavg", f"WITH {_PTS} SELECT obs_id, {_KEY} AS bau_id, round(z, 6) AS z FROM pts WHERE {_IN}")
def bin_noavg(spark, d):
    return S.bin_points(points(spark, d), key(), average=False).select("obs_id", "bau_id", R6("z").alias("z"))


_EV = "ev AS (SELECT event_id AS obs_id, ts, user_id % 10 AS x, value FROM events)"


@query("bin_time_slots", f"WITH {_SLOTS}, {_EV} SELECT t, round(avg(value), 6) AS value, count(*) AS n FROM ev JOIN slots ON ts >= start AND ts < start + INTERVAL 1 DAY GROUP BY 1")
def bin_time(spark, d):
    s, condition = S.slot_key(F.col("ts"), slots(spark, d))
    e = table(spark, d, "events").select("ts", "value")
    return e.join(F.broadcast(s), F.expr(condition)).groupBy("t").agg(R6(F.avg("value")).alias("value"), F.count(F.lit(1)).alias("n"))


@query("bin_space_time", f"WITH {_SLOTS}, {_EV} SELECT ((t - 1) * 10 + x)::BIGINT AS bau_id, round(avg(value), 6) AS value FROM ev JOIN slots ON ts >= start AND ts < start + INTERVAL 1 DAY GROUP BY 1")
def bin_st(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("obs_id"), "ts", (F.col("user_id") % 10).cast("double").alias("x"), "value")
    g = U.Grid((0.0,), (1.0,), (10,))
    b = S.bin_space_time(e, g.key([F.col("x")]), "ts", slots(spark, d), 10, obs_id="obs_id")
    return b.select("bau_id", R6("value").alias("value"))


@query("incidence_points", f"WITH {_PTS} SELECT obs_id, {_KEY} AS bau_id, 1.0::DOUBLE AS x FROM pts WHERE {_IN}")
def incidence_points(spark, d):
    return S.incidence_points(S.bin_points(points(spark, d), key(), average=False))


@query("incidence_boxes", f"WITH {_AREAS}, {_UNITS}, {_HIT} SELECT obs_id, bau_id FROM hit")
def incidence_boxes(spark, d):
    return S.cells_in_areas(areas(spark, d), GRID)


_WEIGHTED = f"""{_AREAS}, {_UNITS}, {_HIT}, alone AS (
  SELECT obs_id, (floor((x0 + x1) / 2 / 5.0 + 0.5) + 11 * floor((y0 + y1) / 2 / 5.0 + 0.5))::BIGINT AS bau_id FROM areas WHERE obs_id NOT IN (SELECT obs_id FROM hit)),
 c AS (SELECT obs_id, bau_id, (1 + bau_id % 3)::DOUBLE AS x FROM (SELECT obs_id, bau_id FROM hit UNION ALL SELECT obs_id, bau_id FROM alone))"""


def weighted_units(spark):
    return units(spark).withColumn("wts", (1 + F.col("bau_id") % 3).cast("double"))


def weighted(spark, d):
    return S.incidence_areas(areas(spark, d), GRID, weighted_units(spark))


@query("poly_fallback", f"WITH {_WEIGHTED} SELECT obs_id, bau_id, x FROM c")
def poly_fallback(spark, d):
    return weighted(spark, d)


@query("normalised_weights", f"WITH {_WEIGHTED} SELECT obs_id, bau_id, round(x / sum(x) OVER (PARTITION BY obs_id), 6) AS x FROM c")
def normalised(spark, d):
    return S.normalise(weighted(spark, d)).select("obs_id", "bau_id", R6("x").alias("x"))


@query("aggregate_sum_vs_mean", f"WITH {_WEIGHTED} SELECT obs_id, round(sum(x * ux), 6) AS total, round(sum(x * ux) / sum(x), 6) AS mean FROM c JOIN units USING (bau_id) GROUP BY 1")
def sum_vs_mean(spark, d):
    c, u = weighted(spark, d), units(spark)
    total = S.apply_incidence(c, u, ["ux"]).select("obs_id", R6("ux").alias("total"))
    return total.join(S.apply_incidence(S.normalise(c), u, ["ux"]).select("obs_id", R6("ux").alias("mean")), "obs_id")


@query("poly_covariate_means", f"WITH {_AREAS}, {_UNITS}, {_HIT} SELECT a.obs_id, round(avg(ux), 6) AS ux, round(avg(uy), 6) AS uy FROM areas a LEFT JOIN hit h ON a.obs_id = h.obs_id GROUP BY 1")
def poly_means(spark, d):
    return S.area_means(areas(spark, d), GRID, units(spark), ["ux", "uy"]).select("obs_id", R6("ux").alias("ux"), R6("uy").alias("uy"))


@query("observed", f"WITH {_PTS}, {_UNITS}, {_BIN} SELECT bau_id FROM units SEMI JOIN bin USING (bau_id)")
def observed(spark, d):
    return S.observed(units(spark), S.bin_points(points(spark, d), key(), drop=["x", "y"], obs_id="obs_id")).select("bau_id")


@query("unobserved", f"WITH {_PTS}, {_UNITS}, {_BIN.replace('WHERE', 'WHERE x < 25 AND')} SELECT bau_id FROM units ANTI JOIN bin USING (bau_id)")
def unobserved(spark, d):
    return S.unobserved(units(spark), S.bin_points(points(spark, d).filter("x < 25"), key(), drop=["x", "y"], obs_id="obs_id")).select("bau_id")


@query("binned_data", f"WITH {_PTS}, {_UNITS}, {_BIN} SELECT bau_id, round(z, 6) AS z FROM units LEFT JOIN bin USING (bau_id)")
def binned_data(spark, d):
    b = S.bin_points(points(spark, d), key(), drop=["x", "y"], obs_id="obs_id")
    return S.binned_data(units(spark), b).select("bau_id", R6("z").alias("z"))


@query("bind_datasets", f"WITH {_PTS} SELECT dataset_id::INT AS dataset_id, count(*) AS n, round(sum(z), 4) AS z FROM (SELECT 0 AS dataset_id, z FROM pts WHERE x < 25 UNION ALL SELECT 1, z FROM pts WHERE x >= 25) GROUP BY 1")
def bind(spark, d):
    p = points(spark, d)
    b = S.bind_datasets(p.filter("x < 25"), p.filter("x >= 25"))
    return b.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z"))


# Polygons ---------------------------------------------------------------------------------------------------------


@query(
    "vertex_table",
    f"WITH {_AREAS} SELECT obs_id, ord::INT AS ord, CASE WHEN ord IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN ord IN (0, 1) THEN y0 ELSE y1 END AS y, (obs_id % 3)::BIGINT AS kind FROM areas, range(4) r(ord)",
)
def vertex_table(spark, d):
    a = areas(spark, d)
    return P.polygons_to_vertices(a, "obs_id", a.select("obs_id", (F.col("obs_id") % 3).alias("kind")))


@query("vertices_to_polygons", f"WITH {_AREAS} SELECT obs_id, 4 AS corners, round(x0, 6) AS xmin, round(y1, 6) AS ymax FROM areas")
def rings(spark, d):
    v = P.polygons_to_vertices(areas(spark, d), "obs_id")
    r = P.vertices_to_polygons(v, ["obs_id"], ("x", "y"), "ord")
    from .functions.geometry import ring_box

    return r.withColumns(ring_box(F.col("ring"))).select("obs_id", F.size("ring").alias("corners"), R6("xmin").alias("xmin"), R6("ymax").alias("ymax"))


@query("points_to_boxes", "SELECT c_custkey AS id, c_custkey::DOUBLE - 0.5 AS xmin, c_custkey::DOUBLE + 0.5 AS xmax FROM customer")
def points_to_boxes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    from .functions.geometry import ring_box

    return P.squares_around(c, ("x", "y"), 0.5).withColumns(ring_box(F.col("ring"))).select("id", "xmin", "xmax")


@query("interleave", "SELECT src, n_nationkey FROM (SELECT 'a' AS src, n_nationkey FROM nation UNION ALL SELECT 'b', n_nationkey FROM nation)")
def interleave(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    return P.interleave(n.select(F.lit("a").alias("src"), "n_nationkey"), n.select(F.lit("b").alias("src"), "n_nationkey"), order="n_nationkey")


# Distances --------------------------------------------------------------------------------------------------------

_LL = "ll AS (SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon, (c_custkey * 17 % 180 - 90)::DOUBLE AS lat, (c_custkey % 11)::DOUBLE AS t FROM customer)"
_GC = "6371 * acos(greatest(-1, least(1, cos(radians(lat)) * cos(radians(40)) * cos(radians(lon) - radians(10)) + sin(radians(lat)) * sin(radians(40)))))"


def lonlat(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return c.select(k.alias("id"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 180 - 90).cast("double").alias("lat"), (k % 11).cast("double").alias("t"))


@query("dist_euclid", f"WITH {_PTS} SELECT obs_id, round(sqrt((x - 25) * (x - 25) + (y - 50) * (y - 50)), 6) AS dist FROM pts")
def dist_euclid(spark, d):
    m = euclidean(2).between([F.col("x"), F.col("y")], [F.lit(25.0), F.lit(50.0)])
    return points(spark, d).select("obs_id", R6(m).alias("dist"))


@query("dist_aniso", f"WITH {_PTS} SELECT obs_id, round(sqrt(16 * (x - 25) * (x - 25) + (y - 50) * (y - 50)), 6) AS dist FROM pts")
def dist_aniso(spark, d):
    m = euclidean(2, (4.0, 1.0)).between([F.col("x"), F.col("y")], [F.lit(25.0), F.lit(50.0)])
    return points(spark, d).select("obs_id", R6(m).alias("dist"))


@query("dist_great_circle", f"WITH {_LL} SELECT id, round({_GC}, 4) AS dist FROM ll")
def dist_gc(spark, d):
    return lonlat(spark, d).select("id", F.round(great_circle(6371.0).between([F.col("lon"), F.col("lat")], [F.lit(10.0), F.lit(40.0)]), 4).alias("dist"))


@query("dist_great_circle_time", f"WITH {_LL} SELECT id, round(sqrt(g * g + (t - 3) * (t - 3)), 4) AS dist FROM (SELECT id, t, {_GC} AS g FROM ll)")
def dist_gct(spark, d):
    m = great_circle_time(6371.0).between([F.col("lon"), F.col("lat"), F.col("t")], [F.lit(10.0), F.lit(40.0), F.lit(3.0)])
    return lonlat(spark, d).select("id", F.round(m, 4).alias("dist"))


# Bases ------------------------------------------------------------------------------------------------------------

CENTRES = np.array([[10.0, 20.0], [25.0, 50.0], [40.0, 80.0]])
_CENTRES = "ctr AS (SELECT * FROM (VALUES (0, 10.0::DOUBLE, 20.0::DOUBLE), (1, 25.0, 50.0), (2, 40.0, 80.0)) v(k, cx, cy))"
_D = "sqrt((ux - cx) * (ux - cx) + (uy - cy) * (uy - cy))"
_KERNEL = {
    "bisquare": f"CASE WHEN {_D} < 30 THEN power(1 - power({_D} / 30, 2), 2) ELSE 0 END",
    "Gaussian": f"exp(-power({_D} / 30, 2) / 2)",
    "exp": f"exp(-{_D} / 30)",
    "Matern32": f"(1 + sqrt(3.0::DOUBLE) * {_D} / 30) * exp(-sqrt(3.0::DOUBLE) * {_D} / 30)",
}


def _kernel_query(kind: str) -> Query:
    def run(spark, d):
        b = B.local_basis(plane(), CENTRES, 30.0, kind)
        return B.evaluate_columns(units(spark), b, ("ux", "uy")).select("bau_id", F.posexplode("s").alias("k", "v")).select("bau_id", "k", R6("v").alias("v"))

    return run


for _kind in B.KINDS:
    query(f"basis_{_kind.lower()}", f"WITH {_UNITS}, {_CENTRES} SELECT bau_id, k::INT AS k, round({_KERNEL[_kind]}, 6) AS v FROM units, ctr")(_kernel_query(_kind))


@query("basis_batches", f"WITH {_UNITS}, {_CENTRES} SELECT bau_id, k::INT AS k, round({_KERNEL['bisquare']}, 6) AS v FROM units, ctr")
def basis_batches(spark, d):
    b = B.local_basis(plane(), CENTRES, 30.0, "bisquare")
    return B.evaluate(units(spark), b, ("ux", "uy")).select("bau_id", F.posexplode("s").alias("k", "v")).select("bau_id", "k", R6("v").alias("v"))


@query("basis_normalise", f"WITH {_UNITS}, {_CENTRES}, e AS (SELECT bau_id, k, {_KERNEL['Gaussian']} AS v FROM units, ctr) SELECT bau_id, k::INT AS k, round(v / sqrt(sum(v * v) OVER (PARTITION BY bau_id)), 6) AS v FROM e")
def basis_normalise(spark, d):
    b = B.local_basis(plane(), CENTRES, 30.0, "Gaussian")
    return B.evaluate(units(spark), b, ("ux", "uy"), normalise=True).select("bau_id", F.posexplode("s").alias("k", "v")).select("bau_id", "k", R6("v").alias("v"))


@query(
    "basis_tensor",
    f"WITH {_UNITS}, {_CENTRES}, tt AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 2.0)) v(kt, ct)) SELECT bau_id, (kt * 3 + k)::INT AS k, round({_KERNEL['bisquare']} * exp(-power(((bau_id % 4) - ct) / 1.5, 2) / 2), 6) AS v FROM units, ctr, tt",
)
def basis_tensor(spark, d):
    b = B.tensor(B.local_basis(plane(), CENTRES, 30.0), B.local_basis(real_line(), [0.0, 2.0], 1.5, "Gaussian"))
    u = units(spark).withColumn("t", (F.col("bau_id") % 4).cast("double"))
    return B.evaluate(u, b, ("ux", "uy", "t")).select("bau_id", F.posexplode("s").alias("k", "v")).select("bau_id", "k", R6("v").alias("v"))


@query("basis_area_average", f"WITH {_UNITS}, {_CENTRES}, q AS (SELECT bau_id, k, cx, cy, ux + (a - 2) AS ux, uy + (b - 2) AS uy FROM units, ctr, range(5) s(a), range(5) t(b)) SELECT bau_id, k::INT AS k, round(avg({_KERNEL['bisquare']}), 6) AS v FROM q GROUP BY 1, 2")
def basis_area(spark, d):
    b = B.local_basis(plane(), CENTRES, 30.0)
    return B.area_average(units(spark), b, (5.0, 5.0), ("ux", "uy")).select("bau_id", F.posexplode("s").alias("k", "v")).select("bau_id", "k", R6("v").alias("v"))


@query("basis_prune", f"WITH {_PTS}, {_CENTRES} SELECT k::BIGINT AS k, cx AS loc1, cy AS loc2 FROM (SELECT k, cx, cy, sum({_KERNEL['bisquare'].replace('ux', 'x').replace('uy', 'y')}) AS v, count(*) AS n FROM pts, ctr GROUP BY ALL) WHERE v >= 0.05 * n")
def basis_prune(spark, d):
    p, b = points(spark, d).select("x", "y"), B.local_basis(plane(), CENTRES, 30.0)
    n = p.count()
    kept = B.prune_on_data(b, p, ("x", "y"), 0.05 * n)
    return kept.frame(spark).join(b.frame(spark).select(F.col("k").alias("k0"), "loc1", "loc2"), ["loc1", "loc2"]).select(F.col("k0").alias("k"), "loc1", "loc2")


_AUTO = "a AS (SELECT 1 AS res, i, j, 1 AS n FROM range(1) x(i), range(2) y(j) UNION ALL SELECT 2, i, j, 3 FROM range(3) x(i), range(6) y(j))"


@query("basis_count_res", "SELECT * FROM (VALUES (1, 2::BIGINT), (2, 18::BIGINT), (3, 162::BIGINT)) v(res, n)")
def basis_count(spark, d):
    b = B.auto_basis(plane(), [(0.0, 50.0), (0.0, 100.0)], nres=3)
    return b.frame(spark).groupBy("res").agg(F.count(F.lit(1)).alias("n"))


@query(
    "basis_scale_nn",
    """WITH c AS (SELECT 25.0::DOUBLE * i AS x, 20.0::DOUBLE * j AS y FROM range(3) a(i), range(6) b(j))
    SELECT round(p.x, 6) AS loc1, round(p.y, 6) AS loc2, round(1.25 * 1.5 * min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 6) AS scale FROM c p, c q WHERE NOT (p.x = q.x AND p.y = q.y) GROUP BY p.x, p.y""",
)
def basis_scale(spark, d):
    b = B.auto_basis(plane(), [(0.0, 50.0), (0.0, 100.0)], nres=2)
    return b.frame(spark).filter("res = 2").select(R6("loc1").alias("loc1"), R6("loc2").alias("loc2"), R6("scale").alias("scale"))


@query("basis_buffer", "SELECT 2 AS res, 25.0::DOUBLE * (i - 1) AS loc1, 20.0::DOUBLE * (j - 2) AS loc2 FROM range(5) a(i), range(10) b(j)")
def basis_buffer(spark, d):
    b = B.add_buffer(B.remove(B.auto_basis(plane(), [(0.0, 50.0), (0.0, 100.0)], nres=2), [0, 1]), 0.5)
    return b.frame(spark).select("res", R6("loc1").alias("loc1"), R6("loc2").alias("loc2"))


@query("basis_combine_remove", "SELECT * FROM (VALUES (0::BIGINT, 1, 10.0::DOUBLE), (1::BIGINT, 1, 40.0::DOUBLE), (2::BIGINT, 2, 25.0::DOUBLE)) v(k, res, loc1)")
def basis_combine(spark, d):
    a, b = B.local_basis(plane(), CENTRES, 30.0), B.local_basis(plane(), CENTRES[1:2], 10.0)
    return B.combine([B.remove(a, [1]), b]).frame(spark).select("k", "res", "loc1")


# Variogram --------------------------------------------------------------------------------------------------------

_CELLS = f"{_PTS}, {_BIN}, cells AS (SELECT bau_id AS obs_id, (bau_id % 11) * 5.0::DOUBLE AS x, (bau_id // 11) * 5.0::DOUBLE AS y, z FROM bin)"
_VGM = f"""{_CELLS}, pr AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, abs(a.z - b.z) AS diff FROM cells a, cells b WHERE a.obs_id < b.obs_id),
 vg AS (SELECT greatest(ceil(dist / 2.6) - 1, 0)::BIGINT AS bin, count(*) AS np, avg(dist) AS dist, 0.5 * power(avg(sqrt(diff)), 4) / (0.457 + 0.494 / count(*) + 0.045 / (count(*) * count(*))) AS gamma
  FROM pr WHERE dist <= 26.0 GROUP BY 1)"""


def cells(spark, d):
    b = S.bin_points(points(spark, d), key(), units(spark), drop=["x", "y"], obs_id="obs_id")
    return b.select(F.col("bau_id").alias("obs_id"), F.col("ux").alias("x"), F.col("uy").alias("y"), "z")


@query("variogram_robust", f"WITH {_VGM} SELECT bin, np, round(dist, 6) AS dist, round(gamma, 6) AS gamma FROM vg")
def variogram(spark, d):
    v = V.robust_variogram(V.pairs_within(cells(spark, d), ("x", "y"), "z", 26.0), 26.0)
    return v.select("bin", "np", R6("dist").alias("dist"), R6("gamma").alias("gamma"))


@query("nugget_linear_fit", f"WITH {_VGM} SELECT round(regr_intercept(gamma, dist), 6) AS nugget FROM (SELECT * FROM vg ORDER BY bin LIMIT 4)")
def nugget(spark, d):
    v = V.robust_variogram(V.pairs_within(cells(spark, d), ("x", "y"), "z", 26.0), 26.0).orderBy("bin").limit(4)
    return v.agg(R6(F.regr_intercept("gamma", "dist")).alias("nugget"))


@query("nugget_points")
def nugget_points(spark, d):
    """The measurement error of all points, without the operator's thinning."""
    sd, how = V.measurement_error(points(spark, d), ("x", "y"), "z", sample=None)
    return spark.createDataFrame([(round(sd, 6), how)], "sd double, how string")


# Gaussian model ---------------------------------------------------------------------------------------------------

_S = "CASE WHEN sqrt((x - 25) * (x - 25) + (y - 50) * (y - 50)) < 60 THEN power(1 - ((x - 25) * (x - 25) + (y - 50) * (y - 50)) / 3600, 2) ELSE 0 END"
_R1 = f"""{_CELLS}, o AS (SELECT *, {_S} AS s FROM cells),
 a AS (SELECT count(*)::DOUBLE AS n, sum(s) AS s1, sum(s * s) AS s2, sum(z) AS z1, sum(s * z) AS sz, sum(z * z) AS z2, var_samp(z) AS k0, avg(z) AS a0, {VE}::DOUBLE AS ve, {VE / 4}::DOUBLE AS g0 FROM o),
 e AS (SELECT *, 1 / (s2 / (g0 + ve) + 1 / k0) AS se FROM a),
 e2 AS (SELECT *, se * (sz - a0 * s1) / (g0 + ve) AS mu FROM e),
 m AS (SELECT *, se + mu * mu AS k1, (z1 - mu * s1) / n AS a1 FROM e2),
 m2 AS (SELECT *, greatest(0, ((k1 * s2 - 2 * mu * (sz - a1 * s1) + z2 - 2 * a1 * z1 + n * a1 * a1) / n - ve)) AS g1 FROM m),
 f AS (SELECT *, 1 / (s2 / (g1 + ve) + 1 / k1) AS se1 FROM m2),
 f2 AS (SELECT *, se1 * (sz - a1 * s1) / (g1 + ve) AS mu1 FROM f)"""


def model_rows(spark, d):
    c = cells(spark, d).withColumnRenamed("obs_id", "bau_id")
    b = B.local_basis(plane(), [[25.0, 50.0]], 60.0)
    rows = B.evaluate_columns(c, b, ("x", "y")).withColumns({"x": F.array(F.lit(1.0)), "ve": F.lit(VE), "v": F.lit(1.0)})
    return rows.select("bau_id", "z", "ve", "v", "x", "s"), b


def fitted(spark, d):
    rows, b = model_rows(spark, d)
    st = stats.Statistics(rows, 1, 1)
    return rows, st, em.fit(st, b, 1, 1, n_em=1, k_type="unstructured")


def unit_rows(spark):
    b = B.local_basis(plane(), [[25.0, 50.0]], 60.0)
    return B.evaluate_columns(units(spark), b, ("ux", "uy")).select("bau_id", F.array(F.lit(1.0)).alias("x"), "s", F.col("fs").alias("v"))


@query("em_step_r1", f"WITH {_R1} SELECT round(a1, 6) AS alpha, round(k1, 6) AS k, round(g1, 6) AS sigma2fs, round(mu, 6) AS mu_eta, round(se, 6) AS s_eta FROM m2")
def em_step(spark, d):
    _, _, s = fitted(spark, d)
    return spark.createDataFrame(
        [tuple(round(float(v), 6) for v in (s.alpha[0], s.k[0, 0], s.sigma2, s.mu[0], s.s_eta[0, 0]))], "alpha double, k double, sigma2fs double, mu_eta double, s_eta double"
    )


@query(
    "loglik_r1",
    f"""WITH {_R1}, t AS (SELECT *, 1 / (g0 + ve) AS dd FROM a), q AS (SELECT *, s2 * dd + 1 / k0 AS ad, (sz - a0 * s1) * dd AS u, (z2 - 2 * a0 * z1 + n * a0 * a0) * dd AS ee FROM t)
    SELECT round(-0.5 * (n * ln(2 * pi()) + ln(ad) + ln(k0) - n * ln(dd) + ee - u * u / ad), 4) AS loglik FROM q""",
)
def loglik(spark, d):
    _, _, s = fitted(spark, d)
    return spark.createDataFrame([(round(float(s.loglik[0]), 4),)], "loglik double")


_PRED = f"{_R1}, {_UNITS}, ub AS (SELECT bau_id, {_S.replace('x -', 'ux -').replace('y -', 'uy -')} AS s FROM units)"


@query("predict_case1_r1", f"WITH {_PRED} SELECT bau_id, round(a1 + ub.s * mu, 6) AS mu, round(ub.s * ub.s * se, 6) AS var FROM ub, m2")
def case1(spark, d):
    rows, st, s = fitted(spark, d)
    p = Predictor(s, st, 1, 1, obs_fs=True)
    return p.units(unit_rows(spark), observation_weights(rows)).select("bau_id", R6("mu").alias("mu"), R6("var").alias("var"))


_CASE2 = """pr AS (SELECT ub.bau_id, ub.s, 1 / g1 AS q, coalesce(CASE WHEN bin.z IS NULL THEN NULL ELSE 1 / ve END, 0) AS w, coalesce(bin.z, 0) AS z, a1, mu1, se1 FROM f2, ub LEFT JOIN bin USING (bau_id)),
 pp AS (SELECT bau_id, s, se1, q / (w + q) AS sh, 1 / (w + q) AS own, a1 + s * mu1 + w / (w + q) * (z - a1 - s * mu1) AS mu FROM pr)"""


@query("predict_case2_r1", f"WITH {_PRED}, {_CASE2} SELECT bau_id, round(mu, 6) AS mu, round(sh * sh * s * s * se1 + own, 6) AS var FROM pp")
def case2(spark, d):
    rows, st, s = fitted(spark, d)
    return Predictor(s, st, 1, 1).units(unit_rows(spark), observation_weights(rows)).select("bau_id", R6("mu").alias("mu"), R6("var").alias("var"))


@query(
    "predict_areal_r1",
    f"""WITH {_PRED}, {_CASE2}, c AS (SELECT bau_id % 6 AS region_id, bau_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY bau_id % 6) AS x FROM units)
    SELECT region_id, round(sum(x * mu), 6) AS mu, round(power(sum(x * sh * s), 2) * max(se1) + sum(x * x * own), 6) AS var FROM c JOIN pp USING (bau_id) GROUP BY 1""",
)
def areal(spark, d):
    rows, st, s = fitted(spark, d)
    p = Predictor(s, st, 1, 1)
    u = p.units(unit_rows(spark), observation_weights(rows))
    c = S.normalise(units(spark).select((F.col("bau_id") % 6).alias("region_id"), "bau_id", F.lit(1.0).alias("x")), "region_id")
    return p.regions(u, c).select("region_id", R6("mu").alias("mu"), R6("var").alias("var"))


@query(
    "j_score_grid",
    f"""WITH {_R1}, g AS (SELECT i, 0.001::DOUBLE * power(4, i) AS g FROM range(6) t(i)), h AS (SELECT *, 1 / (g.g + m2.ve) AS dd FROM m2, g)
    SELECT i, round((0.5 * n * dd - 0.5 * dd * dd * (k1 * s2 - 2 * mu * (sz - a1 * s1) + z2 - 2 * a1 * z1 + n * a1 * a1)), 4) AS j FROM h""",
)
def j_grid(spark, d):
    _, st, s = fitted(spark, d)
    out = []
    for i in range(6):
        mo = st.at(0.001 * 4**i)
        a = em.alpha_at(mo, s.mu, 1, 1)
        out.append((i, round(float(em.score(mo, a, s.s_eta + np.outer(s.mu, s.mu), s.mu, 1, 1)), 4)))
    return spark.createDataFrame(out, "i long, j double")


@query("gram", f"WITH {_R1} SELECT round(s2, 6) AS ss, round(s1, 6) AS sx, round(sz, 6) AS sz, round(n, 6) AS xx, round(z1, 6) AS xz, round(z2, 6) AS zz FROM a")
def gram(spark, d):
    rows, _ = model_rows(spark, d)
    g = stats.cross_products(rows, [lambda ve, v: np.ones_like(ve)], 3)[0]
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (g[0, 0], g[0, 1], g[0, 2], g[1, 1], g[1, 2], g[2, 2]))], "ss double, sx double, sz double, xx double, xz double, zz double")


@query("ols_alpha", f"WITH {_CELLS} SELECT round(regr_intercept(z, x), 6) AS intercept, round(regr_slope(z, x), 6) AS slope FROM cells")
def ols(spark, d):
    c = cells(spark, d)
    f = Fm.parse("z ~ x")
    x = Fm.design(f, c).array()
    rows = c.select(x.alias("x"), F.array(F.lit(0.0)).alias("s"), "z", F.lit(1.0).alias("ve"), F.lit(1.0).alias("v"))
    g = stats.cross_products(rows, [lambda ve, v: np.ones_like(ve)], 4)[0]
    a = np.linalg.solve(g[1:3, 1:3], g[1:3, 3])
    return spark.createDataFrame([(round(float(a[0]), 6), round(float(a[1]), 6))], "intercept double, slope double")


@query(
    "gls_alpha",
    f"""WITH {_CELLS}, w AS (SELECT *, 1 / (0.1::DOUBLE + obs_id % 3) AS w FROM cells), t AS (SELECT sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS c, sum(w * z) AS e, sum(w * x * z) AS f FROM w)
    SELECT round((c * e - b * f) / (a * c - b * b), 6) AS intercept, round((a * f - b * e) / (a * c - b * b), 6) AS slope FROM t""",
)
def gls(spark, d):
    c = cells(spark, d)
    rows = c.select(Fm.design(Fm.parse("z ~ x"), c).array().alias("x"), F.array(F.lit(0.0)).alias("s"), "z", (0.1 + F.col("obs_id") % 3).alias("ve"), F.lit(1.0).alias("v"))
    st = stats.Statistics(rows, 1, 2)
    a = em.alpha_at(st.at(0.0), np.zeros(1), 1, 2)
    return spark.createDataFrame([(round(float(a[0]), 6), round(float(a[1]), 6))], "intercept double, slope double")


@query(
    "collapsed_observations",
    f"""WITH {_PTS}, o AS (SELECT {_KEY} AS bau_id, z, 0.5::DOUBLE + obs_id % 4 AS ve FROM pts WHERE {_IN})
    SELECT bau_id, round(sum(z / ve) / sum(1 / ve), 6) AS z, round(1 / sum(1 / ve), 8) AS ve, count(*) AS n FROM o GROUP BY 1""",
)
def collapsed(spark, d):
    o = S.bin_points(points(spark, d), key(), average=False).withColumn("ve", 0.5 + F.col("obs_id") % 4)
    return stats.collapse(o).select("bau_id", R6("z").alias("z"), F.round("ve", 8).alias("ve"), "n")


@query(
    "design_factor",
    "SELECT l_linestatus AS f, round(sum(c1), 6) AS c1, sum(c2) AS c2, sum(c3) AS c3 FROM (SELECT l_linestatus, sqrt(l_quantity) AS c1, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END AS c2, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS c3 FROM lineitem) GROUP BY 1",
)
def design_factor(spark, d):
    t = table(spark, d, "lineitem")
    x = Fm.design(Fm.parse("log(l_tax + 1) ~ sqrt(l_quantity) + l_returnflag"), t).array()
    e = t.select("l_linestatus", x.alias("x"))
    return e.groupBy(F.col("l_linestatus").alias("f")).agg(R6(F.sum(F.col("x")[1])).alias("c1"), F.sum(F.col("x")[2]).alias("c2"), F.sum(F.col("x")[3]).alias("c3"))


@query("random_effect_levels", "SELECT 0 AS grp, n_regionkey::VARCHAR AS level, count(*) AS n, sum(1.0::DOUBLE) AS x FROM nation GROUP BY 2")
def random_levels(spark, d):
    u = table(spark, d, "nation").select(F.col("n_nationkey").alias("bau_id"), "n_regionkey")
    r = Fm.random_levels(Fm.parse("z ~ 1 + (1 | n_regionkey)"), u)
    return r.groupBy("grp", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))


# Families ---------------------------------------------------------------------------------------------------------

_LINK_SQL = {
    "identity": ("m", "y"), "log": ("ln(m)", "exp(y)"), "sqrt": ("sqrt(m)", "y * y"), "inverse": ("1 / m", "1 / y"),
    "inverse-squared": ("1 / (m * m)", "1 / sqrt(y)"), "logit": ("ln(m / (1 - m))", "1 / (1 + exp(-y))"), "cloglog": ("ln(-ln(1 - m))", "1 - exp(-exp(y))"),
}


def _link_query(name: str) -> Query:
    def run(spark, d):
        t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") + 0.5) / 60).alias("m"))
        return t.select("id", R6(families.link(name, F.col("m"))).alias("y"))

    return run


def _inverse_query(name: str) -> Query:
    def run(spark, d):
        t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") + 0.5) / 20).alias("y"))
        return t.select("id", R6(families.inverse_link(name, F.col("y"))).alias("m"))

    return run


for _name, (_f, _g) in _LINK_SQL.items():
    _id = _name.replace("-", "_")
    query(f"link_{_id}", f"SELECT id, round({_f}, 6) AS y FROM (SELECT p_partkey AS id, (p_size + 0.5::DOUBLE) / 60 AS m FROM part)")(_link_query(_name))
    query(f"inverse_link_{_id}", f"SELECT id, round({_g}, 6) AS m FROM (SELECT p_partkey AS id, (p_size + 0.5::DOUBLE) / 20 AS y FROM part)")(_inverse_query(_name))

_T = "(1 / (1 + abs(y) * 0.2316419::DOUBLE))"
query(
    "inverse_link_probit",
    f"""SELECT id, round(1 - exp(y * y / -2) / sqrt(2 * pi()) * ({_T} * (0.319381530::DOUBLE + {_T} * (-0.356563782::DOUBLE + {_T} * (1.781477937::DOUBLE + {_T} * (-1.821255978::DOUBLE + {_T} * 1.330274429::DOUBLE))))), 6) AS m
    FROM (SELECT p_partkey AS id, (p_size + 0.5::DOUBLE) / 20 AS y FROM part)""",
)(_inverse_query("probit"))

_DENSITY_SQL = {
    "gaussian": "(z * m - m * m / 2) / 0.7::DOUBLE", "poisson": "z * ln(m) - m", "gamma": "(z / m + ln(m)) / -0.7::DOUBLE",
    "inverse-gaussian": "(z / (2 * m * m) - 1 / m) / -0.7::DOUBLE", "binomial": "z * ln(m / (k - m)) + k * ln((k - m) / k)", "negative-binomial": "z * ln(m / (m + k)) + k * ln(k / (m + k))",
}


def _density_query(name: str) -> Query:
    def run(spark, d):
        t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).cast("double").alias("z"), ((F.col("p_size") + 0.5) / 10).alias("m"), F.lit(9.0).alias("k"))
        return t.select("id", R6(families.log_density(name, F.col("z"), F.col("m"), 0.7, F.col("k"))).alias("ll"))

    return run


for _name, _f in _DENSITY_SQL.items():
    query(f"expfam_logdens_{_name.replace('-', '_')}", f"SELECT id, round({_f}, 6) AS ll FROM (SELECT p_partkey AS id, (p_partkey % 7)::DOUBLE AS z, (p_size + 0.5::DOUBLE) / 10 AS m, 9.0::DOUBLE AS k FROM part)")(_density_query(_name))


@query("start_values", "SELECT p_partkey AS id, round(ln(CASE WHEN p_partkey % 7 = 0 THEN 0.1::DOUBLE ELSE p_partkey % 7 END), 6) AS y FROM part")
def start_values(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), R6(families.start_value("poisson", "log", (F.col("p_partkey") % 7).cast("double"))).alias("y"))


_SPREAD = f"WITH {_WEIGHTED}, n AS (SELECT obs_id, bau_id, (obs_id % 9 + 1) * x / sum(x) OVER (PARTITION BY obs_id) AS m FROM c)"


def spread(spark, d):
    c = S.normalise(weighted(spark, d))
    return c.select("obs_id", "bau_id", ((F.col("obs_id") % 9 + 1) * F.col("x")).alias("m"))


@query("mu_backproject", f"{_SPREAD} SELECT bau_id, round(avg(m), 6) AS mean, round(min(m), 6) AS least FROM n GROUP BY 1")
def backproject(spark, d):
    return spread(spark, d).groupBy("bau_id").agg(R6(F.avg("m")).alias("mean"), R6(F.min("m")).alias("least"))


@query("k_bau_sum", f"WITH {_PTS} SELECT {_KEY} AS bau_id, sum(tag_n) AS k, round(avg(z), 6) AS z FROM (SELECT *, (obs_id % 5)::DOUBLE AS tag_n FROM pts) WHERE {_IN} GROUP BY 1")
def k_bau(spark, d):
    p = points(spark, d).withColumn("k", (F.col("obs_id") % 5).cast("double"))
    return S.bin_points(p, key(), sums=["k"], drop=["x", "y", "ts", "tag", "disc"], obs_id="obs_id").select("bau_id", "k", R6("z").alias("z"))


# Lattices ---------------------------------------------------------------------------------------------------------

_LATTICE = "p AS (SELECT (i + 4 * j)::BIGINT AS k, i, j FROM range(4) a(i), range(3) b(j)), nb AS (SELECT p.k AS i, q.k AS j FROM p, p q WHERE abs(p.i - q.i) + abs(p.j - q.j) = 1)"
_LOC = np.array([(i, j) for j in range(3) for i in range(4)], float)


@query("neighbour_matrix", f"WITH {_LATTICE} SELECT i, j, 1.0::DOUBLE AS x FROM nb")
def neighbour_matrix(spark, d):
    return spark.createDataFrame(L.triplets(L.neighbours(_LOC)), "i long, j long, x double")


@query("precision_triplets", f"WITH {_LATTICE} SELECT i, j, -2.0::DOUBLE AS x FROM nb UNION ALL SELECT i, i, 2.0::DOUBLE * (count(*) + 0.5) FROM nb GROUP BY i")
def precision_triplets(spark, d):
    return spark.createDataFrame(L.triplets(L.precision(L.neighbours(_LOC), 0.5, 2.0)), "i long, j long, x double")


@query("taper_weights", f"WITH {_LATTICE}, dd AS (SELECT p.k AS i, q.k AS j, sqrt((p.i - q.i) * (p.i - q.i) + (p.j - q.j) * (p.j - q.j)) AS d FROM p, p q) SELECT i, j, round((1 + d / 6) * power(1 - d / 3, 2), 6) AS x FROM dd WHERE d < 3")
def taper_weights(spark, d):
    dist = euclidean(2).pairs(_LOC)
    t = L.triplets(np.round(L.spherical_taper(dist, L.taper_range(dist, 3.0)), 6))
    return spark.createDataFrame(t, "i long, j long, x double")


# Summaries --------------------------------------------------------------------------------------------------------


@query("percentiles", "SELECT n_nationkey AS k, round(quantile_cont(c_acctbal, 0.05), 6) AS p5, round(quantile_cont(c_acctbal, 0.95), 6) AS p95 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def percentiles(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.expr("round(percentile(c_acctbal, 0.05), 6)").alias("p5"), F.expr("round(percentile(c_acctbal, 0.95), 6)").alias("p95"))
    return c


@query("interval90", "SELECT c_nationkey AS k, round(quantile_cont(c_acctbal, 0.95) - quantile_cont(c_acctbal, 0.05), 6) AS interval90_Y FROM customer GROUP BY 1")
def interval90(spark, d):
    from .plans.predict import interval90 as add

    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.expr("percentile(c_acctbal, 0.05)").alias("Y_percentile_5"), F.expr("percentile(c_acctbal, 0.95)").alias("Y_percentile_95"))
    return add(c, "Y").select("k", R6("interval90_Y").alias("interval90_Y"))


@query("rmspe", "SELECT c_nationkey AS k, round(stddev_samp(c_acctbal), 6) AS rmspe FROM customer GROUP BY 1")
def rmspe(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(R6(F.stddev_samp("c_acctbal")).alias("rmspe"))


@query("residuals", f"WITH {_PRED}, {_CASE2} SELECT bau_id, round(pp.mu - bin.z, 6) AS residual FROM pp JOIN bin USING (bau_id)")
def residuals(spark, d):
    rows, st, s = fitted(spark, d)
    p = Predictor(s, st, 1, 1).units(unit_rows(spark), observation_weights(rows))
    return p.join(rows.select("bau_id", "z"), "bau_id").select("bau_id", R6(F.col("mu") - F.col("z")).alias("residual"))


# Models without SQL -----------------------------------------------------------------------------------------------


@query("em_fit")
def em_fit(spark, d):
    from .plans.model import fit_points

    m = fit_points("z ~ 1", points(spark, d), ("x", "y"), cellsize=(5.0, 5.0), nres=2, n_em=5, std=0.2)
    return m.predict()


@query("laplace_poisson")
def laplace_poisson(spark, d):
    from .plans.model import fit_points

    p = points(spark, d).groupBy(key().alias("k")).agg(F.count(F.lit(1)).cast("double").alias("z"), F.first("x").alias("x"), F.first("y").alias("y")).withColumn("obs_id", F.col("k"))
    m = fit_points("z ~ 1", p.drop("k"), ("x", "y"), cellsize=(5.0, 5.0), nres=1, regular=2, response="poisson", link="log", max_outer=4)
    return m.predict(nsim=50)


@query("mc_predict")
def mc_predict(spark, d):
    return laplace_poisson(spark, d).select("bau_id", "p_mu", "RMSPE_mu", "mu_percentile_5", "mu_percentile_95")


@query("simulate")
def simulate(spark, d):
    from .plans.model import fit_points

    m = fit_points("z ~ 1", points(spark, d), ("x", "y"), cellsize=(5.0, 5.0), nres=1, n_em=3, std=0.2)
    return m.simulate(20).select("obs_id", F.posexplode("samples").alias("draw", "z"))


@query("space_time_fit")
def space_time_fit(spark, d):
    from .plans.model import fit_space_time

    # Values come in hundredths: one that was rounded to 0 stands for half of that, as its logarithm would be missing.
    z = F.log(F.when(F.col("value") == 0, 0.005).otherwise(F.col("value")))
    e = table(spark, d, "events").select(F.col("event_id").alias("obs_id"), (F.col("user_id") % 10).cast("double").alias("x"), (F.col("user_id") % 7).cast("double").alias("y"), "ts", z.alias("z"))
    return fit_space_time("z ~ 1", e, ("x", "y"), "ts", cellsize=(1.0, 1.0), nres=2, n_time=3, std=0.5, n_em=3).predict()


@query("areal_fit")
def areal_fit(spark, d):
    from .plans.model import fit_areas

    u = GRID.centres(spark, ("x", "y")).withColumns({"fs": F.lit(1.0), "wts": F.lit(1.0)})
    a = areas(spark, d).withColumns({"z": F.sin(F.col("obs_id") / 5.0), "std": F.lit(0.1)})
    b = B.auto_basis(plane(), [(0.0, 50.0), (0.0, 105.0)], nres=2)
    return fit_areas("z ~ 1", a, u, GRID, b, ("x", "y"), n_em=4, known_sigma2=0.0).predict()


@query("global_grid", "SELECT r.res::INT AS res, (10 * power(3, r.res) + 2)::BIGINT AS n FROM range(6) r(res)")
def global_grid(spark, d):
    from .sources.dggs import isea3h_centres

    return spark.createDataFrame([(k, len(isea3h_centres(k))) for k in range(6)], "res int, n long")


@query("support_circles", "SELECT k::BIGINT AS k, 1 AS res, ord::INT AS ord, round(cx + 30 * cos(2 * pi() * ord / 48), 6) AS x, round(cy + 30 * sin(2 * pi() * ord / 48), 6) AS y FROM (VALUES (0, 10.0::DOUBLE, 20.0::DOUBLE), (1, 25.0, 50.0), (2, 40.0, 80.0)) v(k, cx, cy), range(48) r(ord)")
def support_circles(spark, d):
    from .plans.frames import support_circles as circles

    return circles(spark, B.local_basis(plane(), CENTRES, 30.0)).withColumns({"x": R6("x"), "y": R6("y")})


@query("long_frame", "SELECT c_custkey, 'acctbal' AS quantity, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer")
def long_frame(spark, d):
    from .plans.frames import long_frame as long

    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))
    return long(c, "c_custkey", ["acctbal", "nation"])


@query("outline_shift", "SELECT g, CASE WHEN max(lon) OVER (PARTITION BY g) > 180 THEN lon - 360 ELSE lon END AS lon FROM (SELECT n_regionkey AS g, (n_nationkey * 17 % 230)::DOUBLE AS lon FROM nation)")
def outline_shift(spark, d):
    from .plans.frames import outline_without_jumps

    v = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), (F.col("n_nationkey") * 17 % 230).cast("double").alias("lon"))
    return outline_without_jumps(v, "g", "lon")


@query("dateline_split", "SELECT s_suppkey::VARCHAR || side AS id, CASE WHEN side = 'e' THEN 179.999::DOUBLE ELSE -179.999 END AS edge FROM supplier, (VALUES ('e'), ('w')) v(side)")
def dateline_split(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    p = P.boxes(s, F.lit(175.0), F.lit(-175.0), F.lit(-5.0), F.lit(5.0))
    e = P.split_dateline(p)
    return e.select("id", F.expr("CASE WHEN lon > 0 THEN array_max(transform(ring, p -> p.x)) ELSE array_min(transform(ring, p -> p.x)) END").alias("edge"))
