"""Data behind plots: long frames of quantities, circles of basis supports, outlines without dateline jumps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.basis import Basis


def long_frame(predicted: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, quantity, value): one row for each unit and quantity."""
    pairs = F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).cast("double").alias("value")) for c in columns])
    return predicted.select(id_col, F.explode(pairs).alias("q")).select(id_col, "q.quantity", "q.value")


def support_circles(spark: SparkSession, basis: Basis, corners: int = 48) -> DataFrame:
    """(k, res, ord, x, y): circles of radius scale around centres on a plane; end points on a line."""
    rows = []
    for k, (c, s, r) in enumerate(zip(basis.loc, basis.scale, basis.res, strict=True)):
        if basis.loc.shape[1] == 1:
            rows += [(k, int(r), 0, float(c[0] - s), 0.0), (k, int(r), 1, float(c[0] + s), 0.0)]
        else:
            a = np.linspace(0, 2 * np.pi, corners, endpoint=False)
            rows += [(k, int(r), i, float(c[0] + s * np.cos(t)), float(c[1] + s * np.sin(t))) for i, t in enumerate(a)]
    return spark.createDataFrame(rows, "k long, res int, ord int, x double, y double")


def outline_without_jumps(vertices: DataFrame, group: str = "group", lon: str = "lon") -> DataFrame:
    """Groups that pass the dateline are shifted by 360 degrees where they lie beyond it, so that lines do not cross the map."""
    span = vertices.groupBy(group).agg(F.max(lon).alias("_hi"), F.min(lon).alias("_lo"))
    v = vertices.join(span, group)
    shift = F.when(F.col("_hi") > 180, -360.0).when(F.col("_lo") < -180, 360.0).otherwise(0.0)
    return v.withColumn(lon, F.col(lon) + shift).drop("_hi", "_lo")
