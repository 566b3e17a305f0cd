"""Connected components of a graph in a table, by alternating large-star and small-star steps.

Each step is joins and minimum aggregates; labels and links stay in tables written to the shared folder. A hub's
links are spread by the map-side minimum and by adaptive skew joins; no neighbourhood is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large star: neighbours above u go to the least of u and its neighbours; small star: those below."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node with a link; ``edges`` has (u, v) of a sortable type without nulls; root is the least node."""
    now = stash(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    stamp = None
    for _ in range(max_rounds):
        now = stash(_star(stash(_star(now, True), "links"), False), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == stamp:
            break
        stamp = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
