"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a character class body and as text.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="fieldspark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(spark: SparkSession, most: int = 1 << 22) -> None:
    """Bound the bytes that Arrow hands to Python at once, as texts can be long; the rows in a batch stay as they are set.

    Only a bound on memory: it is never raised, and no result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    # A value with another unit is the user's own.
    if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def boxed(docs: DataFrame) -> DataFrame:
    """The rows as one column ``row``, so that no name of theirs clashes with a helper column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def words_array(text: Column) -> Column:
    """Words of a text: an array without empty strings; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{WS_CLASS}]+")
    )


def word_count(text: Column) -> Column:
    """Number of words, without an array: starts of non-space runs."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS_CLASS}]+")).cast("long")


def unsigned_fraction(h: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def with_running_total(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str, before: str = "_before"
) -> DataFrame:
    """Exclusive running sum of ``value`` inside ``group`` in the order (bucket, order).

    ``bucket`` must rise with ``order``. No task holds more than one bucket: rows are summed inside
    each bucket, bucket totals are summed inside each group, and the two are joined.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    totals = totals.select(*keys, F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias(before))
    rows = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(totals, keys).withColumn(out, F.col("_inner") + F.col(before)).drop("_inner", before)
