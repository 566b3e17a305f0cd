"""Session helper, options and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Options:
    """progress: report stages; verbose: print details. Parallelism is Spark's own."""

    progress: bool = True
    verbose: bool = False

    def set(self, name: str, value: bool) -> None:
        if name not in ("progress", "verbose"):
            raise ValueError(f"no option {name!r}")
        if not isinstance(value, bool):
            raise TypeError(f"{name} is true or false")
        setattr(self, name, value)

    def get(self, name: str) -> bool:
        if name not in ("progress", "verbose"):
            raise ValueError(f"no option {name!r}")
        return getattr(self, name)


options = Options()


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder of ``spark.checkpoint.dir`` (a temporary one where unset) and read back: lineage ends there."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="fieldspark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
