"""The training-data pipeline: quality rules, near-duplicate removal, decontamination, mixing, token files.

Every stage works on all that the one before has kept, written as Parquet and read again. A table with no rows passes
through all stages; columns beyond those of ``documents`` are kept until the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import stash, table
from fieldspark.llm.decontam import stage_decontaminate
from fieldspark.llm.jaccard import stage_jaccard
from fieldspark.llm.mixing import stage_mix
from fieldspark.llm.quality import stage_quality
from fieldspark.llm.token_files import stage_encode

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stage_quality),
    ("jaccard_dedup", stage_jaccard),
    ("decontamination", stage_decontaminate),
    ("source_mix", stage_mix),
    ("token_files", stage_encode),
]

#: Token ids come from a tokenizer's merges, which SQL cannot express; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
