"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, html_extract, jaccard, mixing, quality, sharding, token_counts, token_files, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": decontam.op1_decontaminate,
        "op2_preference_format": chat.op2_preference_format,
        "op3_source_mix": mixing.op3_source_mix,
        "op4_html_main_text": html_extract.op4_html_main_text,
        "op5_token_files": token_files.op5_token_files,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_warc_index": warc.op7_warc_index,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_jaccard_components": jaccard.op9_jaccard_components,
        "op10_uniform_shards": sharding.op10_uniform_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_preference_format": chat.ORACLE_SQL,
        "op3_source_mix": mixing.ORACLE_SQL,
        "op6_quality_rules": quality.ORACLE_SQL,
        "op7_warc_index": warc.ORACLE_SQL,
    }
