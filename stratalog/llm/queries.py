"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm.langid import op6_language_id
from stratalog.llm.media import op4_media_columns
from stratalog.llm.mixing import op8_source_mixing
from stratalog.llm.near_dup import op1_near_dup
from stratalog.llm.pieces import op10_sentencepiece
from stratalog.llm.quality import ORACLE as QUALITY_SQL
from stratalog.llm.quality import op9_quality_rules
from stratalog.llm.secrets import op3_secret_scans
from stratalog.llm.substring_dedup import ORACLE as REPEAT_SQL
from stratalog.llm.substring_dedup import op5_substring_dedup
from stratalog.llm.token_output import op7_token_output
from stratalog.llm.urls import ORACLE as URL_SQL
from stratalog.llm.urls import op2_url_filters


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_url_filters": op2_url_filters,
    "op3_secret_scans": op3_secret_scans,
    "op4_media_columns": op4_media_columns,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_output": op7_token_output,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": URL_SQL,
    "op5_substring_dedup": REPEAT_SQL,
    "op9_quality_rules": QUALITY_SQL,
}
