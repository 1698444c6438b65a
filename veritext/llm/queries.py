"""Queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritext.llm import decontaminate, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, quality_crf, substring_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_minhash": near_dedup.op5_minhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_crf": quality_crf.op8_quality_crf,
    "op9_recompression": substring_dedup.op9_recompression,
    "op10_html_suffix": html_extract.op10_html_suffix,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_minhash": near_dedup.SQL,
    "op9_recompression": substring_dedup.SQL,
}
