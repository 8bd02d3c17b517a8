"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, html, neardup, packing, pieces, quality, sharding, substring, topk, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_kd_sharding": sharding.op2_kd_sharding,
    "op3_minhash_neardup": neardup.op3_minhash_neardup,
    "op4_url_rules": urls.op4_url_rules,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_packing": packing.op8_packing,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_neardup": neardup.SQL,
    "op5_substring_dedup": substring.SQL,
    "op6_quality_rules": quality.SQL,
    "op7_chat_formatting": chat.SQL,
    "op9_exact_topk": topk.SQL,
}
