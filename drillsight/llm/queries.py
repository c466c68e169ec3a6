"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from drillsight.llm import (
    ann,
    bpe,
    chat_format,
    fill_middle,
    html_extract,
    language_id,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    spelling,
    sql,
    suffix_dedup,
    toxicity,
)

from drillsight.llm.common import importable

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.query(spark, folder, public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.query(spark, folder, public_tokenizers.path("word_bpe_49k.json"))


_QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_ann": ann.query,
    "op4_quality_rules": quality_rules.query,
    "op5_chat_format": chat_format.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_toxicity": toxicity.query,
    "op8_language_id": language_id.query,
    "op9_simhash": simhash.query,
    "op10_packing": op10_packing,
    "op11_html_extract": html_extract.query,
    "op12_spelling": spelling.query,
    "op13_fill_middle": fill_middle.query,
}


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return query(spark, folder)

    return run


def all_queries() -> dict[str, Query]:
    """Every query of this folder by name."""
    return {name: _ready(query) for name, query in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    """SQL by the name of its query."""
    return {
        "op4_quality_rules": sql.QUALITY_RULES,
        "op5_chat_format": sql.CHAT_FORMAT,
        "op11_html_extract": sql.HTML_EXTRACT,
        "op12_spelling": sql.SPELLING,
        "op13_fill_middle": sql.FILL_MIDDLE,
    }
