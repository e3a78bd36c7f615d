"""Queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES = {
    "op2_suffix_dedup": "suffix_dedup",
    "op5_line_dedup": "line_dedup",
    "op9_near_duplicates": "near_duplicates",
    "op7_decontamination": "decontaminate",
    "op10_token_counts": "token_counts",
    "op4_lm_score": "likelihood",
    "op1_toxicity": "toxicity",
    "op3_secret_scan": "secrets",
    "op6_sentencepiece_codec": "pieces",
    "op8_quality_rules": "quality",
}


def _module(name: str):
    return import_module(f"basalt.llm.{QUERIES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: getattr(_module(name), name) for name in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).ORACLE for name in QUERIES if hasattr(_module(name), "ORACLE")}
