"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module and query of each operator.
OPERATORS = {
    "op1_benchmark_decontamination": "decontaminate",
    "op2_html_extraction": "html_text",
    "op3_best_fit_packing": "packing",
    "op4_toxicity": "toxicity",
    "op5_importance_resampling": "resampling",
    "op6_personal_data": "personal_data",
    "op7_adaptive_quality_rules": "quality_rules",
    "op8_suffix_tree_lm_scoring": "suffix_tree_lm",
    "op10_chat_snapshot_collapse": "chat",
    "op9_simhash_near_dup": "simhash",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
