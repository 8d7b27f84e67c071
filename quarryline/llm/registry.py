"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that defines it.
QUERIES = {
    "op1_language_id": "language",
    "op2_imatch_fingerprints": "imatch",
    "op3_decontamination": "decontaminate",
    "op4_quality": "quality",
    "op5_simhash_near_dedup": "simhash",
    "op6_suffix_array_dedup": "suffixes",
    "op7_token_counts": "tokens",
    "op8_packing": "packing",
    "op9_toxicity": "toxicity",
    "op10_warc": "warc",
    "op11_phrase_collocations": "phrases",
    "op12_exact_dedup": "exact",
    "op13_importance_resampling": "resampling",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in QUERIES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
