"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> (module, function, name of its SQL or None)
_TABLE = {
    "op1_packed_ids": ("packing", "op1", None),
    "op2_fuzzy_lines": ("fuzzy_lines", "op2", None),
    "op3_license_scan": ("license_scan", "op3", "OP3_SQL"),
    "op4_vector_links": ("vector_links", "op4", "OP4_SQL"),
    "op5_benchmark_leaks": ("decontaminate", "op5", "OP5_SQL"),
    "op6_secret_scan": ("secret_scan", "op6", "OP6_SQL"),
    "op7_warc_round_trip": ("warc", "op7", "OP7_SQL"),
    "op8_quality": ("quality", "op8", None),
    "op9_weighted_fair_mix": ("mixing", "op9", "OP9_SQL"),
    "op10_jaccard_join": ("jaccard_join", "op10", "OP10_SQL"),
    "op11_spelling_variants": ("spelling", "op11", None),
    "op12_collocations": ("collocations", "op12", "OP12_SQL"),
    "op13_personal_data": ("personal_data", "op13", "OP13_SQL"),
}


def _lazy(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"clauseflow.llm.{module}"), function)(spark, sf_dir)
    return run


QUERIES = {name: _lazy(module, function) for name, (module, function, _) in _TABLE.items()}
ORACLE = {name: getattr(import_module(f"clauseflow.llm.{module}"), sql)
          for name, (module, _, sql) in _TABLE.items()
          if sql and getattr(import_module(f"clauseflow.llm.{module}"), sql)}
