"""clauseflow: contract-clause analytics as composable Spark DataFrame jobs.

Layout
------
functions/  Column-level building blocks (lexicons, text normalisation, predicates)
sources/    readers, admission split, derived fixtures, sinks
operators/  DataFrame -> DataFrame operators (segment, classify, risk, dedup, ...)
plans/      composite pipelines and the driver query registry
streaming/  incremental (Structured Streaming) contract scoring
"""

from clauseflow.session import get_spark  # noqa: F401

__all__ = ["get_spark"]
