"""All registered queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausewright.plans import change_queries, structure_queries, text_queries

_PARTS = (text_queries, structure_queries, change_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
