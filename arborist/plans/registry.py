"""All registered queries of the library and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gate_queries, module_queries, report_queries, rule_queries, source_queries, walk_queries

MODULES = (rule_queries, report_queries, walk_queries, source_queries, module_queries, gate_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
