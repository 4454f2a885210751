"""Registered queries over a folder of tables, each with the SQL of the same result where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import allele_queries, bin_queries, set_queries, signal_queries, stat_queries, table_queries
from .base import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}


__all__ = ["allele_queries", "bin_queries", "oracle_sql", "queries", "set_queries", "signal_queries", "stat_queries", "table_queries"]
