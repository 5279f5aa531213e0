"""All queries of the core, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import code_graph, contexts, core_problems, retrieval, search

MODULES = (core_problems, retrieval, code_graph, contexts, search)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(spark, sf_dir)
