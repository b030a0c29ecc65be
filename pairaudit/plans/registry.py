"""Every core query by name."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from pairaudit.plans import core_problems, curation_queries, membership_queries, model_queries, scoring_queries, source_queries

MODULES: list[ModuleType] = [core_problems, scoring_queries, membership_queries, curation_queries, model_queries, source_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


flagship = scoring_queries.equal_block
