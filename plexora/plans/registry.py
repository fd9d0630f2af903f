"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plexora.plans import catalog, coverage, problems, problems_sql

FLAGSHIP = "agg_group_measures"

# the queries of coverage are registered beside those of catalog
assert coverage.q is catalog.q
_MODULES = [(catalog.QUERIES, catalog.SQL), (problems.QUERIES, problems_sql.SQL)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for q, _ in _MODULES for k, v in q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for _, s in _MODULES for k, v in s.items()}
