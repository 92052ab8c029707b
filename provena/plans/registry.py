"""Names of all queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provena.plans import advisories, code_tiers, evidence, knowledge, libraries, provenance

FLAGSHIP = "tree_verdict"
MODULES = (provenance, libraries, advisories, knowledge, evidence, code_tiers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
