"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.plans import cases, criteria, finals, folders, marks, reports, structure, texts, verification

GROUPS = (marks, reports, texts, structure, finals, criteria, folders, verification, cases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for group in GROUPS for name, f in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
