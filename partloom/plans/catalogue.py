"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partloom.plans import desk, extras, problems, problems_sql, quality, records, structure

_PARTS = [(problems.QUERIES, problems_sql.ORACLES), (quality.QUERIES, quality.ORACLES), (structure.QUERIES, structure.ORACLES), (records.QUERIES, records.ORACLES), (desk.QUERIES, desk.ORACLES), (extras.QUERIES, extras.ORACLES)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for q, _ in _PARTS for k, v in q.items()}


def oracles() -> dict[str, str]:
    return {k: v for _, o in _PARTS for k, v in o.items()}
