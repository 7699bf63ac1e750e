"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import budget_plans, format_plans, more_plans, quality_plans, rule_plans, stream_plans, sync_plans, text_plans

MODULES = (quality_plans, text_plans, sync_plans, budget_plans, format_plans, more_plans, rule_plans, stream_plans)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = entry
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
