"""All queries of the library's own operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, answers, evaluation, governance, memory

_ALL = governance.PLANS | analytics.PLANS | evaluation.PLANS | memory.PLANS | answers.PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _ALL.items() if sql}
