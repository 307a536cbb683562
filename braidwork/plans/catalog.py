"""All queries of the library's own operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidwork.plans import alignment, conservation, phylogeny, sequences, statistics, structure

_PLANS = (structure, phylogeny, statistics, sequences, conservation, alignment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in _PLANS for name, text in plan.SQL.items()}
