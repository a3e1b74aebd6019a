"""Sorting, limits and project figures of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..policy import SORT_KEYS

LOCATION = ("file", "name", "line")


def sort_metric(key: str | None) -> tuple[str, bool]:
    """The metric of a sort key, and whether the key is known; an unknown one sorts by location."""
    if key is None:
        return "location", True
    return (SORT_KEYS[key], True) if key in SORT_KEYS else ("location", False)


def sorted_report(functions: DataFrame, key: str | None, columns: dict[str, str], limit: int | None = None) -> DataFrame:
    """By the key's column, descending, and then by location; at most ``limit`` rows (0 gives none)."""
    metric, _ = sort_metric(key)
    order = [F.col(c) for c in LOCATION]
    if metric != "location":
        order.insert(0, F.desc(columns[metric]))
    out = functions.orderBy(*order)
    return out if limit is None else out.limit(limit)


def hotspots(functions: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` riskiest: risk, churn and cognitive complexity descending, then file and line."""
    return functions.orderBy(F.desc("final_score"), F.desc("churn_score"), F.desc("cognitive"), "file", "line").limit(n)


def debt_density(functions: DataFrame) -> DataFrame:
    """Complexity per line over all functions."""
    return functions.agg(X.ratio(F.sum(F.col("cognitive") + F.col("cyclomatic")), F.sum("loc")).alias("tech_debt_density"))
