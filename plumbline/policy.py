"""Scoring weights, thresholds and other constants of the report."""

from __future__ import annotations

from dataclasses import dataclass

SCHEMA_VERSION = "0.4.0"
WHOLE_FILE_END = 1_000_000_000
DAY = 86_400

#: Contribution weights; their order settles ties for the primary driver.
WEIGHTS = {
    "cognitive": 0.30,
    "churn": 0.20,
    "churn_recent": 0.15,
    "fan_in": 0.10,
    "cyclomatic": 0.10,
    "loc": 0.05,
    "authors": 0.05,
    "coverage_gap": 0.05,
}
METRICS = tuple(WEIGHTS)

DEFAULT_BUG_FIX_PATTERNS = (
    r"(?i)\bfix(es|ed|ing)?\b",
    r"(?i)\bbugs?(fix(es|ed)?)?\b",
    r"(?i)\bissues?\b",
    r"(?i)\bclos(e|es|ed|ing)\b",
    r"(?i)\bresolv(e|es|ed|ing)\b",
)

PLACEHOLDERS = ("todo", "fixme", "placeholder", "insert code here", "not implemented", "arg1", "arg2", "foo", "bar", "baz")

#: Accepted sort keys and the metric each stands for.
SORT_KEYS = {
    "file": "location", "location": "location",
    "churn_score": "churn_score", "churn": "churn_score",
    "risk": "risk", "risk_score": "risk",
    "cognitive": "cognitive", "cognitive_complexity": "cognitive",
    "cyclomatic": "cyclomatic", "cyclomatic_complexity": "cyclomatic",
    "loc": "loc", "lines_of_code": "loc",
}


@dataclass(frozen=True)
class Thresholds:
    """Risk percentiles from which a level is reached, and other cut-offs."""

    critical: float = 95.0
    high: float = 80.0
    medium: float = 50.0
    uncovered_risk: float = 0.80
    uncovered_lines: float = 0.50
    accelerating: float = 1.25
    cooling: float = 0.75
    sparse_cognitive: int = 8
    sparse_bytes: int = 80


THRESHOLDS = Thresholds()
