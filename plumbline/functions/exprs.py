"""Column expressions of the metrics; all are built-in functions, so they stay within code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import PLACEHOLDERS, THRESHOLDS, WEIGHTS, Thresholds

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str, empty: float | None = 0.0) -> Column:
    """``a / b`` as a double; ``empty`` where ``b`` is zero or null."""
    b = col(b)
    return F.when(b.isNull() | (b == 0), F.lit(empty).cast("double")).otherwise(col(a).cast("double") / b)


def log_norm(value: Column | str, cap: Column | str) -> Column:
    """``ln(1 + value) / ln(1 + cap)``, at most 1."""
    return F.least(F.log(F.lit(1.0) + col(value)) / F.log(F.lit(1.0) + col(cap)), F.lit(1.0))


def churn_score(commits: Column | str, bug_commits: Column | str, authors: Column | str) -> Column:
    return (col(commits) + F.lit(2) * col(bug_commits)) * F.log10(col(authors) + F.lit(1.0))


def recent_score(commits: Column | str, authors: Column | str) -> Column:
    return col(commits) * F.log10(col(authors) + F.lit(1.0))


def velocity(d7: Column | str, d90: Column | str, t: Thresholds = THRESHOLDS) -> Column:
    """Pace of the last week against the last quarter; both bounds count."""
    pace = (col(d7) / F.lit(7.0)) / (col(d90) / F.lit(90.0))
    return F.when(col(d90) <= 1, "stable").when(pace >= t.accelerating, "accelerating").when(pace <= t.cooling, "cooling").otherwise("stable")


def risk_level(percentile: Column | str, t: Thresholds = THRESHOLDS) -> Column:
    p = col(percentile)
    return F.when(p >= t.critical, "critical").when(p >= t.high, "high").when(p >= t.medium, "medium").otherwise("low")


def base_score(norm: dict[str, Column]) -> Column:
    """Weighted sum of normalised metrics; a missing one adds nothing."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.coalesce(norm[name], F.lit(0.0)) * F.lit(weight)
    return total


def nesting_penalty(depth: Column | str) -> Column:
    d = col(depth) / F.lit(4.0)
    return F.lit(1.0) + d * d * F.lit(0.20)


def fan_in_factor(norm_fan_in: Column) -> Column:
    return F.lit(1.0) + F.lit(0.25) * norm_fan_in


def primary_driver(norm: dict[str, Column]) -> Column:
    """The metric that adds most to the base score; of equals the first of WEIGHTS."""
    parts = [F.struct((F.coalesce(norm[n], F.lit(0.0)) * F.lit(w)).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, w) in enumerate(WEIGHTS.items())]
    return F.array_max(F.array(*parts)).getField("n")


def instability(fan_in: Column | str, fan_out: Column | str) -> Column:
    return ratio(fan_out, col(fan_in) + col(fan_out))


def doc_quality(doc_bytes: Column | str, cognitive: Column | str, t: Thresholds = THRESHOLDS) -> Column:
    return F.when(col(doc_bytes) == 0, "missing").when((col(cognitive) >= t.sparse_cognitive) & (col(doc_bytes) < t.sparse_bytes), "sparse").otherwise("adequate")


def hollow_kind(statements: Column | str, comment_lines_: Column | str) -> Column:
    return F.when(col(statements) > 0, "none").when(col(comment_lines_) > 0, "comment_only").otherwise("empty")


#: Unicode's white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _lines(text: Column | str) -> Column:
    """Lines without white space at their ends, without the empty one that a closing line feed leaves."""
    return F.transform(F.split(F.regexp_replace(col(text), r"\n$", ""), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))


def comment_lines(text: Column | str) -> Column:
    return F.size(F.filter(_lines(text), lambda x: x.startswith("//") | x.startswith("/*") | x.startswith("*"))).cast("long")


def solid_lines(text: Column | str) -> Column:
    return F.size(F.filter(_lines(text), lambda x: x != "")).cast("long")


def comment_ratio(text: Column | str) -> Column:
    return ratio(comment_lines(text), solid_lines(text))


def ascii_lower(text: Column | str) -> Column:
    return F.translate(col(text), _UPPER, _LOWER)


def placeholder_count(text: Column | str, needles: Sequence[str] = PLACEHOLDERS) -> Column:
    """Occurrences of every needle, each counted alone and without overlap."""
    low = ascii_lower(text)
    total = F.lit(0)
    for n in needles:
        total = total + (F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / F.lit(len(n))
    return total.cast("long")


def call_name(text: Column | str) -> Column:
    """The last run of ASCII letters, digits and underscores; empty if there is none."""
    return F.regexp_extract(col(text), r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)


def is_bug_fix(message: Column | str, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | col(message).rlike(p)
    return out


def author_identity(email: Column | str, name: Column | str) -> Column:
    filled = lambda c: F.when(col(c) != "", col(c))
    return F.coalesce(filled(email), filled(name), F.lit("Unknown"))


def is_test_file(path: Column | str) -> Column:
    p = col(path)
    return p.contains("/tests/") | p.endswith("_test.rs") | p.endswith(".test.ts") | p.endswith(".spec.ts")


def initial_reachability(test_entry: Column | str, exported: Column | str) -> Column:
    return F.when(col(test_entry), "test_entry").when(col(exported), "unreachable_export").otherwise("unreachable_private")


def function_ref(file: Column | str, name: Column | str) -> Column:
    return F.concat_ws(":", col(file), col(name))


def rfc3339(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd'T'HH:mm:ssxxx")
