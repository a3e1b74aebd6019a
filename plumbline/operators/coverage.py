"""Coverage facts: the LCOV parser, joins to functions, gaps, project figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..policy import THRESHOLDS
from .history import overlapping


def numbered_lines(text: DataFrame, column: str = "value", key: str | None = None) -> DataFrame:
    """``report, lineno, line`` of each row's report text."""
    report = F.col(key) if key else F.lit("")
    return text.select(report.alias("report"), F.posexplode(F.split(F.col(column), "\r?\n", -1)).alias("lineno", "line"))


#: Line numbers and counts have 32 bits.
MOST = 0xFFFFFFFF


def _number(part: Column) -> Column:
    """An unsigned number of 32 bits; null for all else, as for blanks around it."""
    number = F.when(part.rlike(r"^\+?[0-9]+\z"), part.try_cast("decimal(38,0)"))
    return F.when(number <= MOST, number).cast("long")


def framed(lines: DataFrame) -> DataFrame:
    """Lines with the record they count to: lines outside a record go to the next file's; of a path's records the last counts.

    Columns: ``report, lineno, line, record, path``.
    """
    order = Window.partitionBy("report").orderBy("lineno")
    opens = F.col("line").startswith("SF:")
    after = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("_opened", F.last(F.when(opens, F.col("lineno")), True).over(order)).withColumn("_closed", F.last(F.when(F.col("line") == "end_of_record", F.col("lineno")), True).over(after))
    inside = F.col("_opened").isNotNull() & (F.coalesce("_closed", F.lit(-1)) < F.col("_opened"))
    following = Window.partitionBy("report").orderBy("lineno").rowsBetween(0, Window.unboundedFollowing)
    later = F.first(F.when(opens, F.col("lineno")), True).over(following)
    record = F.when(inside, F.col("_opened")).otherwise(later)
    paths = lines.where(opens).select("report", F.col("lineno").alias("record"), F.expr("substring(line, 4)").alias("path"))
    last = paths.groupBy("report", "path").agg(F.max("record").alias("record"))
    return marked.withColumn("record", record).join(last, ["report", "record"]).select("report", "lineno", "line", "record", "path")


def lcov(lines: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """``cov_lines(path, line, hits)`` and ``cov_branches(path, line, taken)`` of LCOV lines.

    Malformed entries are passed over; the last hits of a line count; a branch is taken unless
    its count is ``-``. Absolute paths under ``root`` lose it.
    """
    f = framed(lines)
    prefix = root.rstrip("/") + "/"
    path = F.when(F.col("path").startswith(prefix), F.expr(f"substring(path, {len(prefix) + 1})")).otherwise(F.col("path")) if root else F.col("path")
    f = f.withColumn("path", path)
    da = f.where(F.col("line").startswith("DA:")).withColumn("_p", F.split(F.expr("substring(line, 4)"), ",", -1))
    da = da.select("path", _number(F.get("_p", F.lit(0))).alias("line"), _number(F.get("_p", F.lit(1))).alias("hits"), "lineno").where("line is not null and hits is not null")
    cov_lines = da.groupBy("path", "line").agg(F.max_by("hits", "lineno").alias("hits"))
    br = f.where(F.col("line").startswith("BRDA:")).withColumn("_p", F.split(F.expr("substring(line, 6)"), ",", -1)).where(F.size("_p") >= 4)
    cov_branches = br.select("path", _number(F.get("_p", F.lit(0))).alias("line"), (F.get("_p", F.lit(3)) != "-").alias("taken")).where("line is not null")
    return cov_lines, cov_branches


def function_coverage(functions: DataFrame, cov_lines: DataFrame, cov_branches: DataFrame) -> DataFrame:
    """``key, line_coverage, branch_coverage, coverage_gap`` of the functions whose file has coverage.

    A function without a relevant line has coverage 0; without a branch its branch coverage is null.
    """
    f = functions.select("key", "file", "line", "end_line")
    covered = f.join(cov_lines.select(F.col("path").alias("file")).union(cov_branches.select(F.col("path").alias("file"))).distinct(), "file", "left_semi")
    points = lambda c: c.withColumn("start_line", F.col("line")).withColumnRenamed("line", "end_line")
    lines = overlapping(covered, points(cov_lines)).groupBy("key").agg((F.count_if(F.col("hits") > 0) / F.count("*")).alias("line_coverage"))
    branches = overlapping(covered, points(cov_branches)).groupBy("key").agg((F.count_if("taken") / F.count("*")).alias("branch_coverage"))
    out = covered.select("key").join(lines, "key", "left").join(branches, "key", "left").withColumn("line_coverage", F.coalesce("line_coverage", F.lit(0.0)))
    return out.withColumn("coverage_gap", F.lit(1.0) - F.col("line_coverage"))


def risk_gap(final_score: Column | str, line_coverage: Column | str) -> Column:
    """The gap reported in the end: risk that no test covers."""
    return X.col(final_score) * (F.lit(1.0) - X.col(line_coverage))


def project_coverage(functions: DataFrame) -> DataFrame:
    """One row: ``available, project_line_coverage, high_risk_uncovered`` over functions with a non-null ``line_coverage``."""
    some = F.col("line_coverage").isNotNull()
    risky = some & (F.col("final_score") >= THRESHOLDS.uncovered_risk) & (F.col("line_coverage") < THRESHOLDS.uncovered_lines)
    return functions.agg((F.count_if(some) > 0).alias("available"), F.avg("line_coverage").alias("project_line_coverage"), F.count_if(risky).alias("high_risk_uncovered"))
