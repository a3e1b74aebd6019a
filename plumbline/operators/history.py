"""Change facts: churn, trailing windows, range joins, renames, contributions.

``line_changes(path, commit, author, ts, is_bug_fix, start_line, end_line)`` may come from a
repository or from any table with those columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..policy import DAY, WHOLE_FILE_END
from .lineage import cut, spread


def churn(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct commits, bug fixes and authors of each key, the trailing windows and their scores.

    A key's rows meet in one task, which sorts (and spills) them by commit: the first row of a commit
    counts it. ``changes`` is read once and sent once. Few rows share key, commit and author, so
    they aren't combined before: that took a hash table of all rows on either side of another
    exchange. Windows are anchored on the key's own last change.
    """
    keys = list(keys)
    each = spread(changes.select(*keys, "commit", "author", F.col("is_bug_fix").cast("int").alias("_bug"), F.col("ts").alias("_ts")), *keys)
    in_order = Window.partitionBy(*keys).orderBy("commit")  # all windows below share its exchange and its sort
    again = (F.row_number().over(in_order) > 1) & F.lag("commit").over(in_order).eqNullSafe(F.col("commit"))
    of_commit = Window.partitionBy(*keys, "commit")
    each = each.withColumn("_one", (~again).cast("int")).withColumn("_last", F.max("_ts").over(Window.partitionBy(*keys)))
    each = each.withColumn("_bug", F.max("_bug").over(of_commit)).withColumn("_ts", F.max("_ts").over(of_commit))
    counts = [F.sum(F.when(F.col("_ts") >= F.col("_last") - d * DAY, F.col("_one")).otherwise(0)).alias(f"d{d}_modifications") for d in (7, 30, 90)]
    out = each.groupBy(*keys).agg(
        F.sum("_one").alias("times_modified"), F.sum(F.col("_bug") * F.col("_one")).cast("long").alias("bug_fix_commits"), F.max("_ts").alias("last_modified"), *counts,
        F.greatest(F.countDistinct("author"), F.lit(1)).alias("authors_count"),
    )
    out = out.withColumn("churn_score", X.churn_score("times_modified", "bug_fix_commits", "authors_count"))
    for d in (7, 30, 90):
        out = out.withColumn(f"d{d}_score", X.recent_score(f"d{d}_modifications", "authors_count"))
    return out.withColumn("velocity", X.velocity("d7_modifications", "d90_modifications"))


def overlapping(functions: DataFrame, changes: DataFrame, file: str = "file", bucket_lines: int = 64) -> DataFrame:
    """``functions(file, line, end_line, ...)`` joined with the changes whose closed line ranges they meet.

    Both sides are spread over buckets of lines, so that a file with many functions and changes
    is many small joins; a pair is taken in the one bucket where its overlap begins. Changes of
    whole files would fill every bucket: they meet each function of the file, by an equi-join.
    """
    c = changes.select(F.col("path").alias("_path"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"), *[x for x in changes.columns if x not in ("path", "start_line", "end_line")])
    part, full = c.where(~(F.col("_end") >= WHOLE_FILE_END)), c.where(F.col("_end") >= WHOLE_FILE_END)
    buckets = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / bucket_lines), F.floor(F.col(high) / bucket_lines)))
    f = functions.where(F.col("line") <= F.col("end_line"))
    near = f.withColumn("_bucket", buckets("line", "end_line")).join(
        part.where("_start <= _end").withColumn("_cbucket", buckets("_start", "_end")), (F.col(file) == F.col("_path")) & (F.col("_bucket") == F.col("_cbucket"))
    )
    near = near.where((F.col("line") <= F.col("_end")) & (F.col("_start") <= F.col("end_line")) & (F.floor(F.greatest("line", "_start") / bucket_lines) == F.col("_bucket")))
    met = near.drop("_bucket", "_cbucket").unionByName(f.join(full, (F.col(file) == F.col("_path")) & (F.col("_start") <= F.col("end_line"))))
    return met.drop("_path").withColumnRenamed("_start", "change_start").withColumnRenamed("_end", "change_end")


def function_churn(functions: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Churn of each function from the changes that touch its lines; functions without any are left out."""
    return churn(overlapping(functions, changes), keys)


def rename_aliases(renames: DataFrame) -> DataFrame:
    """``old_path, new_path``: of several renames of one path the one of the highest ``seq``, the oldest, wins."""
    return renames.groupBy("old_path").agg(F.max_by("new_path", "seq").alias("new_path"))


def _chain_ends(step: DataFrame, steps: int) -> DataFrame:
    """``old_path, path, _moved``: each path after ``2**steps`` renames, or at its chain's end; whether the last round still moved it."""
    at = step.select("old_path", F.col("new_path").alias("path"))
    for _ in range(steps):
        jump = at.select(F.col("old_path").alias("path"), F.col("path").alias("_next"))
        at = cut(at.select("old_path", "path").join(jump, "path", "left").select("old_path", F.coalesce("_next", "path").alias("path"), F.col("_next").isNotNull().alias("_moved")))
        if at.where("_moved").isEmpty():
            break
    return at


def rename_closure(aliases: DataFrame) -> DataFrame:
    """``old_path, final_path``: the end of each path's chain; a chain that turns into a cycle ends where it first comes back.

    By pointer jumping: each round doubles the steps taken, so a chain of a million renames takes
    twenty joins. What still moves after as many steps as there are renames is on a cycle, and the
    places it has come to are the cycles' paths; these end at themselves, and chains that lead to them, there.
    """
    step = cut(aliases.where("old_path is not null and new_path is not null").select("old_path", "new_path"))
    steps = step.count().bit_length() + 1  # one more round, in which chains that have ended stand still
    at = _chain_ends(step, steps)
    moving = at.where("_moved")
    if moving.isEmpty():
        return at.select("old_path", F.col("path").alias("final_path"))
    cycles = cut(moving.select(F.col("path").alias("old_path")).distinct())
    rest = _chain_ends(step.join(cycles, "old_path", "left_anti"), steps)
    return rest.select("old_path", F.col("path").alias("final_path")).unionByName(cycles.withColumn("final_path", F.col("old_path")))


def with_renames(changes: DataFrame, closure: DataFrame) -> DataFrame:
    """Each change at its own path and, once more, at its path's final name."""
    joined = changes.join(closure.withColumnRenamed("old_path", "path"), "path", "left")
    return joined.withColumn("path", F.explode(F.array_distinct(F.array("path", F.coalesce("final_path", "path"))))).drop("final_path")


def active_only(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of paths that still exist."""
    return changes.join(files.select("path").distinct(), "path", "left_semi")


def unique_authors(changes: DataFrame) -> DataFrame:
    return changes.agg(F.countDistinct("author").alias("total_unique_authors"))


def contributions(changes: DataFrame) -> DataFrame:
    return changes.groupBy("author").agg(F.count("*").alias("contributions"))


def bus_factor(by_author: DataFrame) -> DataFrame:
    """Fewest authors who together have half of all contributions, rounded up.

    Authors are grouped by their number of contributions first: the running sum is over distinct
    numbers, few even for millions of authors.
    """
    sizes = by_author.groupBy("contributions").agg(F.count("*").alias("_authors"))
    down = Window.orderBy(F.desc("contributions"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("contributions") * F.col("_authors")
    run = sizes.withColumn("_total", F.sum(part).over(Window.partitionBy())).withColumn("_sum", F.coalesce(F.sum(part).over(before), F.lit(0)))
    half = F.ceil(F.col("_total") / 2)
    needed = F.when(F.col("_sum") >= half, 0).otherwise(F.least("_authors", F.ceil((half - F.col("_sum")) / F.col("contributions"))))
    return run.agg(F.coalesce(F.sum(needed), F.lit(0)).cast("long").alias("bus_factor"))


def merged_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of partial histories ``(path, commit, author, is_bug_fix, n_changes)``: sums of counts, sets of authors."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    per_path = both.groupBy("path").agg(F.sum("times_modified").cast("long").alias("times_modified"), F.sum("bug_fix_commits").cast("long").alias("bug_fix_commits"), F.array_distinct(F.flatten(F.collect_list("authors"))).alias("_a"))
    return per_path.select("path", "times_modified", "bug_fix_commits", F.size("_a").cast("long").alias("authors_count"))


def partial_counts(changes: DataFrame) -> DataFrame:
    """Partial history of each path, for :func:`merged_counts`; parts must not share commits."""
    commits = changes.groupBy("path", "commit").agg(F.max(F.col("is_bug_fix").cast("int")).alias("_bug"), F.collect_set("author").alias("_authors"))
    return commits.groupBy("path").agg(F.count("*").alias("times_modified"), F.sum("_bug").cast("long").alias("bug_fix_commits"), F.array_distinct(F.flatten(F.collect_list("_authors"))).alias("authors"))
