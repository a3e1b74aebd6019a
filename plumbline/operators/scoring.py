"""Order statistics, outlier caps, normalisation, percentile ranks and risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..policy import METRICS
from .lineage import cut


#: Ranges of values at most; a range is ranked by one task.
RANGES = 512


def _bounds(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Rough quantiles that cut each column into one range for each shuffle partition; results don't depend on them."""
    n = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).approxQuantile([f"_{i}" for i in range(len(columns))], [k / n for k in range(1, n)] or [0.5], 0.01)
    return [sorted(set(b)) for b in found]


def _range(value: Column, bounds: Sequence[float], first: int = 0) -> Column:
    """The number of bounds up to ``value``, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(value < F.lit(float(bounds[k])), _range(value, bounds[:k], first)).otherwise(_range(value, bounds[k + 1 :], first + k + 1))


def value_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``metric, value, n, less, total``: each column's distinct non-null values, their rows, the rows with smaller values and all rows.

    All columns are counted by value in one pass, with map-side combining. Running sums are within
    ranges of values; a range's offset comes from the ranges' totals, RANGES a column at most, so no
    task sorts a whole column. ``df`` is read twice: cut it first where it isn't a scan.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("_p")).select("_p.*").where("value is not null").groupBy("metric", "value").agg(F.count("*").alias("n"))
    part = F.lit(0)
    for c, b in zip(columns, _bounds(df, columns), strict=True):
        part = F.when(F.col("metric") == c, _range(F.col("value"), b)).otherwise(part)
    ranged = counts.withColumn("_part", part)
    totals = ranged.groupBy("metric", "_part").agg(F.sum("n").alias("_t"))
    every = Window.partitionBy("metric")
    offset = totals.select("metric", "_part", (F.sum("_t").over(every.orderBy("_part")) - F.col("_t")).alias("_before"), F.sum("_t").over(every).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("metric", "_part").orderBy("value")) - F.col("n")
    return ranged.withColumn("_in", inside).join(F.broadcast(offset), ["metric", "_part"]).select("metric", "value", "n", (F.col("_before") + F.col("_in")).alias("less"), "total")


def order_statistics(df: DataFrame, columns: Sequence[str], percents: Sequence[int] = (95, 99)) -> DataFrame:
    """``metric, n, max_value, p95, p99``: the value at index ``n * p div 100`` of each sorted column, nulls left out."""

    def pick(p: int) -> Column:
        index = F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
        return F.max(F.when((F.col("less") <= index) & (index < F.col("less") + F.col("n")), F.col("value"))).alias(f"p{p}")

    return value_ranks(df, columns).groupBy("metric").agg(F.max("total").alias("n"), F.max("value").alias("max_value"), *[pick(p) for p in percents])


def capped(stats: DataFrame) -> DataFrame:
    """``stats`` with ``cap``: the maximum, or p99 where the maximum is over three times p95; at least 1."""
    return stats.withColumn("cap", F.greatest(F.when(F.col("max_value") > F.col("p95") * 3, F.col("p99")).otherwise(F.col("max_value")), F.lit(1.0)))


def caps_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``cap_<column>`` for each column."""
    stats = capped(order_statistics(df, columns))
    return stats.agg(*[F.coalesce(F.max(F.when(F.col("metric") == c, F.col("cap"))), F.lit(1.0)).alias(f"cap_{c}") for c in columns])


def with_percentiles(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` with percentile ranks: ``columns`` maps a value to the new column; 100 where there is one row at most."""
    df = cut(df)  # it is read for the bounds, the counts and the result
    rows = df.agg(F.count("*").alias("_rows"))
    ranks = value_ranks(df, list(columns))
    out = df.crossJoin(F.broadcast(rows))
    for c, name in columns.items():
        own = ranks.where(F.col("metric") == c).select(F.col("value").alias("_v"), F.col("less").alias("_less"))
        rank = F.when(F.col("_rows") <= 1, F.lit(100.0)).otherwise(F.col("_less") / (F.col("_rows") - 1) * F.lit(100.0))
        out = out.join(own, F.col(c).cast("double") == F.col("_v"), "left").withColumn(name, rank).drop("_v", "_less")
    return out.drop("_rows")


def normalised(df: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """``df`` with ``norm_<metric>`` for each of METRICS in ``metrics`` (metric: column), against the columns' own caps."""
    columns = list(metrics.values())
    df = cut(df)  # it is read for the caps and the result
    caps = caps_row(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), columns)
    out = df.crossJoin(F.broadcast(caps))
    for m, c in metrics.items():
        out = out.withColumn(f"norm_{m}", F.when(F.col(c).isNotNull(), X.log_norm(c, f"cap_{c}")))
    return out.drop(*[f"cap_{c}" for c in columns])


def norm_columns(df: DataFrame) -> dict[str, Column]:
    return {m: F.col(f"norm_{m}") if f"norm_{m}" in df.columns else F.lit(None).cast("double") for m in METRICS}


def scored(df: DataFrame, nesting: str = "nesting_depth", digits: int | None = None) -> DataFrame:
    """Base score, nesting penalty, final score and primary driver from ``norm_*`` columns; ``digits`` rounds scores before they are ranked."""
    norm = norm_columns(df)
    exact = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    out = df.withColumn("base_score", exact(X.base_score(norm))).withColumn("nesting_penalty", X.nesting_penalty(nesting))
    final = X.base_score(norm) * F.col("nesting_penalty") * X.fan_in_factor(F.coalesce(norm["fan_in"], F.lit(0.0)))
    return out.withColumn("final_score", exact(final)).withColumn("primary_driver", X.primary_driver(norm))


def ranked(df: DataFrame, churn: str, cognitive: str) -> DataFrame:
    """Percentiles of risk, churn and cognitive complexity, and the risk level."""
    out = with_percentiles(df, {"final_score": "risk_percentile", churn: "churn_percentile", cognitive: "cognitive_percentile"})
    return out.withColumn("risk_level", X.risk_level("risk_percentile"))
