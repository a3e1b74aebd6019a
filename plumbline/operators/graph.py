"""The call graph by name: coupling, reachability, dead code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .lineage import spread, unsent


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``caller, callee`` (keys): every function of a called name but the caller itself; repeated calls make one edge.

    ``calls(caller, callee_name)`` and functions are made distinct before the join, so that popular names join once a caller.
    """
    named = unsent(functions.select(F.col("key").alias("callee"), F.col("name").alias("callee_name")), "callee_name").distinct()
    return calls.select("caller", "callee_name").distinct().join(named, "callee_name").where("caller <> callee").select("caller", "callee")


def callers(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``key, callers``: the sorted names of those who call each called function; those of one file and name count once."""
    ref = unsent(functions.select(F.col("key").alias("caller"), X.function_ref("file", "name").alias("_ref")), "caller")
    return edges.join(ref, "caller").groupBy(F.col("callee").alias("key")).agg(F.sort_array(F.collect_set("_ref")).alias("callers"))


def coupling(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``functions(key, file, name)`` with fan-in, fan-out, their sorted names, instability and whether any edge comes in.

    Functions of one file and name count once in a fan.
    """
    back = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    callees = callers(functions, back).withColumnRenamed("callers", "callees")
    none = F.array().cast("array<string>")
    out = functions.join(unsent(callers(functions, edges)), "key", "left").join(unsent(callees), "key", "left").withColumn("has_caller", F.col("callers").isNotNull())
    out = out.withColumn("callers", F.coalesce("callers", none)).withColumn("callees", F.coalesce("callees", none))
    out = out.withColumn("fan_in", F.size("callers").cast("long")).withColumn("fan_out", F.size("callees").cast("long"))
    return out.withColumn("instability", X.instability("fan_in", "fan_out"))


def coupling_counts(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """As :func:`coupling` without the names: fans, instability and ``has_caller`` from sums by name.

    A function's callers are those of its name but itself, and a name leads to as many functions as
    files have it. So calls are counted by name and by caller, and no edge from each caller of a
    name to each function of that name is ever made.
    """
    f = functions.select("key", "file", "name")
    by_key = unsent(f.select(F.col("key").alias("caller"), F.col("file").alias("_file"), F.col("name").alias("_name")), "caller")
    d = calls.select("caller", "callee_name").distinct().join(by_key, "caller")
    refs = d.groupBy("callee_name", "_file", "_name").agg(F.count("*").alias("_k"))
    by_name = refs.groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("_refs"), F.sum("_k").alias("_callers"))
    places = spread(f, "name").groupBy("name", "file").agg(F.count("*").alias("_same"))
    files = places.groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("_files"))
    # calls of a function's own name: itself is neither its caller nor its callee, but another of its file and name is
    own = d.where("callee_name = _name").join(unsent(refs), ["callee_name", "_file", "_name"]).select(F.col("caller").alias("key"), F.col("_k").alias("_own"))
    out_ = d.join(unsent(files), "callee_name").groupBy(F.col("caller").alias("key")).agg(F.sum("_files").alias("_out"))
    wide = spread(functions, "name").join(unsent(places), ["name", "file"]).join(unsent(by_name), "name", "left").join(unsent(own), "key", "left").join(unsent(out_), "key", "left")
    calls_itself = F.col("_own").isNotNull()
    wide = wide.withColumn("has_caller", F.coalesce(F.col("_callers") - calls_itself.cast("long"), F.lit(0)) > 0)
    wide = wide.withColumn("fan_in", F.coalesce(F.col("_refs") - (calls_itself & (F.col("_own") == 1)).cast("long"), F.lit(0)).cast("long"))
    wide = wide.withColumn("fan_out", F.coalesce(F.col("_out") - (calls_itself & (F.col("_same") == 1)).cast("long"), F.lit(0)).cast("long"))
    return wide.withColumn("instability", X.instability("fan_in", "fan_out")).select(*functions.columns, "has_caller", "fan_in", "fan_out", "instability")


def reachability(functions: DataFrame) -> DataFrame:
    """``is_reachable`` and the final ``kind``, from ``kind``, ``has_caller``, ``file`` and ``name``; one hop, no traversal."""
    test = (F.col("kind") == "test_entry") | X.is_test_file("file")
    reachable = F.col("has_caller") | (F.col("kind") == "unreachable_export") | test | (F.col("name") == "main")
    return functions.withColumn("is_reachable", reachable).withColumn("kind", F.when(~reachable, F.col("kind")).when(test, "test_only").otherwise("reachable"))


def uncalled(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions whose name nobody but themselves calls: of a name's callers the least and the greatest tell, so no edge is made."""
    by_name = calls.groupBy(F.col("callee_name").alias("name")).agg(F.min("caller").alias("_least"), F.max("caller").alias("_greatest"))
    called = F.coalesce((F.col("_least") != F.col("key")) | (F.col("_greatest") != F.col("key")), F.lit(False))
    return spread(functions, "name").join(unsent(by_name), "name", "left").where(~called).select(functions.columns)


def dead_code(functions: DataFrame) -> DataFrame:
    """One row: unreachable functions, their lines, and those safe to delete."""
    dead = ~F.col("is_reachable")
    return functions.agg(
        F.count_if(dead).alias("unreachable_functions"),
        F.coalesce(F.sum(F.when(dead, F.col("lines_of_code"))), F.lit(0)).cast("long").alias("unreachable_loc"),
        F.count_if(dead & (F.col("kind") == "unreachable_private")).alias("safe_to_delete"),
    )
