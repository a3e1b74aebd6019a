"""Reliable checkpoints in the folder that all executors share; exchanges by key, joins without broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on one machine, one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over all of ``spark.sql.shuffle.partitions``; a join or sums by these keys need no other exchange.

    Partitions whose number is given stay as they are: else they are merged until there are as many
    as cores, or 64 MB of compressed rows in each, which are a GB in a task's sorts and hash tables.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def unsent(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, by ``keys`` where given, as the side of a join that is never broadcast.

    Spark takes a table to be no larger after ``explode``, so that it would send millions of rows
    through the driver; it keeps to that even when it knows better, if the other join has an exchange more.
    """
    return (spread(df, *keys) if keys else df).hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
