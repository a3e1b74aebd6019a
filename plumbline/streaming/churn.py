"""Churn over an append stream of line changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import history as H


def append_changes(stream: DataFrame, facts: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's line changes to the Parquet facts at ``facts``, a folder for each batch.

    A batch that is run again after a failure replaces its own folder, so each change is kept
    once; aggregates are always computed from the facts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{facts}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_churn(spark: SparkSession, facts: str) -> DataFrame:
    """Churn of each path over all batches so far."""
    return H.churn(spark.read.parquet(facts).drop("batch"), ["path"])
