"""Line deduplication over overlapping windows of three lines.

Windows of consecutive lines are hashed by built-in expressions (two 64-bit hashes with separate
seeds), the earliest place of each hash is found by one aggregation with map-side combining, and
the lines that any later occurrence covers are removed. Text is shuffled once, for the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free

WINDOW = 3


def _window_hash(seed: str, i: Column) -> Column:
    lines = [F.element_at("_lines", i + k) for k in range(1, WINDOW + 1)]
    return F.xxhash64(F.lit(seed), *lines)


def covered_lines(docs: DataFrame) -> DataFrame:
    """``_id, _key, _covered``: for each text with repeats, the 0-based lines that later occurrences cover."""
    known = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), F.split("text", "\n", -1).alias("_lines")
    )
    windows = known.where(F.size("_lines") >= WINDOW).select(
        "_id", "_key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), lambda i: F.struct(_window_hash("a", i).alias("a"), _window_hash("b", i).alias("b")))).alias("_at", "_h")
    )
    windows = windows.select(F.col("_h.a").alias("_a"), F.col("_h.b").alias("_b"), F.struct("_id", "_key", "_at").alias("_place"))
    first = windows.groupBy("_a", "_b").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = windows.join(first, ["_a", "_b"]).where("_place > _first").select("_place.*")
    lines = later.select("_id", "_key", F.explode(F.sequence("_at", F.col("_at") + (WINDOW - 1))).alias("_at"))
    return lines.groupBy("_id", "_key").agg(F.collect_set("_at").alias("_covered"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of repeated three-line windows removed, plus ``removed_lines``.

    Lines are what "\\n" separates, compared exactly. Of every three consecutive lines that occur
    more than once, at any place of any text, the first occurrence in the order of (doc_id, the
    text's hash, line) stays; lines covered by any later one go, the union of all. Where a later
    occurrence overlaps the first (a text that repeats itself), one period stays.

    * Rows with a null doc_id or text, and texts of fewer than three lines, pass unchanged with 0.
    * A text that loses every line becomes empty, and its row stays.
    * Repeated rows (one doc_id, one text) are the same document: all of them keep or lose the same lines.
    * All other columns pass unchanged, whatever their names; ``removed_lines`` of the input is replaced. An empty table gives an empty one.
    """
    others = [c for c in docs.columns if c.lower() != "text"]
    i, key, lines, covered = (free(c, docs.columns) for c in ("_id", "_key", "_lines", "_covered"))
    keyed = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64("text")).withColumn(lines, F.split("text", "\n", -1)).drop("text")
    joined = keyed.join(covered_lines(docs).toDF(i, key, covered), [i, key], "left")
    # the lines were split before the join, so that picking one doesn't split the text again
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda k: F.element_at(lines, k + 1))
    left = F.when(F.col(covered).isNull(), F.col(lines)).otherwise(kept)
    gone = F.when(F.col(covered).isNotNull(), F.size(covered)).otherwise(0).cast("long")
    out = joined.withColumn("text", F.array_join(left, "\n")).withColumn("removed_lines", gone)
    return out.select(*[F.col(c) if c in others else "text" for c in docs.columns if c.lower() != "removed_lines"], "removed_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))


SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT doc_id, p, l[p + 1] AS x, l[p + 2] AS y, l[p + 3] AS z
            FROM (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 0))) AS p FROM split)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, p + k AS line FROM later, range(0, 3) AS t(k)),
lines AS (SELECT doc_id, unnest(l) AS body, unnest(range(0, len(l))) AS line FROM split),
kept AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY line) AS text FROM lines ANTI JOIN covered USING (doc_id, line) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(g.n, 0) AS removed_lines
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""
