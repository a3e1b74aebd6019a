"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put in an order of seeded hashes and cut into blocks. The weights
give each source an exact quota of documents, hence of blocks. The tree starts with all quotas
and all output shards: a node gives its left half of the shards a multivariate-hypergeometric
draw of its blocks, and so on down to single shards. A shard then takes, of each source's
permuted blocks, the next ones that no other shard has, and its documents are shuffled by hash.

A node's draw is seeded by its place in the tree, so subtrees are drawn apart: the driver draws
down to DRIVER_NODES nodes, and tasks draw the rest. Blocks are permuted by a keyed bijection of
their numbers, which needs no sort. Only ids and hashes are ranked. Ranks within a source come from
counts of hash ranges, so a source of any size is ranked by many tasks; text is moved once to be
joined with its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets, cut, documents, free
from .tokens import mix
from .tokens import ranges as ranges_of

BLOCK = 64
SHARD_DOCS = 4096
#: Nodes down to which the driver draws the tree; below them tasks do.
DRIVER_NODES = 1 << 10
SEED = 7
#: Hash ranges by which a source is ranked hold about this many documents.
RANGE_DOCS = 20_000
#: Exponent of the default weights: a source's share is in proportion to its size to this power.
TEMPERATURE = 0.7


def default_weights(sizes: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Weights that flatten the sources' natural shares."""
    return {s: n**temperature for s, n in sizes.items()}


def quotas(sizes: dict[str, int], weights: dict[str, float]) -> dict[str, int]:
    """Documents to take of each source: the most whose shares are the weights', since none is taken twice.

    Sources without a weight, or with one of zero, get none. Rounded down.
    """
    given = {s: float(weights.get(s, 0.0)) for s in sizes}
    if any(w < 0 or not math.isfinite(w) for w in given.values()):
        raise ValueError("weights must be finite and not negative")
    wanted = {s: w for s, w in given.items() if w > 0 and sizes[s] > 0}
    if not wanted:
        return dict.fromkeys(sizes, 0)
    total = min(sizes[s] / w for s, w in wanted.items())
    return {s: min(sizes[s], math.floor(total * given[s] + 1e-9)) for s in sizes}


def draw(low: int, high: int, blocks: np.ndarray, total: int, shards: int, seed: int, down_to: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """Nodes of ``down_to`` shards at most below the node of shards ``low`` to ``high``, in their order, and the blocks of each source that each gets.

    Shards differ by one block at most. A node's seed is its place in the tree, so every node can be drawn alone.
    """
    before = lambda shard: shard * (total // shards) + min(shard, total % shards)
    stack = [(low, high, np.asarray(blocks, np.int64))]
    while stack:
        low, high, have = stack.pop()
        if high - low <= down_to:
            yield low, high, have
            continue
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, before(middle) - before(low), method="marginals")
        stack += [(middle, high, have - left), (low, middle, left)]


def split(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows), which sum to ``blocks``: the whole tree."""
    return np.stack([have for _, _, have in draw(0, shards, blocks, int(np.sum(blocks)), shards, seed)])


def permuted(slots: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed bijection of 0 to ``n`` - 1: four rounds of a Feistel network over the next power of four, walked until back in range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), slots.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64((seed * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shards_of_blocks(spark: SparkSession, counts: dict[str, int], shards: int, seed: int) -> DataFrame:
    """``_source, _block, shard``: each source's permuted blocks, the first for its first shard, and so on."""
    names = sorted(counts)
    blocks = np.array([counts[s] for s in names], np.int64)
    total = int(blocks.sum())
    rows, start = [], np.zeros(len(names), np.int64)
    for low, high, have in draw(0, shards, blocks, total, shards, seed, max(1, -(-shards // DRIVER_NODES))):
        rows.append((low, high, have.tolist(), start.tolist()))
        start = start + have

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, have, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.array(start, np.int64)
                for shard, _, own in draw(low, high, np.array(have), total, shards, seed):
                    which = np.repeat(np.arange(len(names)), own)
                    slot = ranges_of(at, own)
                    number = np.empty(len(slot), np.int64)
                    for k in np.flatnonzero(own):
                        number[which == k] = permuted(slot[which == k], int(blocks[k]), seed + int(k))
                    at = at + own
                    yield pa.record_batch([pa.array([names[k] for k in which], pa.string()), pa.array(number), pa.array(np.full(len(slot), shard))], names=["_source", "_block", "shard"])

    nodes = spark.createDataFrame(rows, "low long, high long, have array<long>, start array<long>")
    return nodes.repartition(min(len(rows), buckets(spark))).mapInArrow(expand, "_source string, _block long, shard long")


def placed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """Places of the drawn documents: ``_id, _source, _copy, shard, position``; ``_copy`` tells rows of one id and source apart."""
    spark = docs.sparkSession
    keyed = docs.where("doc_id is not null and source is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_source"))
    keyed = keyed.groupBy("_id", "_source").agg(F.count("*").alias("_n")).select("_id", "_source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    keyed = cut(keyed.withColumn("_h", F.xxhash64(F.lit(seed), "_source", "_id", "_copy")))
    sizes = {r._source: r.n for r in keyed.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    taken = quotas(sizes, default_weights(sizes) if weights is None else weights)
    names = sorted(s for s, n in taken.items() if n > 0)
    if not names:
        return keyed.where("false").select("_id", "_source", "_copy", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("position"))
    counts = np.array([-(-taken[s] // block) for s in names])
    shards = max(1, -(-int(sum(taken.values())) // shard_docs))
    where = shards_of_blocks(spark, dict(zip(names, counts.tolist(), strict=True)), shards, seed)
    limit = spark.createDataFrame([(s, int(taken[s])) for s in names], "_source string, _quota long")
    ranges = max(1, sum(sizes.values()) // RANGE_DOCS)
    # a hash's range: its place among ``ranges`` equal parts of the signed 64-bit numbers
    part = F.least(F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1))
    ranged = keyed.withColumn("_part", part)
    tally = ranged.groupBy("_source", "_part").agg(F.count("*").alias("_m"))
    before = tally.select("_source", "_part", (F.sum("_m").over(Window.partitionBy("_source").orderBy("_part")) - F.col("_m")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_h", "_id", "_copy"))
    ranked = ranged.withColumn("_r", within).join(before, ["_source", "_part"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1)
    chosen = ranked.join(limit, "_source").where("_rank < _quota").withColumn("_block", F.floor(F.col("_rank") / block))
    local = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "_source", "_id", "_copy"), "_source", "_id", "_copy"))
    return chosen.join(where, ["_source", "_block"]).withColumn("position", local.cast("long") - 1).select("_id", "_source", "_copy", "shard", "position")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """The drawn documents with ``shard`` and ``position``, each shard in one partition and sorted by position.

    ``weights`` are the sources' target shares of documents, in any unit; by default sizes to
    the power of TEMPERATURE. As many documents are drawn as the scarcest source allows, each at
    most once, and quotas are exact. The same table, weights and seed give the same result.

    * A row with a null doc_id or source can't be drawn, and goes; a null text is drawn like any other.
    * Sources that ``weights`` lacks, or gives zero, are left out; unknown sources in it are ignored.
    * Repeated rows are documents of their own, each drawn at most once; of rows with one doc_id and one
      source but different texts, which is drawn first follows their texts' hashes.
    * All columns pass; input columns named ``shard`` or ``position`` are replaced. An empty table gives an empty one.
    """
    kept = docs.drop("shard", "position")
    i, source, copy, nth = (free(c, docs.columns) for c in ("_id", "_source", "_copy", "_nth"))
    places = placed(docs, weights, block, shard_docs, seed).toDF(i, source, copy, "shard", "position")
    several = Window.partitionBy(i, source).orderBy(F.xxhash64("text"), "text")
    keyed = kept.where("doc_id is not null and source is not null").withColumn(i, F.col("doc_id").cast("long")).withColumn(source, F.col("source"))
    numbered = keyed.withColumn(nth, F.row_number().over(several).cast("long"))
    # the copies' numbers are compared, not joined on: so the window's partitioning of the texts is the join's too
    joined = numbered.join(places, [i, source]).where(F.col(nth) - F.col(copy) == 0).select(*kept.columns, "shard", "position")
    return joined.repartition("shard").sortWithinPartitions("shard", "position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))
