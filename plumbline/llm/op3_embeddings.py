"""Embedding near-deduplication: random-hyperplane sign hashing, exact verification, connected components.

Each table's key is the signs of ``bits`` random hyperplanes. Bits grow with the logarithm of
the number of vectors, so that a bucket's expected number of unrelated vectors stays the same,
and the number of tables follows from the recall wanted at the threshold. To each table a vector
sends its key, its hash and 256 more signs, 48 bytes whatever the number of tables; vectors of a
bucket whose signs differ no more than the threshold makes likely are linked. Connected vectors
are a block, and in a block the exact cosine of every pair is computed from the vectors.

From ``plan``: 21 tables of 8 bits at 50,000 vectors (1 kB each), 206 of 22 at 10^9 (10 kB), 385 of 26 at 10^10 (18 kB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .groups import chunk_pairs, components, links_within, stars, whole_groups
from .tokens import mix, release

THRESHOLD = 0.9
RECALL = 0.999
BUCKET = 256
SEED = 20
#: Signs by which the vectors of a bucket are compared.
SIGNS = 256
#: Standard deviations by which signs may differ more often than they do at the threshold; 3e-5 of pairs at it do.
SLACK = 4.0
#: Vectors of a bucket, or of a block, that one task compares; larger ones are cut into pairs of chunks.
CHUNK = 4096


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(n, 2) / BUCKET)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    return bits, tables


def hyperplanes(dimensions: int, count: int, kind: int) -> np.ndarray:
    return np.random.default_rng([SEED, kind, dimensions]).standard_normal((dimensions, count)).astype(np.float32)


def components_of_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Groups of vectors connected by pairs with a cosine of ``threshold`` or more, one row for each row: ``vec_id, component, keep, n_links``.

    ``component`` is the smallest vec_id of the group, and that row is the one kept. ``n_links``
    counts the other rows whose vectors are that similar to this one, equal vectors included.

    * A null embedding, an empty one, one with a null, NaN or infinite element, or one of length
      zero has no cosine: such a row is a component of its own, kept, with 0 links.
    * Vectors of different dimensions are never alike. Equal vectors always are; they are one
      node of the search, so thousands of copies cost one comparison. (Vectors are told apart by 64-bit hashes.)
    * Repeated rows are rows of their own; of one vec_id with different vectors each has its own group.
    * A null vec_id can't be reported: such rows are left out.
    * Only ``vec_id`` and ``embedding`` are read. An empty table gives no rows.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    usable = F.expr("size(v) > 0 and not exists(v, x -> x is null)") & (norm > 0) & (norm < float("inf"))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("v")))
    good = rows.where("node is not null")
    # one node for each distinct vector
    nodes = cut(good.groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("v").alias("v")))
    bits, tables = plan(nodes.count(), threshold)
    differ = math.acos(threshold) / math.pi
    most, most_first = (n * differ + slack * math.sqrt(n * differ * (1 - differ)) for n, slack in ((SIGNS, SLACK), (64, SLACK + 1)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for whole in batches:
            sizes = whole.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes):
                b = whole.filter(pa.array(sizes == d))
                x = b.column(1).flatten().to_numpy().reshape(-1, d)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # else products may overflow
                signs = np.packbits(x @ hyperplanes(int(d), SIGNS, 1) > 0, axis=1)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(signs.shape[1]), len(signs), [None, pa.py_buffer(np.ascontiguousarray(signs))]).cast(pa.binary())
                for t in range(tables):
                    own = ((x @ hyperplanes(int(d), tables * bits, 0)[:, t * bits : (t + 1) * bits] > 0) * power).sum(axis=1, dtype=np.uint64)
                    key = mix(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t << 32 | int(d)))
                    yield pa.record_batch([pa.array(key.view(np.int64)), b.column(0), raw], names=["key", "node", "signs"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, 3):
            group = np.cumsum(np.r_[True, np.logical_or.reduce([np.diff(b.column(k).to_numpy()) != 0 for k in range(3)])])
            signs = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            first = signs[:, 0].copy()

            def alike(x: np.ndarray, y: np.ndarray, signs: np.ndarray = signs, first: np.ndarray = first) -> np.ndarray:
                good = np.bitwise_count(first[x] ^ first[y]) <= most_first
                at = np.flatnonzero(good)
                good[at] = np.bitwise_count(signs[x[at]] ^ signs[y[at]]).sum(axis=1, dtype=np.int64) <= most
                return good

            src, dst = links_within(group, b.column(3).to_numpy(), alike)
            yield pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of each block, or of two of its chunks: links of each node, and stars of the pairs."""
        held: list[pa.RecordBatch] = []

        def solve() -> Iterator[pa.RecordBatch]:
            b = pa.concat_batches(held)
            node, times, part = b.column(4).to_numpy(), b.column(5).to_numpy(), b.column(3).to_numpy()
            x = b.column(6).flatten().to_numpy().astype(np.float64).reshape(len(node), -1)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            across = part.min() < part.max()
            links, stars_ = np.zeros(len(node), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for i in range(0, len(node), 512):
                alike = x[i : i + 512] @ x.T >= threshold - 1e-12
                alike &= (part[i : i + 512, None] != part) if across else (node[i : i + 512, None] != node)
                links[i : i + 512] = alike @ times
                at, to = np.nonzero(alike)
                stars_.append(stars(node[i + at], node[to]))
            some = links > 0
            none = pa.nulls(int(some.sum()), pa.int64())
            yield pa.record_batch([pa.array(node[some]), none, pa.array(links[some])], names=["node", "other", "links"])
            src, dst = stars(*(np.concatenate(c) for c in zip(*stars_, strict=True)))
            yield pa.record_batch([pa.array(src), pa.array(dst), pa.nulls(len(src), pa.int64())], names=["node", "other", "links"])

        last = None
        for b in batches:
            at = [b.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.r_[True, np.logical_or.reduce([np.diff(k) != 0 for k in at])])
            for i, j in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                key = tuple(int(k[i]) for k in at)
                if key != last and held:
                    yield from solve()
                    held.clear()
                last = key
                held.append(b.slice(i, j - i))
        if held:
            yield from solve()
        release()

    order = ["key", "part_a", "part_b"]
    sent = nodes.select("node", "v").mapInArrow(keys, "key long, node long, signs binary")
    large = cut(sent.groupBy("key").agg(F.count("*").alias("total")).where(F.col("total") > chunk))
    if large.isEmpty():
        parts = sent.select("key", F.lit(0).alias("part_a"), F.lit(0).alias("part_b"), "node", "signs")
    else:
        parts = sent.join(large, "key", "left_anti").select("key", F.lit(0).alias("part_a"), F.lit(0).alias("part_b"), "node", "signs")
        parts = parts.unionByName(chunk_pairs(sent, "key", large, chunk, F.xxhash64("node")).select(*order, "node", "signs"))
    edges = parts.repartition(*order).sortWithinPartitions(*order).mapInArrow(near, "src long, dst long")
    members = nodes.join(components(edges), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("total"))
    order = ["component", "part_a", "part_b"]
    blocks = chunk_pairs(members, "component", sizes, chunk, F.xxhash64("node")).select(*order, "part", "node", "times", "v")
    found = cut(blocks.repartition(*order).sortWithinPartitions(*order).mapInArrow(exact, "node long, other long, links long"))
    groups = components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("_links"))
    wide = nodes.select("node", "vec_id", "times").join(groups, "node", "left").join(links, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    low = wide.groupBy("_group").agg(F.min("vec_id").alias("_low"))
    of = wide.join(low, "_group").select("node", "_low", (F.coalesce("_links", F.lit(0)) + F.col("times") - 1).alias("_n"))
    labelled = rows.select("vec_id", "node").join(of, "node", "left")
    return labelled.select("vec_id", F.coalesce("_low", "vec_id").alias("component"), (F.coalesce("_low", "vec_id") == F.col("vec_id")).alias("keep"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of_embeddings(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE pairs AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b
  ON list_cosine_similarity(a.embedding, b.embedding) >= {THRESHOLD} AND a.vec_id <> b.vec_id),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, least(vec_id, coalesce(m, vec_id)) AS component, least(vec_id, coalesce(m, vec_id)) = vec_id AS keep, coalesce(n, 0) AS n_links
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN degree ON degree.x = vec_id
"""
