"""Links within groups of rows, groups cut into bounded pairs of chunks, and connected components.

Operators that seek similar rows need every similar pair, but not every pair written out: to
connect a group, its spanning forest is enough. So tasks compare all rows of a bounded group in
numpy and give out a star of each connected part, as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import release

#: Edges that are held at once before they are reduced to a forest, and that one task may finish.
HELD_EDGES = 1_000_000
#: Rows of sorted groups that are compared at once.
HELD_ROWS = 1 << 16
#: Bits of the bitmap that ``likely`` broadcasts, at most.
BITMAP_BITS = 1 << 25


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges ``a, b``, and the smallest node of its connected component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            break
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := label[label], label):
            label = up
    return ids, ids[label]


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars, ``src`` a node and ``dst`` its component's smallest node of this partition."""
    held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    n = 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n > HELD_EDGES:
            held, n = [stars(*(np.concatenate(c) for c in zip(*held, strict=True)))], 0
    src, dst = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
    for i in range(0, len(src), 100_000):
        yield pa.record_batch([pa.array(src[i : i + 100_000]), pa.array(dst[i : i + 100_000])], names=["src", "dst"])
    release()


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = HELD_EDGES) -> DataFrame:
    """Connected components of ``edges(src, dst)``: rows ``(node, component)``, the smallest node being the component.

    Each partition's edges are first reduced to stars. What is left is finished in one task where it
    is at most ``one_task`` rows. Else alternating large-star and small-star rounds follow, until a
    round changes nothing; each round's edges are checkpointed, so lineage stays short.
    Self loops keep their node as its own component; null ends and repeated edges are dropped.
    """
    pair = "src long, dst long"
    reduced = cut(edges.selectExpr("cast(src AS long) AS src", "cast(dst AS long) AS dst").where("src is not null and dst is not null").mapInArrow(forests, pair))
    if reduced.count() <= one_task:
        return cut(reduced.coalesce(1).mapInArrow(forests, pair)).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    nodes = reduced.select(F.col("src").alias("node")).distinct()
    e = reduced.where("src <> dst").distinct()
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m"))
        e = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.least("m", "src").alias("dst")).distinct()
        low = e.groupBy("src").agg(F.min("dst").alias("m"))
        joined = e.join(low, "src")
        e = joined.select("src", F.col("m").alias("dst")).unionByName(
            joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        ).distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(e.select(F.col("src").alias("node"), F.col("dst").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("component"))


def likely(rows: DataFrame, column: str, keys: DataFrame, most: int = BITMAP_BITS) -> DataFrame:
    """``rows`` whose ``column`` may be in ``keys``, a column of that name: all that are, and of others few.

    Before a join with ``keys`` it keeps rows that have no part in the join from being sent (not before a semi-join, which Spark would run first). What is broadcast is a
    bitmap of the keys' hashes, 16 bits a key and ``most`` bits in all; with more keys than that allows for, more of the others pass.
    """
    bits = min(most, 1 << (16 * keys.count() + 64).bit_length())
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))")  # 64 divides ``bits``
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_at", word)
    return marked.join(F.broadcast(words), F.col("_at") == F.col("_word")).where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def chunk_pairs(rows: DataFrame, key: str, sizes: DataFrame, most: int, spread: Column) -> DataFrame:
    """``rows`` with ``part_a <= part_b`` and ``part``: each group of ``key`` cut into chunks of about ``most``, each row sent to every pair of chunks that its own is in.

    ``sizes`` has a row ``(key, total)`` for each group, in the unit of ``most``; ``spread`` is a hash of the
    row. A group within ``most`` is one chunk and one pair. Every two rows of a group meet in the pair
    of their chunks, so a group of any size is compared whole by tasks of at most two chunks.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("total") / most)).cast("int")
    own = rows.join(sizes.select(key, n.alias("_parts")), key).withColumn("part", F.pmod(spread, F.col("_parts")).cast("int"))
    sent = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return sent.withColumn("part_a", F.least("part", "_other")).withColumn("part_b", F.greatest("part", "_other")).drop("_other", "_parts")


def links_within(group: np.ndarray, node: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are alike, of all pairs of neighbouring rows that have one ``group``: nodes of both ends, as stars.

    Rows of a group lie side by side. ``apart`` names a class of each row; rows of one class are known to be connected and aren't compared.
    """
    a, b = [], []
    at, step = np.arange(len(group)), 1
    while len(at := at[at < len(group) - step]):
        at = at[group[at] == group[at + step]]
        for i in range(0, len(at), 20_000):
            x = at[i : i + 20_000]
            x = x[node[x] != node[x + step]] if apart is None else x[apart[x] != apart[x + step]]
            x = x[alike(x, x + step)]
            a.append(node[x])
            b.append(node[x + step])
        step += 1
    return stars(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first ``keys`` columns, cut so that no group is in two of them."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(keys))

    def all_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.concat_batches(parts)

    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if held and n >= HELD_ROWS and key(b, b.num_rows - 1) != key(held[-1], held[-1].num_rows - 1):
            last = key(held[-1], held[-1].num_rows - 1)
            same = np.ones(b.num_rows, bool)
            for k in range(keys):
                same &= b.column(k).to_numpy() == last[k]
            stop = int(same.sum())
            yield all_of([*held, b.slice(0, stop)])
            held, n, b = [], 0, b.slice(stop)
        held.append(b)
        n += b.num_rows
    if held:
        yield all_of(held)
    release()
