"""N-gram Jaccard self-join by signature trees.

A block is a set of documents that may be alike; within it the join is exact. Its documents,
ordered by size, are the leaves of a tree whose nodes hold the OR of their token bitmaps (one
bit for each n-gram that at least two of the block's documents have, so that bitmaps don't
saturate and a leaf pair's common bits are its exact overlap) and the range of their sizes. A
dual traversal from the root prunes pairs of nodes whose largest possible overlap, or whose
ratio of sizes, can't reach the threshold. A tree whose bitmaps would take too much memory is
cut in halves by size, and the halves are joined with themselves and each other.

Blocks come from the whole table without comparing all pairs. Documents with equal n-gram sets
are one node. Nodes that agree on any of 64 bands of three minimum hashes share a bucket, and are
linked if their 192 minimum hashes leave the threshold possible; connected nodes are a block.
First each node of a bucket is compared with the bucket's first and its previous node. A bucket
that these links leave in several parts is compared whole, pairs of one part left out. Buckets
too large for that are made by a passage that many texts share; among their nodes a prefix filter
decides: of two sets at the threshold, the rarest n-grams of both, half of each set, share one.
At a Jaccard similarity of 0.5, 0.02 % of pairs agree on no band; at 0.6 and more, 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents
from .groups import chunk_pairs, components, likely, links_within, stars, whole_groups
from .tokens import SPACE, Words, mix, release, rolling, slices, span_hashes, text_bytes

THRESHOLD = 0.5
GRAM = 3
BANDS, ROWS = 64, 3
LEAF, FAN_OUT = 8, 8
#: Standard deviations by which an estimated similarity may fall short of the threshold.
SLACK = 4.0
#: Nodes of a bucket that are compared with each other by one task; larger buckets take the prefix filter.
BUCKET = 2048
#: N-grams of a block, or of a chunk of a larger block, that one task holds twice.
BLOCK_GRAMS = 1 << 20
#: Bytes of a tree's bitmaps.
BITMAP_BYTES = 32 << 20

_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BREAK = SPACE.copy()
_BREAK[:128] = True
_BREAK[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False


def gram_sets(texts: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each lower-case text, sorted, one text after another; n+1 offsets."""
    w = Words.__new__(Words)
    w.data, w.offsets = text_bytes(texts)
    solid = ~_BREAK[w.data]
    n = len(solid)
    edge = np.zeros(n + 1, bool)
    edge[w.offsets] = True
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends[:-1] &= ~solid[1:] | edge[1:n]
    w.begin, w.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    w.first = np.searchsorted(w.begin, w.offsets)
    words = span_hashes(w.data, w.begin, w.end)
    counts = w.counts
    hashes, owners = [], []
    for size in range(1, gram + 1):  # a text of fewer words has one gram, of all of them
        g = rolling(words, size) ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)
        long = counts >= gram if size == gram else counts == size
        windows = np.where(long, counts - size + 1, 0)
        before = np.cumsum(windows) - windows
        at = np.repeat(w.first[:-1] - before, windows) + np.arange(windows.sum())
        hashes.append(g[at] if len(at) else np.empty(0, np.uint64))
        owners.append(np.repeat(np.arange(len(counts)), windows))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])][: len(h)]
    h, o = h[fresh], o[fresh]
    return h, np.searchsorted(o, np.arange(len(counts) + 1))


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty set."""
    starts = first[:-1]
    return mix(np.add.reduceat(mix(h + np.uint64(0xA5A5A5A5)), starts) ^ (np.bitwise_xor.reduceat(mix(h), starts) << np.uint64(1)) ^ np.diff(first).astype(np.uint64))


def sketches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: a 64-bit fingerprint, band keys (sets x bands), and 8 bits of each minimum hash."""
    starts = first[:-1]
    mark = fingerprints(h, first)
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    for k in range(BANDS * ROWS):
        v = x * _FACTORS[k]
        v ^= _SHIFTS[k]
        least[k] = np.minimum.reduceat(v, starts)
    keys = np.empty((BANDS, len(starts)), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0xD1342543DE82EF95) + least[b * ROWS + r])
        keys[b] = key
    return mark, keys.T, (least.T ^ (least.T >> np.uint32(16))).astype(np.uint8)


def overlap_needed(threshold: float, sizes: np.ndarray) -> np.ndarray:
    """The overlap that sets whose sizes sum to ``sizes`` need at least."""
    return np.ceil(threshold / (1 + threshold) * sizes - 1e-9)


class SignatureTree:
    """Levels from the documents up; each has OR bitmaps and size ranges, groups of FAN_OUT (LEAF lowest) nodes under one parent."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        self.order = np.argsort(size, kind="stable")
        flat = np.concatenate([sets[i] for i in self.order])
        owner = np.repeat(np.arange(len(sets)), size[self.order])
        _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        shared = times[token] > 1
        self.words = max(1, -(-int((times > 1).sum()) // 64))
        self.bytes = 8 * self.words * len(sets)
        self.tokens = number[token[shared]], owner[shared], size

    def grow(self) -> None:
        """Makes the bitmaps."""
        (token, owner, size), words, n = self.tokens, self.words, len(self.order)
        bitmap = np.zeros(n * words, np.uint64)
        np.bitwise_or.at(bitmap, owner * words + (token >> 6), np.uint64(1) << (token & 63).astype(np.uint64))
        low = size[self.order]
        self.levels = [(bitmap.reshape(n, words), low, low)]
        self.steps: list[int] = []
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            bitmap, low, high = self.levels[-1]
            at = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
            self.steps.append(step)
            step = FAN_OUT

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of nodes may hold a pair at the threshold, and the largest overlap each can have."""
        bitmap, low, high = self.levels[level]
        most = np.empty(len(a), np.int64)
        block = max(1, (1 << 20) // bitmap.shape[1])  # words worked on at once
        for i in range(0, len(a), block):
            most[i : i + block] = np.bitwise_count(bitmap[a[i : i + block]] & bitmap[b[i : i + block]]).sum(axis=1, dtype=np.int64)
        ratio = np.minimum(high[a], high[b]) >= np.maximum(low[a], low[b]) * threshold - 1e-9
        return ratio & (most >= overlap_needed(threshold, low[a] + low[b])), most

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of documents, by their index in ``sets``, and their overlap; depth first over blocks of node pairs."""
        stack = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                a, b = a[a != b], b[a != b]
            good, most = self.possible(level, a, b, threshold)
            a, b = a[good], b[good]
            if not len(a):
                continue
            if level == 0:
                yield self.order[a], self.order[b], most[good]
                continue
            step, n = self.steps[level - 1], len(self.levels[level - 1][1])
            for i in range(0, len(a), 4096):
                x = (a[i : i + 4096, None, None] * step + np.arange(step)[None, :, None]) + np.zeros((1, 1, step), np.int64)
                y = (b[i : i + 4096, None, None] * step + np.arange(step)[None, None, :]) + np.zeros((1, step, 1), np.int64)
                x, y = x.ravel(), y.ravel()
                fine = (x <= y) & (y < n) & (x < n)
                stack.append((level - 1, x[fine], y[fine]))


def joined_sets(sets: list[np.ndarray], threshold: float, most_bytes: int = BITMAP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of ``sets`` by index, each once, and their overlap, where it may reach the threshold; trees of at most ``most_bytes``, or of two sets."""
    size = np.array([len(s) for s in sets])
    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.argsort(size, kind="stable"), None)]
    while stack:
        left, right = stack.pop()  # sets of left are no larger than those of right
        both = left if right is None else np.r_[left, right]
        if len(both) < 2 or right is not None and size[left[-1]] < threshold * size[right[0]] - 1e-9:
            continue
        tree = SignatureTree([sets[i] for i in both])
        if tree.bytes > most_bytes and len(both) > 2:
            half = len(left) // 2
            if right is None:
                stack += [(left[:half], None), (left[half:], None), (left[:half], left[half:])]
            elif len(left) > len(right):
                stack += [(left[:half], right), (left[half:], right)]
            else:
                half = len(right) // 2
                stack += [(left, right[:half]), (left, right[half:])]
            continue
        tree.grow()
        for i, j, o in tree.pairs(threshold):
            if right is not None:
                across = (i < len(left)) != (j < len(left))
                i, j, o = i[across], j[across], o[across]
            yield both[i], both[j], o


def block_pairs(sets: list[np.ndarray], threshold: float, most_bytes: int = BITMAP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs i, j of ``sets`` with a Jaccard similarity of ``threshold`` or more, each once, and the similarity."""
    size = np.array([len(s) for s in sets])
    for i, j, o in joined_sets(sets, threshold, most_bytes):
        s = o / (size[i] + size[j] - o)
        good = s >= threshold - 1e-12
        yield i[good], j[good], s[good]


def _nodes(docs: DataFrame, gram: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, "text", 2 << 20)):
            h, first = gram_sets(b.column(1), gram)
            some = np.flatnonzero(np.diff(first))
            if not len(some):
                continue
            mark, keys, low = sketches(h, np.r_[first[some], len(h)])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)))
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(low.shape[1]), len(low), [None, pa.py_buffer(np.ascontiguousarray(low))]).cast(pa.binary())
            n = pa.array(np.diff(first)[some].astype(np.int64))
            yield pa.record_batch([b.column(0).take(pa.array(some)), pa.array(mark.view(np.int64)), n, bands, bits], names=["doc_id", "node", "n_grams", "bands", "bits"])

    return _lower(docs).mapInArrow(sketch, "doc_id long, node long, n_grams long, bands array<long>, bits binary")


def _lower(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Rows with an id and a text, in lower case; with ``among(doc_id)`` those of its ids, and few others."""
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own if among is None else likely(own, "doc_id", among)
    return own.select("doc_id", F.lower("text").alias("text"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _with_grams(rows: DataFrame, gram: int, columns: str) -> DataFrame:
    """``rows(node, text, ...)`` with the text's n-gram set as bytes, ``grams``, in the text's place, last.

    Rows whose text isn't their node's are left out: another row of the doc_id may have another text.
    """
    rest = [c for c in rows.columns if c != "text"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, "text", 2 << 20)):
            h, first = gram_sets(b.column(len(rest)), gram)
            some = np.flatnonzero(np.diff(first))
            if not len(some):
                continue
            mark = np.zeros(b.num_rows, np.int64)
            mark[some] = fingerprints(h, np.r_[first[some], len(h)]).view(np.int64)
            own = some[mark[some] == b.column(rest.index("node")).to_numpy()[some]]
            at = pa.array(own)
            yield pa.record_batch([*(b.column(k).take(at) for k in range(len(rest))), pa.array([h[first[i] : first[i + 1]].tobytes() for i in own], pa.binary())], names=[*rest, "grams"])

    return rows.select(*rest, "text").mapInArrow(sets, f"{columns}, grams binary")


def _same(bits: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two arrays of minimum hashes leave the threshold possible."""
    n = bits.shape[1]
    share = (np.count_nonzero(bits == other, axis=1) / n - 1 / 256) * (256 / 255)
    return share >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / n)


class Candidates:
    """The nodes of a table, and the links that connect every two nodes that may be similar.

    ``members(doc_id, node)`` has each row; ``nodes(node, doc_id, times, n_grams, bands, bits)`` each distinct set.
    """

    def __init__(self, docs: DataFrame, threshold: float, gram: int, bucket: int):
        self.docs, self.threshold, self.gram, self.bucket = docs, threshold, gram, bucket
        rows = cut(_nodes(docs, gram))
        self.members = rows.select("doc_id", "node")
        parts = [F.first(c).alias(c) for c in ("n_grams", "bands", "bits")]
        self.nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"), *parts))
        self.bits = self.nodes.select("node", "bits")
        self.keyed = self.nodes.select("node", F.explode("bands").alias("key"))

    def neighbours(self) -> DataFrame:
        """Each node with the previous and the first one of its buckets, and whether the two may be similar: ``src, dst, ok``."""
        threshold, by_key = self.threshold, Window.partitionBy("key").orderBy("node")
        ends = self.keyed.select("node", F.array(F.lag("node").over(by_key), F.first("node").over(by_key)).alias("_others"))
        links = ends.select(F.col("node").alias("src"), F.explode("_others").alias("dst")).where("dst is not null and dst <> src").distinct()
        both = links.join(self.bits.select(F.col("node").alias("src"), "bits"), "src").join(self.bits.select(F.col("node").alias("dst"), F.col("bits").alias("other")), "dst")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(_same(_matrix(b.column(2)), _matrix(b.column(3)), threshold))], names=["src", "dst", "ok"])
            release()

        return cut(both.select("src", "dst", "bits", "other").mapInArrow(check, "src long, dst long, ok boolean"))

    def _compared(self, rows: DataFrame) -> DataFrame:
        """Links between all rows of ``rows(key, part_a, part_b, part, node, component, bits)`` that share the first three columns but no component."""
        threshold = self.threshold

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in whole_groups(batches, 3):
                keys = [b.column(k).to_numpy() for k in range(3)]
                group = np.cumsum(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
                bits = _matrix(b.column(5))
                src, dst = links_within(group, b.column(3).to_numpy(), lambda x, y, bits=bits: _same(bits[x], bits[y], threshold), b.column(4).to_numpy())
                yield pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])

        order = ["key", "part_a", "part_b"]
        # cut, so that components' Python doesn't run in the same tasks: each would hold two workers, whose memory stays
        return cut(rows.select(*order, "node", "component", "bits").repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "src long, dst long"))

    def _rare(self, hot: DataFrame) -> DataFrame:
        """``node, key`` for each n-gram in the rarest part of a set of ``hot(node)`` that another one of them has too.

        Sets x and y at the threshold t share t|x| n-grams at least, so that one of the first |x| - t|x| + 1 of x, in an
        order that holds for all sets, is among those of y.
        """
        of = cut(hot.join(self.nodes, "node").select("doc_id", "node"))
        texts = _lower(self.docs, of.select("doc_id")).join(of, "doc_id").select("node", "text")
        sets = _with_grams(texts, self.gram, "node long").dropDuplicates(["node"])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    h = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                    yield pa.record_batch([pa.array(np.full(len(h), b.column(0)[i].as_py())), pa.array(h)], names=["node", "key"])

        each = cut(sets.select("node", "grams").mapInArrow(unpack, "node long, key long"))
        often = each.groupBy("key").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "key"))
        wide = each.join(often, "key").join(self.nodes.select("node", "n_grams"), "node")
        return wide.withColumn("_rank", rank).where(f"_rank <= n_grams - ceil({self.threshold} * n_grams - 1e-9) + 1 and n > 1").select("node", "key")

    def _groups(self, keyed: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``keyed(node, key)`` with components, of keys whose nodes are in several; and the sizes of these keys."""
        wide = keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = wide.groupBy("key").agg(F.count("*").alias("total"), F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").drop("_low", "_high")
        return wide, cut(sizes)

    def edges(self) -> DataFrame:
        """``src, dst`` whose connected components hold together all pairs that may be similar."""
        near = self.neighbours()
        edges = near.where("ok").select("src", "dst")
        parts = components(edges)
        of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        open_ = near.where("not ok").join(of("src"), "src", "left").join(of("dst"), "dst", "left").where("coalesce(_src, src) <> coalesce(_dst, dst)")
        bands = lambda c: self.nodes.select(F.col("node").alias(c), F.col("bands").alias(f"_{c}_bands"))
        keys = cut(open_.select("src", "dst").join(bands("src"), "src").join(bands("dst"), "dst").select(F.explode(F.array_intersect("_src_bands", "_dst_bands")).alias("key")).distinct())
        if keys.isEmpty():
            return edges
        wide, sizes = self._groups(cut(likely(self.keyed, "key", keys).join(keys, "key").select("node", "key")), parts)
        small = wide.join(sizes.where(F.col("total") <= self.bucket), "key").join(self.bits, "node")
        edges = edges.unionByName(self._compared(small.withColumn("part_a", F.lit(0)).withColumn("part_b", F.lit(0))))
        large = sizes.where(F.col("total") > self.bucket)
        if large.isEmpty():
            return edges
        hot = wide.join(large, "key", "left_semi").select("node").distinct()
        wide, sizes = self._groups(self._rare(hot), parts)
        spread = chunk_pairs(wide.select("key", "node", "component"), "key", sizes, self.bucket, F.xxhash64("node"))
        return edges.unionByName(self._compared(spread.join(self.bits, "node")))

    def joined(self, pairs: bool = False, block_grams: int = BLOCK_GRAMS) -> DataFrame:
        """Exact results of all blocks: ``node, other, links, jaccard``.

        Rows with ``links`` give a node and how many documents of other nodes it is similar to; their sums count. Other rows
        connect two nodes of a class: stars of each task's pairs, or, with ``pairs``, all of them and their similarity.
        """
        blocks = components(self.edges())
        of = cut(self.nodes.select("node", "doc_id", "times", "n_grams").join(blocks, "node"))
        sizes = of.groupBy("component").agg(F.sum("n_grams").alias("total"))
        texts = _lower(self.docs, of.select("doc_id")).join(of.select("doc_id", "node", "times", "component"), "doc_id").select("component", "node", "times", "text")
        grams = _with_grams(texts, self.gram, "component long, node long, times long")
        order = ["component", "part_a", "part_b"]
        sent = chunk_pairs(grams, "component", sizes, block_grams, F.xxhash64("node")).select(*order, "part", "node", "times", "grams")
        threshold = self.threshold

        def solve(node: np.ndarray, part: np.ndarray, times: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            links = np.zeros(len(node), np.int64)
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            held, across = 0, part.min() < part.max()
            for i, j, s in block_pairs(sets, threshold):
                if across:
                    far = part[i] != part[j]
                    i, j, s = i[far], j[far], s[far]
                if pairs and len(i):
                    yield pa.record_batch([pa.array(node[i]), pa.array(node[j]), pa.nulls(len(i), pa.int64()), pa.array(s)], names=["node", "other", "links", "jaccard"])
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                if not pairs:
                    src.append(node[i])
                    dst.append(node[j])
                    held += len(i)
                    if held > 1 << 20:
                        a, b = stars(np.concatenate(src), np.concatenate(dst))
                        src, dst, held = [a], [b], 0
            some = links > 0
            a, b = stars(np.concatenate(src), np.concatenate(dst))
            yield pa.record_batch([pa.array(node[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(links[some]), pa.nulls(int(some.sum()), pa.float64())], names=["node", "other", "links", "jaccard"])
            yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.float64())], names=["node", "other", "links", "jaccard"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by block, pair of chunks and node."""
            last, rows = None, []
            for b in batches:
                keys = [b.column(k).to_pylist() for k in range(3)]
                for key, *row in zip(zip(*keys, strict=True), *(b.column(k).to_pylist() for k in range(3, 7)), strict=True):
                    if key != last:
                        yield from finish(rows)
                        last, rows = key, []
                    if not rows or rows[-1][1] != row[1]:  # a repeated row of the doc_id
                        rows.append(row)
            yield from finish(rows)
            release()

        def finish(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                part, node, times, grams_ = zip(*rows, strict=True)
                yield from solve(np.array(node), np.array(part), np.array(times), [np.frombuffer(g, np.uint64) for g in grams_])

        return cut(sent.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(join, "node long, other long, links long, jaccard double"))


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, bucket: int = BUCKET, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Classes of documents connected by a Jaccard similarity of ``threshold`` or more, one row for each row of ``docs``: ``doc_id, class_id, n_links``.

    A document is the set of its runs of ``gram`` words, lower case; words are what white space
    and ASCII punctuation separate. A text of fewer words is the set of one gram, all its words.
    ``class_id`` is the smallest doc_id of the class; ``n_links`` counts the other documents that
    are similar to this one, its copies included. Links are counted, not written out, so that a
    class of a million copies takes a million rows.

    * A row with a null doc_id can't be reported: it is left out, and no link counts it.
    * A null text, and a text without a word, is similar to nothing: a class of its own, 0 links.
    * Equal sets have similarity 1. Repeated rows, and rows that share a doc_id, are documents of their own.
    * Texts are processed whole. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
    """
    found = Candidates(docs, threshold, gram, bucket)
    result = found.joined(block_grams=block_grams)
    groups = components(result.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    links = result.where("links is not null").groupBy("node").agg(F.sum("links").alias("_links"))
    nodes = found.nodes.select("node", "doc_id", "times").join(groups, "node", "left").join(links, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    low = nodes.groupBy("_group").agg(F.min("doc_id").alias("class_id"))
    node_rows = nodes.join(low, "_group").select("node", "class_id", (F.coalesce("_links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    rows = found.members.join(node_rows, "node").select("doc_id", "class_id", "n_links")
    return rows.unionByName(_wordless(docs).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _wordless(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id whose text is null or has no word: nothing but white space and ASCII punctuation."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where(r"text is null or not text rlike '[^\\x00-/:-`{-\\x7f]'").select("doc_id")


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, bucket: int = BUCKET, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Pairs of different sets at the threshold, each by the smallest doc_id that has it: ``doc_id_a < doc_id_b, jaccard`` (6 digits).

    With ``similar_classes``'s rules; which documents have equal sets isn't repeated here. No doc_id is paired with itself.
    """
    found = Candidates(docs, threshold, gram, bucket)
    pairs = found.joined(True, block_grams).where("jaccard is not null")
    ends = lambda node, c: found.nodes.select(F.col("node").alias(node), F.col("doc_id").alias(c))
    both = pairs.join(ends("node", "x"), "node").join(ends("other", "y"), "other").where("x <> y")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), F.round("jaccard", 6).alias("jaccard"))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each group connected by pairs at the threshold.

    Rows with a null doc_id or text, or a text without a word, stay. Of repeated rows one stays
    only if their texts' group keeps them: a doc_id is dropped or kept as a whole, so rows that
    share the kept doc_id all stay. Columns pass unchanged. An empty table gives an empty one.
    """
    found = Candidates(docs, threshold, gram, BUCKET)
    result = found.joined().where("other is not null")
    groups = components(result.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    labelled = found.members.join(groups, "node", "left").select("doc_id", F.coalesce("component", "node").alias("_group"))
    ranked = labelled.join(labelled.groupBy("_group").agg(F.min("doc_id").alias("_kept")), "_group")
    gone = ranked.where("doc_id <> _kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x00-/:-`{{-\\x7f]+'), lambda x: x <> '') AS w FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + {GRAM}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {GRAM - 1}, 1))) AS p FROM split WHERE len(w) > 0)),
sized AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM grams),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n + b.n) AS total, count(*) AS o
           FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT x, y FROM common WHERE o >= {THRESHOLD} * (total - o)),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(n, 0) AS n_links
FROM documents LEFT JOIN low ON low.x = doc_id LEFT JOIN degree ON degree.x = doc_id WHERE doc_id IS NOT NULL
"""
