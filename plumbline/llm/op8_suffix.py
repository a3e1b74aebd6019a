"""Suffix-array deduplication: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A transform of the whole corpus can't be distributed, so the corpus is cut into texts that can
be treated alone without losing a repeat. Each run of windows of ``window`` words whose smallest
16-gram hash lies at the same place goes to the partition of that hash, its key; equal windows
have equal smallest hashes, so both ends of every repeat meet. Runs are combined before anything
is sent: a run of the same content as another is repeated as a whole, and of each content one run
is compared with the other contents of its key. Keys of one content need no comparison.

In a partition the runs, each closed by a separator of its own, form one text; its suffix order
gives the transform, and breadth-first backward extension from the empty string sets
common-prefix lengths in increasing order. It stops at ``window``: what is still unset there has a
longer common prefix, which is all that deduplication needs to know. A key of more contents than
one text should hold is split by its windows' own hashes, each window then being a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import op5_substring
from .common import cut, documents
from .tokens import Words, ranges, release, rolling, slices, span_hashes, window_starts

WINDOW = 50
GRAM = 16
CHUNK_BYTES = 16 << 20
#: Contents of a key that are compared in one text.
CONTENTS = 1 << 15


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the first minimum of every ``span`` consecutive values, by doubling."""
    at, have = np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be unique."""
    n = len(sequence)
    rank, step = sequence.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + int(sequence.max()) + 2) + second
        order = np.argsort(key)
        fresh = np.r_[False, key[order[1:]] != key[order[:-1]]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2
        if step >= n:
            raise ValueError("the last symbol isn't unique")


def bounded_prefixes(sequence: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Common-prefix lengths of neighbours in suffix order, those under ``bound``; -1 where it is ``bound`` or more.

    Entry i is for suffixes i-1 and i; entries 0 and n are 0. A level's intervals are those of
    all strings of one length; a whole level is extended at once. ``last`` finds, for each place
    of the transform, the next one of the same symbol, so that an interval's extension by a
    symbol is bounded by the first and the last place of that symbol within it.
    """
    n = len(sequence)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    to = place[order - 1]  # last-to-first mapping; order 0 wraps to the last symbol
    back = np.empty(n, np.int64)
    back[to] = np.arange(n)
    head = sequence[order]
    alike = np.r_[head[1:] == head[:-1], False]
    after = np.full(n, n, np.int64)
    before = np.full(n, -1, np.int64)
    i = np.flatnonzero(alike)
    after[back[i]] = back[i + 1]
    before[back[i + 1]] = back[i]
    length = np.full(n + 1, -1, np.int32)
    length[0] = length[n] = 0
    low, high = np.array([0]), np.array([n - 1])
    for level in range(bound):
        width = high - low + 1
        p = ranges(low, width)
        new_low = np.sort(to[p[before[p] < np.repeat(low, width)]])
        new_high = np.sort(to[p[after[p] > np.repeat(high, width)]])
        unset = length[new_high + 1] < 0
        if level == 0:
            unset |= new_high == n - 1
        low, high = new_low[unset], new_high[unset]
        length[high + 1] = np.where(length[high + 1] < 0, level, length[high + 1])
        if not len(low):
            break
    return length


def repeats(texts: pa.Array, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows in distinct ``texts``, of which the i-th occurs ``copies[i]`` times: text, first window, last window."""
    w = Words(texts)
    m, n = len(texts), len(w)
    _, symbol = np.unique(w.hashes(), return_inverse=True)
    at = np.arange(n) + w.owner()  # a separator follows each text
    sequence = np.empty(n + m, np.int64)
    sequence[at] = symbol + m
    ends = w.first[1:] + np.arange(m)
    sequence[ends] = np.arange(m)
    order = suffix_order(sequence)
    length = bounded_prefixes(sequence, order, window)
    long = np.zeros(n + m, bool)
    long[order] = (length[:-1] < 0) | (length[1:] < 0)
    starts = window_starts(w.first, window)
    owner = w.owner()[starts] if len(starts) else np.empty(0, np.int64)
    hit = long[at[starts]] | (copies[owner] > 1)
    starts, owner = starts[hit], owner[hit]
    if not len(starts):
        return starts, starts, starts
    offset = starts - w.first[owner]
    new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(starts) != 1)])
    return owner[new], offset[new], offset[np.r_[new[1:] - 1, len(starts) - 1]]


def suffix_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, contents: int = CONTENTS) -> DataFrame:
    """Maximal intervals of words covered by substrings of at least ``window`` words that occur more than once: ``doc_id, start_word, end_word, n_words``.

    Words and intervals are those of ``op5_substring``; every occurrence is reported, within one
    text or in several, and overlapping or touching ones make one interval.

    * Rows with a null doc_id or a null text are left out; texts of fewer than ``window`` words have no repeat.
    * Repeated rows count as that many texts; rows that share a doc_id have their intervals united.
    * Very long texts are processed whole. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
    """

    def spans_of(w: Words, owner: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of runs of ``n`` windows."""
        return w.begin[w.first[owner] + first], w.end[w.first[owner] + first + n + window - 2]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, "text")):
            w = Words(b.column(2))
            at = window_starts(w.first, window)
            if not len(at):
                continue
            grams = rolling(w.hashes(), gram)
            m = smallest(grams, window - gram + 1)[at]
            owner = w.owner()[at]
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (m[1:] != m[:-1])])
            first, n, key = (at - w.first[owner])[new], np.diff(np.r_[new, len(at)]), grams[m[new]].view(np.int64)
            owner = owner[new]
            body = span_hashes(w.data, *spans_of(w, owner, first, n)).view(np.int64)
            rows = pa.array(owner)
            yield pa.record_batch(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(key), pa.array(body), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["doc_id", "hash", "key", "body", "first", "n"],
            )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, "text")):
            w = Words(b.column(1))
            runs = b.column(2)
            counts = np.diff(runs.offsets.to_numpy())
            flat = runs.flatten()
            key, first, n = (flat.field(k).to_numpy() for k in range(3))
            once, large = (flat.field(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            owner = np.repeat(np.arange(b.num_rows), counts)
            if large.any():  # each window of a large key is a run, under a key of its own
                times = np.where(large, n, 1)
                which = np.repeat(np.arange(len(n)), times)
                first, n = ranges(first.astype(np.int64), times), np.where(large, 1, n)[which]
                owner, once, large = owner[which], once[which], large[which]
                begin, end = spans_of(w, owner, first, n)
                words = w.hashes()
                own = rolling(words, window)[w.first[owner] + first].view(np.int64)
                key = np.where(large, own, key[which])
            begin, end = spans_of(w, owner, first, n)
            sizes = end - begin
            for i in range(0, len(owner), 20_000):
                z = sizes[i : i + 20_000]
                data = w.data[ranges(begin[i : i + 20_000], z)]
                body = pa.Array.from_buffers(pa.binary(), len(z), [None, pa.py_buffer(np.r_[0, np.cumsum(z)].astype(np.int32)), pa.py_buffer(data)])
                ids = b.column(0).take(pa.array(owner[i : i + 20_000]))
                yield pa.record_batch([pa.array(key[i : i + 20_000]), ids, pa.array(first[i : i + 20_000].astype(np.int32)), pa.array(once[i : i + 20_000]), body], names=["key", "doc_id", "first", "once", "body"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole keys are gathered to texts of about CHUNK_BYTES.

        Of equal bodies, which only split keys have, each is repeated as a whole and given out at once.
        """
        held: dict[bytes, int] = {}
        texts: list[bytes] = []
        of: list[tuple] = []
        copies: list[int] = []
        size, last = 0, None
        out: list[tuple] = []

        def solve() -> pa.RecordBatch:
            t, low, high = repeats(pa.array(texts, pa.binary()), np.array(copies), window)
            ids, firsts, once = (np.array(c) for c in zip(*of, strict=True))
            mine = once[t] & (np.array(copies)[t] == 1)
            t, low, high = t[mine], low[mine], high[mine]
            return pa.record_batch([pa.array(ids[t]), pa.array(firsts[t] + low), pa.array(firsts[t] + high + window)], names=["doc_id", "s", "e"])

        def given() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "s", "e"])

        for b in batches:
            for key, doc_id, first, once, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last:
                    if size > CHUNK_BYTES:
                        yield solve()
                        texts, of, copies, size = [], [], [], 0
                        release()
                    held, last = {}, key
                k = held.get(body)
                if k is None:
                    held[body] = len(texts)
                    texts.append(body)
                    of.append((doc_id, first, once))
                    copies.append(1)
                    size += len(body)
                    continue
                for i, f in [(doc_id, first)] + [of[k][:2]] * (copies[k] == 1):
                    out.append((i, f, f + len(body.split())))
                copies[k] += 1
                if len(out) >= 10_000:
                    yield given()
                    out = []
        if texts:
            yield solve()
        if out:
            yield given()

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").where("doc_id is not null and text is not null")
    runs = known.mapInArrow(anchors, "doc_id long, hash long, key long, body long, first int, n int")
    one = F.min(F.struct("doc_id", "hash", "first", "n")).alias("_one")
    bodies = cut(runs.groupBy("key", "body").agg(F.count("*").alias("_times"), one))
    keys = bodies.groupBy("key").agg(F.count("*").alias("_bodies")).where("_bodies > 1")
    several = bodies.where("_times > 1").select("key", "body")
    whole = runs.join(several, ["key", "body"], "left_semi").select("doc_id", F.col("first").cast("long").alias("s"), (F.col("first") + F.col("n") + window - 1).cast("long").alias("e"))
    asked = bodies.join(keys, "key").select("_one.doc_id", "_one.hash", F.struct("key", "_one.first", "_one.n", (F.col("_times") == 1).alias("once"), (F.col("_bodies") > contents).alias("large")).alias("run"))
    by_doc = asked.groupBy("doc_id", "hash").agg(F.collect_list("run").alias("runs"))
    sent = known.join(by_doc, ["doc_id", "hash"]).select("doc_id", "text", "runs").mapInArrow(spans, "key long, doc_id long, first int, once boolean, body binary")
    found = sent.repartition("key").sortWithinPartitions("key").mapInArrow(expand, "doc_id long, s long, e long")
    return united(found.unionByName(whole))


def united(intervals: DataFrame) -> DataFrame:
    """``intervals(doc_id, s, e)`` with overlapping and touching ones joined."""
    ordered = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_fresh", F.when(F.col("s") <= reach, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "_island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select(
        "doc_id", "start_word", "end_word", F.expr("end_word - start_word").alias("n_words")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats(documents(spark, sf_dir))


#: The intervals are those of the windows of op5_substring, found another way.
SQL = op5_substring.SQL
