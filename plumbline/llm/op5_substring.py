"""Substring deduplication by Rabin-Karp hashes of every window of words.

Every window's 64-bit hash is sent once, in compact blocks by hash bucket, with its document
and position beside it; hashes are counted in the bucket's task, and positions of those that occur
more than once return to their document, where they merge into maximal intervals. The shuffle
takes about ten bytes a window, and no set of hashes is ever broadcast.

Windows that repeat within a slice of texts are known there already: their positions go straight
to their documents and one of them is sent on for all. So a window that a third of all texts
have is sent once for each slice, and a bucket's task holds a share of the table that doesn't
depend on how often a window occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, documents
from .tokens import Words, planes, release, rolling, slices, unplanes, window_starts

WINDOW = 50

def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal intervals covered by windows of ``window`` words that occur more than once in the table: ``doc_id, start_word, end_word, n_words``.

    Words are runs of characters other than ASCII white space, compared exactly; ``end_word``
    is exclusive. Every occurrence is reported, the first one too, within one text or in
    several; overlapping or touching windows make one interval.

    * Rows with a null doc_id or a null text are left out. A text of fewer than ``window``
      words, the empty one too, has no window.
    * Rows that share a doc_id count as that many texts; their intervals are united under the id.
    * Very long texts are processed whole. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
    """
    partitions = buckets(docs.sparkSession, 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, "text")):
            w = Words(b.column(1))
            at = window_starts(w.first, window)
            if not len(at):
                continue
            h = rolling(w.hashes(), window)[at]
            owner = w.owner()[at]
            position = at - w.first[owner]
            ids = b.column(0).to_numpy()
            again, spare = _repeated(h)
            if again.any():
                doc, lists = _lists(owner[again], position[again])
                none = pa.nulls(len(doc), pa.binary())
                yield pa.record_batch([pa.array(np.full(len(doc), -1)), pa.array(ids[doc]), lists, none, none, none, none], schema=sent_schema)
            h, owner, position = h[~spare], owner[~spare], position[~spare]
            bucket = (h >> np.uint64(33)) % np.uint64(partitions)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            h, owner, position, bucket = h[order], owner[order], position[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            rows: list[tuple] = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                o = owner[i:j]
                new = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                step = np.diff(position[i:j], prepend=0)
                step[new] = position[i:j][new]
                rows.append((int(bucket[i]), None, None, ids[o[new]].tobytes(), planes(np.diff(np.r_[new, j - i])), planes(step), h[i:j].tobytes()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sent_schema, strict=True)], schema=sent_schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions of the bucket's repeated windows, by document; what is known already passes."""
        ids, counts, steps, hashes = [], [], [], []
        for b in batches:
            known = b.filter(b.column(1).is_valid())
            if known.num_rows:
                yield known.select([1, 2])
            for i, c, s, h in zip(*(b.filter(b.column(1).is_null()).column(k).to_pylist() for k in range(3, 7)), strict=True):
                ids.append(np.frombuffer(i, np.int64))
                counts.append(unplanes(c))
                steps.append(unplanes(s))
                hashes.append(np.frombuffer(h, np.uint64))
        if not hashes:
            return
        h, n, step = np.concatenate(hashes), np.concatenate(counts).astype(np.int64), np.concatenate(steps).astype(np.int64)
        del hashes, counts, steps
        again, _ = _repeated(h)
        total, first = np.cumsum(step), np.cumsum(n) - n
        position = (total - np.repeat(total[first] - step[first], n))[again]
        doc = np.repeat(np.concatenate(ids), n)[again]
        order = np.lexsort((position, doc))
        doc, position = doc[order], position[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]
        for k in range(0, len(cuts) - 1, 10_000):
            part = slice(cuts[k], cuts[min(k + 10_000, len(cuts) - 1)])
            own, lists = _lists(doc[part], position[part])
            if len(own):
                yield pa.record_batch([pa.array(own), lists], names=["doc_id", "steps"])
        release()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by doc_id; the last document of a batch is held, and what is held grows with a text's length alone."""
        doc, position = np.empty(0, np.int64), np.empty(0, np.int64)

        def closed(doc: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
            fresh = np.r_[True, (np.diff(doc) != 0) | (np.diff(position) > window)]
            new = np.flatnonzero(fresh)
            end = position[np.r_[new[1:] - 1, len(doc) - 1]] + window
            return pa.record_batch([pa.array(doc[new]), pa.array(position[new]), pa.array(end)], names=["doc_id", "start_word", "end_word"])

        for b in batches:
            lists = b.column(1)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            step = lists.flatten().to_numpy().astype(np.int64)
            total, first = np.cumsum(step), np.cumsum(n) - n
            position = np.r_[position, total - np.repeat(total[first] - step[first], n)]
            doc = np.r_[doc, np.repeat(b.column(0).to_numpy(), n)]
            order = np.lexsort((position, doc))
            doc, position = doc[order], position[order]
            one = np.r_[True, (np.diff(doc) != 0) | (np.diff(position) != 0)]
            doc, position = doc[one], position[one]
            stop = int(np.searchsorted(doc, doc[-1]))
            if stop:
                yield closed(doc[:stop], position[:stop])
                doc, position = doc[stop:], position[stop:]
                release()
        if len(doc):
            yield closed(doc, position)

    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent_schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("steps", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("ids", "counts", "positions", "hashes"))])
    sent = known.mapInArrow(send, "bucket long, doc_id long, steps array<int>, ids binary, counts binary, positions binary, hashes binary")
    # positions that are known already take the partition of their document's hash
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc_id"), F.lit(partitions))).otherwise(F.col("bucket"))
    found = sent.repartitionById(partitions, place.cast("int")).mapInArrow(count, "doc_id long, steps array<int>")
    by_doc = found.repartition("doc_id").sortWithinPartitions("doc_id")
    return by_doc.mapInArrow(unite, "doc_id long, start_word long, end_word long").withColumn("n_words", F.expr("end_word - start_word"))


def _lists(doc: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Each document once, and its positions as a first one and steps; rows of a document lie side by side, in ascending order."""
    new = np.flatnonzero(np.r_[True, np.diff(doc) != 0][: len(doc)])
    step = np.diff(position, prepend=0)
    step[new] = position[new]
    return doc[new], pa.ListArray.from_arrays(pa.array(np.r_[new, len(doc)].astype(np.int32)), pa.array(step.astype(np.int32)))


def _repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur more than once, and which of them are all but one of their value."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    again, spare = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order] = np.r_[same, False] | np.r_[False, same]
    spare[order] = np.r_[False, same]
    return again, spare


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT doc_id, p, array_to_string(words[p + 1 : p + {WINDOW}], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - {WINDOW - 1}, 0))) AS p FROM split)),
again AS (SELECT body FROM windows GROUP BY body HAVING count(*) > 1),
starts AS (SELECT DISTINCT doc_id, p FROM windows SEMI JOIN again USING (body)),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM starts),
islands AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked)
SELECT doc_id, min(p) AS start_word, max(p) + {WINDOW} AS end_word, max(p) + {WINDOW} - min(p) AS n_words
FROM islands GROUP BY doc_id, island
"""
