"""Exact deduplication by Grace hashing.

Texts are partitioned by a 64-bit hash in one shuffle. Each partition is partitioned again, to
spill files in the shared folder and by further bits of the hash, until a bucket's distinct
texts fit a bounded open-addressing table. The table compares complete texts, so equal hashes
alone never make a duplicate. Copies within one Arrow batch are combined before the shuffle:
a text with a billion copies sends each batch's list of ids and one text. The table holds at most
IDS ids of a text; more leave the task in lists, under a number that the text gets, and meet the
text's smallest id and number of copies in a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, shared_dir

FAN_OUT_BITS = 4
BUCKET_BYTES = 64 << 20
#: Ids of a text that are held; a Python integer in a list takes about 40 bytes.
IDS = 4096
ID_BYTES = 40

#: Hash, content, ids held, number of ids in all, the smallest (None: no id but nulls), number under which ids were given out (-1: none were).
Record = tuple[int, bytes, list, int, int | None, int]


def _lower(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class OpenTable:
    """Open addressing with linear probing; a slot matches on the hash and then on the complete content."""

    def __init__(self, slots: int = 1 << 10):
        self.slot = np.full(slots, -1, np.int64)
        self.hash: list[int] = []
        self.content: list[bytes] = []
        self.ids: list[list] = []
        self.n: list[int] = []
        self.low: list[int | None] = []
        self.number: list[int] = []
        self.bytes = 0

    def _find(self, h: int, content: bytes) -> tuple[int, int]:
        slot, mask = self.slot, len(self.slot) - 1
        at = h & mask
        while (k := int(slot[at])) >= 0:
            if self.hash[k] == h and self.content[k] == content:
                return at, k
            at = (at + 1) & mask
        return at, -1

    def add(self, h: int, content: bytes, ids: list, n: int | None = None, low: int | None = None, number: int = -1) -> int:
        """Adds a record, by default one whose ids are all in ``ids``; returns the content's index."""
        if n is None:
            n, low = len(ids), min((i for i in ids if i is not None), default=None)
        at, k = self._find(h, content)
        self.bytes += ID_BYTES * len(ids)
        if k >= 0:
            self.ids[k] += ids
            self.n[k] += n
            self.low[k] = _lower(self.low[k], low)
            self.number[k] = max(self.number[k], number)
            return k
        k = len(self.hash)
        self.slot[at] = k
        self.hash.append(h)
        self.content.append(content)
        self.ids.append(list(ids))
        self.n.append(n)
        self.low.append(low)
        self.number.append(number)
        self.bytes += len(content) + 200
        if 10 * len(self.hash) > 6 * len(self.slot):
            self._grow()
        return k

    def give(self, k: int) -> list:
        """The ids held of a content, which are no longer held."""
        ids, self.ids[k] = self.ids[k], []
        self.bytes -= ID_BYTES * len(ids)
        return ids

    def _grow(self) -> None:
        self.slot = np.full(2 * len(self.slot), -1, np.int64)
        mask = len(self.slot) - 1
        for k, h in enumerate(self.hash):
            at = h & mask
            while self.slot[at] >= 0:
                at = (at + 1) & mask
            self.slot[at] = k

    def records(self) -> Iterator[Record]:
        return zip(self.hash, self.content, self.ids, self.n, self.low, self.number, strict=True)


class Spill:
    """Spill files of one task attempt in the shared folder; each is removed once read."""

    SCHEMA = pa.schema([("h", pa.uint64()), ("content", pa.large_binary()), ("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("low", pa.int64()), ("number", pa.int64())])

    def __init__(self, folder: str):
        self.fs, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.path = f"{path}/grace-{uuid.uuid4().hex}"
        self.files = 0

    def write(self, parts: int, records: Iterable[Record], part_of, block: int = 8 << 20) -> list[str]:
        self.fs.create_dir(self.path, recursive=True)
        paths = [f"{self.path}/{self.files + i}" for i in range(parts)]
        self.files += parts
        sinks = [self.fs.open_output_stream(p) for p in paths]
        writers = [pa.ipc.new_stream(s, self.SCHEMA) for s in sinks]
        held: list[list[Record]] = [[] for _ in range(parts)]
        size = [0] * parts

        def flush(i: int) -> None:
            if held[i]:
                writers[i].write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held[i], strict=True), self.SCHEMA, strict=True)], schema=self.SCHEMA))
                held[i], size[i] = [], 0

        for r in records:
            i = part_of(r[0])
            held[i].append(r)
            size[i] += len(r[1]) + ID_BYTES * len(r[2])
            if size[i] > block // parts:
                flush(i)
        for i in range(parts):
            flush(i)
            writers[i].close()
            sinks[i].close()
        return paths

    def read(self, path: str) -> Iterator[Record]:
        with self.fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as stream:
            for batch in stream:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        self.fs.delete_file(path)

    def close(self) -> None:
        if self.files:
            self.fs.delete_dir(self.path)


def grace(records: Iterator[Record], spill: Spill, most_bytes: int, give: Callable[[OpenTable, int], None], most_ids: int = IDS, level: int = 0) -> Iterator[OpenTable | None]:
    """Tables that together hold every distinct content once, each of about ``most_bytes`` at most.

    ``give(table, k)`` is called where a content has more than ``most_ids`` ids, and takes them; None
    then comes in a table's stead, so that what was taken can be sent on. Bits are
    taken from the top of the hash, since the table's slots use the low ones. Past the last bit
    only contents of one hash are left, and they share a table whatever its size.
    """
    held = OpenTable()
    for r in records:
        k = held.add(*r)
        if len(held.ids[k]) > most_ids:
            give(held, k)
            yield None
        if held.bytes > most_bytes and (level + 1) * FAN_OUT_BITS <= 64 and len(held.hash) > 1:
            break
    else:
        yield held
        return
    shift, mask = 64 - (level + 1) * FAN_OUT_BITS, (1 << FAN_OUT_BITS) - 1

    def everything() -> Iterator[Record]:
        yield from held.records()
        for r in records:
            yield r if len(r) == 6 else (*r, len(r[2]), min((i for i in r[2] if i is not None), default=None), -1)

    paths = spill.write(1 << FAN_OUT_BITS, everything(), lambda h: (h >> shift) & mask)
    held = None
    for p in paths:
        yield from grace(spill.read(p), spill, most_bytes, give, most_ids, level + 1)


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_ids: int = IDS) -> DataFrame:
    """One row for each document whose complete text an earlier one has: ``doc_id, kept_doc_id, n_copies``.

    The kept one is the smallest doc_id of the group; ``n_copies`` is the group's size.

    * A null text equals nothing: such a row is never a duplicate. The empty text equals itself.
    * A null doc_id sorts last in its group, so it is removed before any row with an id; it is
      reported with a null doc_id. ``kept_doc_id`` is null only where the whole group's ids are.
    * Repeated rows are copies too: of a doc_id that occurs twice with one text, one is kept
      and the other is reported as ``(doc_id, the same doc_id)``.
    * Only ``doc_id`` and ``text`` are read; other columns, whatever their names, play no part.
    * An empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "kept_doc_id", "n_copies", "h", "number")] + [("ids", pa.list_(pa.int64()))])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = OpenTable()
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t.add(xxhash.xxh3_64_intdigest(text), text, [doc_id])
            hashes = pa.array(np.array(t.hash, np.uint64).view(np.int64))
            yield pa.record_batch([hashes, pa.array(t.content, pa.binary()), pa.array(t.ids, pa.list_(pa.int64()))], names=["h", "content", "ids"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``doc_id, kept_doc_id, n_copies``; and of texts of many copies ``h, number, ids``, and ``h, number, kept_doc_id, n_copies``."""
        out: list[tuple] = []
        numbers = count()

        def records() -> Iterator[Record]:
            for b in batches:
                yield from zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

        def signed(h: int) -> int:
            return h - (1 << 64) if h >> 63 else h

        def give(t: OpenTable, k: int) -> None:
            if t.number[k] < 0:
                t.number[k] = next(numbers)
            out.append((None, None, None, signed(t.hash[k]), t.number[k], t.give(k)))

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        spill = Spill(folder)
        try:
            for t in grace(records(), spill, bucket_bytes, give, most_ids):
                if t is None:
                    if len(out) >= 64:
                        yield batch()
                    continue
                for k, n in enumerate(t.n):
                    if n < 2:
                        continue
                    if t.number[k] < 0:
                        ids = sorted(t.ids[k], key=lambda x: (x is None, x))
                        out.extend((i, ids[0], n, None, None, None) for i in ids[1:])
                    else:
                        give(t, k)
                        out.append((None, t.low[k], n, signed(t.hash[k]), t.number[k], None))
                    if len(out) > 10_000:
                        yield batch()
                if out:
                    yield batch()
        finally:
            spill.close()

    sent = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(combine, "h long, content binary, ids array<long>")
    found = cut(sent.repartition("h").mapInArrow(groups, "doc_id long, kept_doc_id long, n_copies long, h long, number long, ids array<long>"))
    few = found.where("number is null").select("doc_id", "kept_doc_id", "n_copies")
    total = found.where("number is not null and ids is null").select("h", "number", "kept_doc_id", "n_copies")
    every = found.where("ids is not null").select("h", "number", F.explode("ids").alias("doc_id")).join(total, ["h", "number"])
    others = every.where("not doc_id <=> kept_doc_id").select("doc_id", "kept_doc_id", "n_copies")
    again = every.where("doc_id <=> kept_doc_id").groupBy("h", "number", "doc_id", "kept_doc_id", "n_copies").agg(F.count("*").alias("_n")).where("_n > 1")
    again = again.select(F.explode(F.sequence(F.lit(2), F.col("_n"))), "doc_id", "kept_doc_id", "n_copies").drop("col")
    return few.unionByName(others).unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


SQL = """
SELECT doc_id, kept_doc_id, n_copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id, count(*) OVER (PARTITION BY text) AS n_copies,
         row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS nth
  FROM documents WHERE text IS NOT NULL)
WHERE nth > 1
"""
