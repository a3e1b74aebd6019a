"""SentencePiece encoding and decoding by a streaming Viterbi search.

The public vocabulary is a BPE model, so the best path isn't the one of the largest sum of
scores but the one whose neighbouring pieces BPE would leave side by side. Of every prefix of a
text that path is unique, and it extends the path of a shorter prefix by one piece that is
compatible with its last one. The search therefore keeps, for each boundary in a window of the
longest piece, the piece that ends there and its backpointer; whenever the paths of all
boundaries in the window meet at one boundary, the ids up to it are final and are given out.

Where no piece holds two characters side by side, such as a letter and then a space, every path
has a boundary, so there the paths meet and ids are committed: a batch is cut at these places, and
each distinct chunk is searched once and cached. A chunk within the window is given out at its end;
in a longer one paths are committed wherever they meet before.
Decoding gathers the bytes of all pieces of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free
from .tokens import ranges, release, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHED_CHUNKS = 250_000
CACHED_PAIRS = 400_000


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        self.id: dict[str, int] = {}
        self.text: dict[int, str] = {}
        self.rank: dict[str, float] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif i in self.special:
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.id[piece] = i
                self.text[i] = piece
                self.rank[piece] = -sp.get_score(i)
        self.longest = max(map(len, self.id))
        #: Pairs of neighbouring bytes that some piece holds; pairs with a byte that isn't ASCII count as held.
        self.beside = np.zeros((256, 256), bool)
        self.beside[128:] = self.beside[:, 128:] = True
        for raw in self.raw:
            self.beside[list(raw[:-1]), list(raw[1:])] = True
        #: By three characters, the lengths of the longer pieces that end in them.
        self.ends: dict[str, tuple[int, ...]] = {}
        for p in self.id:
            if len(p) > 2:
                self.ends[p[-3:]] = tuple(sorted({*self.ends.get(p[-3:], ()), len(p)}, reverse=True))
        self.pairs: dict[tuple[str, str], bool] = {}
        self._spines: dict[tuple[str, int], list[str] | None] = {}
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._coded: dict[str, bytes] = {}

    def merges(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging as such: the best-ranked, leftmost neighbouring pair first."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = self.rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side; without ``a``, whether it makes ``b``."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: str, b: str) -> bool:
        """Runs the merges next to the boundary in their order: those of ``a``'s last symbol, of ``b``'s first one, and across."""
        if not a or MARK + MARK in a or MARK + MARK in b:
            return self.merges([*a, *b]) == ([a, b] if a else [b])
        left, right = self._spine(a, -1), self._spine(b, 0)
        if left is None or right is None:
            return self.merges([*a, *b]) == [a, b]
        rank, i, j = self.rank, 0, 0
        while True:
            next_left = rank[left[i + 1]] if i + 1 < len(left) else float("inf")
            next_right = rank[right[j + 1]] if j + 1 < len(right) else float("inf")
            across = rank.get(left[i] + right[j])
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left == next_right == float("inf"):  # both are whole
                return True
            if next_left <= next_right:  # of equal ranks the left one is merged first
                i += 1
            else:
                j += 1

    def _spine(self, piece: str, side: int) -> list[str] | None:
        """The symbols that the piece's first (0) or last (-1) character grows into; None where their ranks don't rise."""
        key = (piece, side)
        if key not in self._spines:
            found, symbols = [piece[side]], list(piece)
            while len(symbols) > 1:
                known = [(r, i) for i in range(len(symbols) - 1) if (r := self.rank.get(symbols[i] + symbols[i + 1])) is not None]
                if not known:
                    break
                _, at = min(known)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                if symbols[side] != found[-1]:
                    found.append(symbols[side])
            ranks = [self.rank[x] for x in found[1:]]
            fine = symbols == [piece] and all(x < y for x, y in zip(ranks, ranks[1:], strict=False))
            self._spines[key] = found if fine else None
        return self._spines[key]

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.bytes[x] for x in piece.encode()]

    def coded(self, piece: str) -> bytes:
        known = self._coded.get(piece)
        if known is None:
            known = self._coded[piece] = np.array(self.ids_of(piece), np.int32).tobytes()
        return known

    def chunks(self, raws: list[bytes]) -> list[bytes]:
        """Ids (as bytes of 32-bit numbers) of each distinct chunk, from the cache or by a search.

        Chunks to search are sorted, so that one takes over the search of the prefix that it
        shares with the one before. The cache has two generations: when the younger is full it
        becomes the older, and what is used is young again.
        """
        young, old = self._young, self._old
        new = []
        for raw in raws:
            if raw not in young:
                if raw in old:
                    young[raw] = old[raw]
                else:
                    new.append(raw)
        new.sort()
        search, before = StreamingViterbi(self), ""
        for raw in new:
            text = raw.decode().replace(" ", MARK)
            if len(text) > 4 * self.longest:
                young[raw] = np.array(StreamingViterbi(self).encode(text), np.int32).tobytes()
                continue
            n, most = 0, min(len(text), len(before))
            while n < most and text[n] == before[n]:
                n += 1
            young[raw] = search.restarted(n, text)
            before = text
        out = [young[raw] for raw in raws]
        if len(young) >= CACHED_CHUNKS:
            self._young, self._old = {}, young
        return out


class StreamingViterbi:
    """Feed characters; ids come out as soon as every surviving path shares them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # characters that aren't given out, and before them as many as the longest piece has
        self.piece: list[str] = [""]  # the piece that ends at each boundary of ``text``; its length is the backpointer
        self.done = 0  # boundary in ``text`` up to which ids were given out

    def feed(self, more: str) -> list[int]:
        """Search on over ``more``; the ids that have become final."""
        v, step = self.v, 4 * self.v.longest
        out: list[int] = []
        for i in range(0, len(more), step):
            self._extend(more[i : i + step])
            if len(self.text) - self.done > step:
                out += self._commit(self._meeting())
        return out

    def _extend(self, more: str) -> None:
        v = self.v
        piece, rank, ends, pairs, compatible = self.piece, v.rank, v.ends, v.pairs, v.compatible
        start = len(self.text)
        self.text = text = self.text + more
        for at in range(start + 1, len(text) + 1):
            for size in ends.get(text[at - 3 : at] if at > 2 else "", ()):  # at most one piece fits the path before it
                if size <= at:
                    t = text[at - size : at]
                    if t in rank:
                        last = piece[at - size]
                        fits = pairs.get((last, t))
                        if compatible(last, t) if fits is None else fits:
                            break
            else:
                t = text[at - 2 : at]
                if at < 2 or t not in rank or not compatible(piece[at - 2], t):
                    t = text[at - 1]
            piece.append(t)

    def _meeting(self) -> int:
        """The last boundary that the paths of all boundaries in the window pass."""
        piece, end = self.piece, len(self.text)
        alive = set(range(max(self.done, end - self.v.longest + 1), end + 1))
        while len(alive) > 1:
            b = max(alive)
            alive.remove(b)
            alive.add(max(self.done, b - len(piece[b])))
        return alive.pop()

    def _commit(self, to: int) -> list[int]:
        found, b = [], to
        while b > self.done:
            found.append(self.piece[b])
            b -= len(self.piece[b])
        passed = to - self.v.longest  # no surviving path passes boundaries before ``to``
        self.done = to
        if passed > 0:
            self.text, self.piece, self.done = self.text[passed:], self.piece[passed:], to - passed
        return [i for p in reversed(found) for i in self.v.ids_of(p)]

    def finish(self) -> list[int]:
        """The rest of the ids: the text's end leaves one path."""
        return self._commit(len(self.text))

    def restarted(self, at: int, text: str) -> bytes:
        """All ids of a short text that begins like the one before up to ``at``; nothing is given out in between."""
        del self.piece[at + 1 :]
        self.text = text[:at]
        self._extend(text[at:])
        piece, coded, found, b = self.piece, self.v._coded, [], len(text)
        while b:
            p = piece[b]
            found.append(coded.get(p) or self.v.coded(p))
            b -= len(p)
        found.reverse()
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return self.feed(text) + self.finish()


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(model: str | bytes) -> Vocabulary:
    """The vocabulary of a model file or of its content, made once in a process."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    if model not in _loaded:
        _loaded[model] = Vocabulary(model)
    return _loaded[model]


def forget() -> None:
    """Drops all vocabularies and their caches: a worker may wait for long before its next task, beside others that run."""
    _loaded.clear()
    release()


def encode_column(texts: pa.Array, v: Vocabulary) -> pa.ListArray:
    """Ids of each text; a null has null ids."""
    plain = pc.replace_substring(texts.cast(pa.string()), MARK, " ")
    data, offsets = text_bytes(plain)
    some = np.diff(offsets) > 0
    # a space before each text that isn't empty
    source = np.insert(data, offsets[:-1][some], 32)
    offsets = offsets + np.r_[0, np.cumsum(some)]
    n = len(source)
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    if n:
        start[1:n] |= ~v.beside[source[:-1], source[1:]]
    cuts = np.flatnonzero(start)
    sizes = np.diff(cuts)
    chunks = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(source)])
    coded = chunks.dictionary_encode()
    each = v.chunks(coded.dictionary.to_pylist())
    lengths = np.array([len(x) for x in each], np.int64) // 4
    begin = np.cumsum(lengths) - lengths
    which = coded.indices.to_numpy()
    flat = np.frombuffer(b"".join(each), np.int32)[ranges(begin[which], lengths[which])]
    before = np.r_[0, np.cumsum(lengths[which])]
    at = before[np.searchsorted(cuts[:-1], offsets)] if len(which) else np.zeros(len(offsets), np.int64)
    mask = pc.is_null(texts) if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32()), mask=mask)


def decode_column(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    """Texts (binary) of each list of ids: pieces joined, without the space that encoding puts first; a null gives null."""
    raw = v.raw
    sizes = np.array([len(x) for x in raw], np.int64)
    begin = np.cumsum(sizes) - sizes
    pool = np.frombuffer(b"".join(raw), np.uint8)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy()[offsets[0] : offsets[-1]]
    out = pool[ranges(begin[flat], sizes[flat])]
    at = np.r_[0, np.cumsum(sizes[flat])][offsets - offsets[0]]
    first = at[:-1][(np.diff(at) > 0)]
    first = first[out[first] == 32]
    out = np.delete(out, first)
    at = at - np.searchsorted(first, at)
    made = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
    return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.binary()), made) if ids.null_count else made


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` without ``text`` and with ``ids array<int>, n_ids, round_trip``.

    ``ids`` are those that the library gives for the model, without control ids.
    ``round_trip`` says whether decoding them gives the text again; only U+2581, which the
    model can't tell from a space, makes it false.

    * A null text has null ids, null n_ids and null round_trip; the empty text has no ids.
    * Very long texts are encoded whole. Repeated rows are encoded alike, each of them.
    * Other columns pass unchanged, null or not; input columns named as the three are replaced. An empty table gives an empty one.
    """
    rest, own = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_ids", "round_trip")], free("_text", docs.columns)
    fields = docs.select(*rest).schema

    with open(model, "rb") as f:  # only the driver needs the file; its content, half a megabyte, goes to the executors
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        v = vocabulary(content.value)
        for b in (s for whole in batches for s in slices(whole, own, 2 << 20)):
            texts = b.column(b.num_columns - 1)
            ids = encode_column(texts, v)
            same = pc.equal(decode_column(ids, v), texts.cast(pa.binary()))
            yield pa.record_batch([*b.columns[:-1], ids, pc.cast(pc.list_value_length(ids), pa.int64()), same], names=[*rest, "ids", "n_ids", "round_trip"])
        del v
        forget()

    out = fields.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "long").add("round_trip", "boolean")
    return docs.select(*rest, F.col("text").alias(own)).mapInArrow(code, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir).select("doc_id", "text"))
