"""Language identification of mixed text: script ranges, per-word scores, and a Viterbi search with a switching penalty.

A word's script, the range that most of its letters lie in, narrows the languages it can have.
A Latin word is scored for each Latin language by hashed character n-grams, a classifier fitted on
a bounded sample of labelled documents; a word of another script for the script's few languages,
by letters that only one of them has. Scripts written without blanks are cut from their neighbours,
so that ``漢字かな`` within a run is words of its own. The search labels all words of a text at once, and a change of language between neighbours costs a
penalty, so that spans form. It runs over all texts of a batch side by side, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free
from .tokens import Words, ranges, slices

#: Labelled documents of each language that the classifier is fitted on, those of the smallest hashes.
SAMPLE = 400
PENALTY = 6.0
#: A document is kept if at least this share of its words have a language; a mixture of languages is kept like one.
SHARE = 0.2
#: Latin languages told apart.
LANGUAGES = ("de", "en", "es", "fr")
#: Slots of each order's table of n-grams, and orders.
BITS, ORDERS = 14, 3
#: Score of a language that isn't of the word's script.
FOREIGN = -60.0

#: First and last code point of each range; letters outside all of them are of no script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
}
NAMES = tuple(SCRIPTS)
#: Han beyond the basic plane.
HAN_BEYOND = (0x20000, 0x323AF)
#: The languages of each script that isn't Latin, the likeliest first.
LANGUAGES_OF = {"greek": ("el",), "cyrillic": ("ru", "uk"), "hebrew": ("he",), "arabic": ("ar", "fa"), "devanagari": ("hi",), "thai": ("th",), "kana": ("ja",), "hangul": ("ko",), "han": ("zh", "ja")}
#: Letters that only one of a script's languages has, and what each of them adds to its score.
LETTERS_OF = {"ru": "ыэъёЫЭЪЁ", "uk": "іїєґІЇЄҐ", "ar": "يكةى", "fa": "پچژگکی"}
LETTER = 3.0
#: What a letter costs the second language of its script; Chinese characters in Japanese are few between kana.
SECOND = {"uk": 0.05, "fa": 0.05, "ja": 0.5}
#: Scripts that are cut from what stands beside them without a blank.
UNSPACED = ("thai", "kana", "hangul", "han")


def script_table() -> np.ndarray:
    """The script of each code point of the basic plane, one more than its index; 0 for none."""
    t = np.zeros(0x10000, np.uint8)
    for k, name in enumerate(NAMES):
        for low, high in SCRIPTS[name]:
            t[low : high + 1] = k + 1
    return t


_TABLE = script_table()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each character, and its code point."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.uint32)
    padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.uint32) & 0x3F
    point = np.where(
        b < 0x80, b,
        np.where(b < 0xE0, ((b & 0x1F) << 6) | padded[lead + 1],
        np.where(b < 0xF0, ((b & 0x0F) << 12) | (padded[lead + 1] << 6) | padded[lead + 2],
                 ((b & 0x07) << 18) | (padded[lead + 1] << 12) | (padded[lead + 2] << 6) | padded[lead + 3])),
    )
    return lead, point


class Letters:
    """Characters of a batch: first bytes, code points and scripts; and the characters of each word, from ``first`` to ``last``."""

    def __init__(self, w: Words):
        self.lead, self.point = code_points(w.data)
        self.script = np.where(self.point < 0x10000, _TABLE[np.minimum(self.point, 0xFFFF)], 0)
        self.script[(self.point >= HAN_BEYOND[0]) & (self.point <= HAN_BEYOND[1])] = NAMES.index("han") + 1
        self._cut(w)
        self.first, self.last = np.searchsorted(self.lead, w.begin), np.searchsorted(self.lead, w.end)

    def _cut(self, w: Words) -> None:
        """Cuts words where a script without blanks begins or ends; marks and digits stay with what is before them."""
        apart = np.isin(self.script, [NAMES.index(x) + 1 for x in UNSPACED])
        if not apart.any():
            return
        kind = np.where(apart, self.script, 1)
        letter = np.flatnonzero(self.script > 0)
        before = np.searchsorted(letter, np.arange(len(kind)), "right") - 1
        kind = kind[letter[np.maximum(before, 0)]]
        at = self.lead[np.flatnonzero(np.diff(kind)) + 1]
        word = np.searchsorted(w.begin, at, "right") - 1
        at = at[(word >= 0) & (w.begin[word] < at) & (at < w.end[word])]
        w.begin, w.end = np.sort(np.r_[w.begin, at]), np.sort(np.r_[w.end, at])
        w.first = np.searchsorted(w.begin, w.offsets)

    def count(self, chosen: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How many of the chosen characters each of ``words`` has."""
        sums = np.r_[0, np.cumsum(chosen)]
        return sums[self.last[words]] - sums[self.first[words]]


def word_scripts(w: Words) -> tuple[np.ndarray, Letters | None]:
    """The script (1 and up; 0 for none) of each word: the one of most of its letters, the first in the list of equals. Words of ``w`` may be cut."""
    if not len(w):
        return np.empty(0, np.uint8), None
    if not (w.data & 0x80).any():
        letters = _TABLE[w.data] > 0
        sums = np.r_[0, np.cumsum(letters)]
        return (sums[w.end] > sums[w.begin]).astype(np.uint8), None
    x = Letters(w)
    best, count = np.zeros(len(w), np.uint8), np.zeros(len(w), np.int64)
    every = np.arange(len(w))
    for k in np.unique(x.script[x.script > 0]):
        n = x.count(x.script == k, every)
        more = n > count
        best[more], count[more] = k, n[more]
    return best, x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def distinct_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each distinct word, and the number of each word's."""
    _, one, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return one, which


def gram_slots(w: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of the n-grams of bytes of chosen words, lower-case in ASCII and with a boundary at either side; n-grams of the i-th word are those from offset i to i+1."""
    sizes = w.end[chosen] - w.begin[chosen]
    at = np.cumsum(sizes + 2) - (sizes + 2)
    x = np.zeros(int((sizes + 2).sum()), np.uint32)
    x[ranges(at + 1, sizes)] = _FOLD[w.data[ranges(w.begin[chosen], sizes)]]
    slots, counts = [], np.zeros(len(chosen), np.int64)
    begins = []
    h = np.zeros(len(x), np.uint32)
    for order in range(1, ORDERS + 1):
        shifted = np.zeros(len(x), np.uint32)
        shifted[: len(x) - order + 1] = x[order - 1 :]
        h = h * np.uint32(0x01000193) + shifted + np.uint32(1)
        slot = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)) + np.uint32((order - 1) << BITS)
        n = np.maximum(sizes + 3 - order, 0)
        slots.append(slot[ranges(at, n)])
        begins.append(n)
        counts += n
    offsets = np.r_[0, np.cumsum(counts)]
    out = np.empty(int(counts.sum()), np.uint32)
    start = offsets[:-1].copy()
    for n, s in zip(begins, slots, strict=True):
        out[ranges(start, n)] = s
        start += n
    return out, offsets


class Classifier:
    """Per-word scores of the Latin languages; built-in sums over hashed n-grams, naive Bayes."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = tuple(sorted(texts))
        counts = np.zeros((ORDERS << BITS, len(self.languages)))
        for k, language in enumerate(self.languages):
            w = Words(pa.array(texts[language], pa.string()))
            if len(w):
                slots, _ = gram_slots(w, np.arange(len(w)))
                counts[:, k] = np.bincount(slots, minlength=ORDERS << BITS)
        smooth = np.log(counts + 0.5)
        for order in range(ORDERS):
            part = slice(order << BITS, (order + 1) << BITS)
            smooth[part] -= np.log(counts[part].sum(axis=0) + 0.5 * (1 << BITS))
        if self.languages:
            smooth -= smooth.mean(axis=1, keepdims=True)
        self.weights = smooth.astype(np.float32) / 2

    def scores(self, w: Words, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((len(chosen), len(self.languages)), np.float32)
        for i in range(0, len(chosen), 16_384):  # bounds the n-grams held at once
            slots, offsets = gram_slots(w, chosen[i : i + 16_384])
            out[i : i + 16_384] = np.add.reduceat(self.weights[slots], offsets[:-1], axis=0)
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word: most score less ``penalty`` for each change between neighbours of a text.

    Of equal paths the one that doesn't change is taken, and then the lower state.
    """
    n, states = scores.shape
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(1, steps + 1), "right")
    best = np.empty(n, np.uint8)
    changed = np.zeros((n, states), bool)
    value = scores[begin[: active[0]]].copy() if steps else None
    ends = np.empty((len(counts), states), np.float32)
    for t in range(1, steps):
        k = active[t]
        if k < len(value):
            ends[k : len(value)] = value[k:]
            value = value[:k]
        at = begin[:k] + t
        top = value.argmax(axis=1)
        level = value[np.arange(k), top] - penalty
        best[at] = top
        less = value < level[:, None]
        changed[at] = less
        value = np.maximum(value, level[:, None]) - level[:, None] + scores[at]
    if steps:
        ends[: len(value)] = value
    labels = np.empty(n, np.uint8)
    state = ends.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        at = begin[: active[t]] + t
        own = state[: active[t]]
        labels[at] = own
        if t:
            state[: active[t]] = np.where(changed[at, own], best[at], own)
    return labels


def fitted(docs: DataFrame, languages: tuple[str, ...], sample: int) -> Classifier:
    """A classifier of at most ``sample`` labelled documents of each language, those whose ids have the smallest hashes."""
    known = docs.where(F.col("lang").isin(*languages) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("lang", "doc_id").withColumn("_nth", F.row_number().over(by_hash)).where(F.col("_nth") <= sample)
    ids = [r.doc_id for r in chosen.select("doc_id").distinct().collect()]
    texts: dict[str, list[str]] = {}
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")  # of rows that share id and language, one
    for r in known.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "lang").agg(one).orderBy("doc_id", "lang").collect() if ids else []:
        texts.setdefault(r.lang, []).append(r.text)
    return Classifier(texts)


SPANS = T.ArrayType(T.StructType().add("first_word", "integer").add("end_word", "integer").add("lang", "string"))


def labelled(texts: pa.Array, model: Classifier, penalty: float) -> tuple[list, list, list, list, pa.ListArray]:
    """Of each text: main language, its share of the words that have a language, their share of all words, number of words, and spans."""
    w = Words(texts)
    kind, letters = word_scripts(w)
    one, which = distinct_words(w)
    n_texts = len(w.counts)
    others = [NAMES[k - 1] for k in np.unique(kind[kind > 1])]
    names = [*model.languages, *dict.fromkeys(x for k in others for x in LANGUAGES_OF[k])]
    latin = len(model.languages)
    if not names or not len(w):
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(n_texts + 1, np.int32)), _spans([], [], []))
        return [None] * n_texts, [None] * n_texts, [0.0] * n_texts, w.counts.tolist(), empty
    each = np.zeros((len(one), len(names)), np.float32)
    each[:, :latin] = model.scores(w, one)
    script = kind[one]
    each[script == 0] = 0
    each[script == 1, latin:] = FOREIGN
    for k in others:
        own = np.flatnonzero(script == NAMES.index(k) + 1)
        each[own] = FOREIGN
        for language in LANGUAGES_OF[k]:
            known = LETTERS_OF.get(language, "")
            score = LETTER * letters.count(np.isin(letters.point, [ord(c) for c in known]), one[own]) if known else np.zeros(len(own))
            if language != LANGUAGES_OF[k][0]:
                score = score - SECOND[language] * letters.count(letters.script > 0, one[own])
            each[own, latin + names[latin:].index(language)] = score
    labels = viterbi(each[which], w.first, penalty)
    owner = w.owner()
    some = (kind > 1) | ((kind == 1) & (latin > 0))
    tally = np.bincount(owner[some] * len(names) + labels[some], minlength=n_texts * len(names)).reshape(n_texts, len(names))
    total, main = tally.sum(axis=1), tally.argmax(axis=1)
    langs = [names[m] if t else None for m, t in zip(main, total, strict=True)]
    shares = [float(tally[i, main[i]] / total[i]) if total[i] else None for i in range(n_texts)]
    valued = total[owner] > 0  # a text without a word of any language has no spans
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])])
    stop = np.r_[new[1:], len(w)]
    keep = valued[new]
    new, stop = new[keep], stop[keep]
    spans = _spans(new - w.first[owner[new]], stop - w.first[owner[new]], pa.array(names).take(pa.array(labels[new])))
    offsets = np.searchsorted(owner[new], np.arange(n_texts + 1)).astype(np.int32)
    known = (total / np.maximum(w.counts, 1)).tolist()
    return langs, shares, known, w.counts.tolist(), pa.ListArray.from_arrays(pa.array(offsets), spans)


def _spans(first, end, lang) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(lang, pa.string())], names=["first_word", "end_word", "lang"])


def identified(docs: DataFrame, model: Classifier, penalty: float = PENALTY, share: float = SHARE, with_text: bool = False) -> DataFrame:
    """``docs``, without ``text`` unless ``with_text``, and with ``main_lang, main_share, n_words, keep, spans``.

    Words are runs of characters other than ASCII white space, cut where a script of UNSPACED
    begins or ends. Spans are maximal runs of words
    of one language and cover the text; a word without letters takes its neighbours' language.
    ``main_lang`` has the most words with letters, the first by name of equals among the Latin
    languages, which come first. ``keep`` says that at least ``share`` of all words have a language.

    Told apart are the languages of the sample and those of LANGUAGES_OF; text in another language of
    one of these scripts gets one of them (Bulgarian is ru, Marathi hi), text in another script none.

    * A null, empty or blank text, and one without a letter of a known script, has null
      ``main_lang`` and ``main_share``, no spans, and isn't kept; ``n_words`` counts its words (null: 0).
    * Very long texts are labelled whole, repeated rows alike and each of them.
    * Other columns pass unchanged, null or not; input columns named as the new ones are replaced. An empty table gives an empty one.
    """
    made = ("main_lang", "main_share", "n_words", "keep", "spans")
    rest, own = [c for c in docs.columns if c.lower() not in ("text", *made)], free("_text", docs.columns)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, own, 3 << 20)):
            langs, shares, known, counts, spans = labelled(b.column(b.num_columns - 1), model, penalty)
            keep = [x is not None and y >= share for x, y in zip(langs, known, strict=True)]
            text = [b.column(b.num_columns - 1)] if with_text else []
            yield pa.record_batch([*b.columns[:-1], *text, pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(counts, pa.int64()), pa.array(keep, pa.bool_()), spans], names=[*rest, *["text"][: len(text)], *made])

    schema = docs.select(*rest, *["text"][: int(with_text)]).schema.add("main_lang", "string").add("main_share", "double").add("n_words", "long").add("keep", "boolean").add("spans", SPANS)
    return docs.select(*rest, F.col("text").alias(own)).mapInArrow(label, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identified(docs.select("doc_id", "text"), fitted(docs, LANGUAGES, SAMPLE))
