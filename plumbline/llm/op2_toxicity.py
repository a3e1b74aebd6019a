"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's inputs are of characters (the largest and the mean log-odds over its hashed character
n-grams, and the mean of their learned vectors), of the word (its own log-odds and learned vector,
by hash), and of its shape. The vectors are trained with the network. Two recurrent passes read a
window of words; attention pools their states into one score. Only documents have labels, so
training takes of each document the window that the network so far scores highest. What a
document's words get in training never comes from the half of the sample that it is in: not their
log-odds, and not their vectors, of which each half trains its own and reads the other's. Else the
vectors would learn the documents by heart (held-out recall at sf0.01 was 0.06 so, not 0.75).

Every text is scored over all its overlapping windows, one beginning at every word. Windows that
begin side by side run as one batch, whose inputs at a step are a slice of the words' inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free, table
from .tokens import Words, ranges, release, slices, span_hashes

#: Labelled documents of each class that are fitted on, those of the smallest hashes.
SAMPLE = 1500
#: All windows are scored; STRIDE only counts those of ``n_windows``.
WINDOW, STRIDE = 24, 16
#: Words from which windows run side by side; rows of a power of two would share few sets of the cache, which slows products.
SIDE = 3100
HIDDEN, ATTENTION = 6, 4
STEPS, BATCH, RATE = 240, 512, 0.02
#: Steps after which each document's highest window is sought again.
SEEK = 60
THRESHOLD = 0.5
BITS = 18
GRAMS = (4, 5)
#: Inputs that are counted, and the sizes of the learned vectors of a word and of its n-grams.
COUNTED, VECTOR = 6, 4
FEATURES = COUNTED + 2 * VECTOR
#: Slots of the learned vectors; DECAY pulls those that help nothing back to zero, which unseen slots have.
VECTOR_BITS, DECAY = 15, 2e-2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _running(mask: np.ndarray) -> np.ndarray:
    """Running counts, from 0."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As numpy's unique: the first place of each distinct value, by value, and of each place its value's number; only distinct values are sorted."""
    coded = pa.array(x).dictionary_encode()
    code, values = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))  # numbers are given in the order of first places
    order = np.argsort(values)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return first[order], number[code]


class Lexicon:
    """The distinct words of a batch, lower-case in ASCII and without marks at their ends, and their character n-grams."""

    def __init__(self, w: Words):
        folded = _FOLD[w.data]
        letters = _running(_LETTER[w.data])
        place = np.flatnonzero(_LETTER[w.data]).astype(np.int32)  # a word's core is from its first to its last letter
        place = np.append(place, np.int32(0))
        some = letters[w.end] > letters[w.begin]
        begin = np.where(some, place[np.where(some, letters[w.begin], 0)], w.begin)
        end = np.where(some, place[np.where(some, letters[w.end] - 1, 0)] + 1, w.end)
        del place
        whole = span_hashes(folded, w.begin, w.end)
        self.one, self.which = _distinct(whole)
        begin, end = begin[self.one], end[self.one]
        sizes = end - begin
        cores = folded[ranges(begin, sizes)]
        stops = np.cumsum(sizes)
        self.word = (span_hashes(cores, stops - sizes, stops) >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.cumsum(sizes + 2) - (sizes + 2)
        x = np.zeros(int((sizes + 2).sum()), np.uint64)
        x[ranges(at + 1, sizes)] = cores
        each = [np.maximum(sizes + 3 - order, 0) for order in GRAMS]
        self.first = np.r_[0, np.cumsum(sum(each))]
        self.gram, begin = np.empty(int(self.first[-1]), np.int32), self.first[:-1]
        for order, n in zip(GRAMS, each, strict=True):
            i = ranges(at, n)
            h = np.full(len(i), order, np.uint64)
            for k in range(order):
                h = h * np.uint64(0x9E3779B97F4A7C15) + x[i + k] + np.uint64(1)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            self.gram[ranges(begin, n)] = h >> np.uint64(64 - BITS)
            begin = begin + n
        del x
        low, high = w.begin[self.one], w.end[self.one]
        upper = _running(_UPPER[w.data])
        self.shape = np.stack([np.log1p(sizes), (upper[high] - upper[low]) / (high - low), 1 - (letters[high] - letters[low]) / (high - low)], axis=1)

    def features(self, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Inputs of each distinct word, by the log-odds of words and of n-grams."""
        out = np.zeros((len(self.one), COUNTED), np.float32)
        out[:, 0] = words[self.word]
        n = np.diff(self.first)
        some = np.flatnonzero(n)
        if len(some):
            value = grams[self.gram]
            starts = self.first[:-1][some]
            out[some, 1] = np.maximum.reduceat(value, starts)
            out[some, 2] = np.add.reduceat(value, starts) / n[some]
        out[:, 3:] = self.shape
        return out

    def vectors(self, tables: tuple[np.ndarray, np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
        """Learned inputs of distinct words: the word's vector, and the mean of its n-grams' vectors."""
        rows = np.arange(len(self.one)) if rows is None else rows
        word, gram, n = self.word >> (BITS - VECTOR_BITS), self.gram, np.diff(self.first)[rows]
        out = np.zeros((len(rows), 2 * VECTOR), np.float32)
        out[:, :VECTOR] = tables[0][word[rows]]
        every = np.flatnonzero(n)
        for i in range(0, len(every), 20_000):  # bounds the vectors held at once
            some = every[i : i + 20_000]
            at = gram[ranges(self.first[:-1][rows[some]], n[some])] >> (BITS - VECTOR_BITS)
            out[some, VECTOR:] = np.add.reduceat(tables[1][at], np.cumsum(n[some]) - n[some], axis=0) / n[some, None]
        return out

    def spread(self, rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the tables of vectors, by those of the learned inputs of ``rows``, distinct words."""
        word, n = self.word[rows] >> (BITS - VECTOR_BITS), np.diff(self.first)[rows]
        at = self.gram[ranges(self.first[:-1][rows], n)] >> (BITS - VECTOR_BITS)
        share = np.repeat(d[:, VECTOR:] / np.maximum(n, 1)[:, None], n, axis=0)
        slots = 1 << VECTOR_BITS
        g = [np.stack([np.bincount(k, x[:, c], slots) for c in range(VECTOR)], axis=1).astype(np.float32) for k, x in ((word, d[:, :VECTOR]), (at, share))]
        return g[0], g[1]


def document_counts(slots: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """How many documents hold each slot; ``docs`` gives each slot's document."""
    return np.bincount(np.unique(docs << BITS | slots.astype(np.int64)) & ((1 << BITS) - 1), minlength=1 << BITS)


def log_odds(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Smoothed log-odds of each slot between ``t`` of ``toxic`` and ``c`` of ``clean`` documents; 0 for a slot that none holds."""
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    return np.where(t + c > 0, odds, 0).astype(np.float32)


def strides_of(counts: np.ndarray) -> np.ndarray:
    """How many windows every STRIDE words cover each text."""
    return np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))


def windows_of(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word (an index into all words) of each window: one from every word that WINDOW words begin with; a shorter text is one window."""
    n = np.where(counts > WINDOW, counts - WINDOW + 1, (counts > 0).astype(np.int64))
    return np.repeat(np.arange(len(counts), dtype=np.int32), n), ranges(first[:-1], n)


def gathered(start: np.ndarray, last: np.ndarray, which: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct-word index (WINDOW x windows) and whether a place holds a word; ``blank`` fills places past the text's end."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    held = at < last[None, :]
    return np.where(held, which[np.minimum(at, len(which) - 1)], blank), held


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent layers over a window, attention over their states, one logit."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        small = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h, a = HIDDEN, ATTENTION
        self.p = {
            "scale": np.ones(FEATURES, np.float32), "shift": np.zeros(FEATURES, np.float32),
            "v": small(2 * h), "c": np.zeros(1, np.float32), "wa": small(2 * h, a), "ba": np.zeros(a, np.float32), "va": small(a),
        }
        for d in "fb":
            self.p |= {"w" + d: small(FEATURES, 3 * h), "b" + d: np.zeros(3 * h, np.float32), "u" + d: small(h, 3 * h), "n" + d: np.zeros(h, np.float32)}

    def inputs(self, features: np.ndarray) -> dict[str, np.ndarray]:
        """The input part of the gates of each distinct word and direction; a row of zeros is added for places without a word."""
        x = np.vstack([features, np.zeros(FEATURES, np.float32)])
        x = (x - self.p["shift"]) * self.p["scale"]
        x[-1] = 0
        return {d: (x @ self.p["w" + d] + self.p["b" + d]).astype(np.float32) for d in "fb"} | {"x": x}

    def forward(self, inputs: dict[str, np.ndarray], index: np.ndarray, held: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of the windows (columns of ``index``); ``keep`` gets what backward needs."""
        p, h, (steps, n) = self.p, HIDDEN, index.shape
        states = np.empty((steps, n, 2 * h), np.float32)
        for k, d in enumerate("fb"):
            u, bias, table_ = p["u" + d], p["n" + d], inputs[d]
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x = table_[index[t]]
                y = s @ u
                gates = x[:, : 2 * h] + y[:, : 2 * h]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                z, r = gates[:, :h], gates[:, h:]
                inner = y[:, 2 * h :] + bias
                new = np.tanh(x[:, 2 * h :] + r * inner)
                if keep is not None:
                    keep[d, t] = (s, z, r, inner, new)
                s = new + z * (s - new)
                states[t, :, k * h : (k + 1) * h] = s
        e = np.tanh(states @ p["wa"] + p["ba"])
        score = np.where(held, e @ p["va"], np.float32(-1e9))
        score -= score.max(axis=0)
        weight = np.exp(score)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if keep is not None:
            keep |= {"states": states, "e": e, "weight": weight, "pooled": pooled}
        return pooled @ p["v"] + p["c"]

    def adjacent(self, inputs: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
        """Logits of the full windows that begin at each of ``words`` but the last WINDOW - 1; as forward's, but for rounding.

        Both directions take a step at once. One product gives a state's part in the next gates and in attention and
        logit; states themselves aren't kept, so that all that is worked on stays in a processor's own cache.
        """
        p, h, a, n = self.p, HIDDEN, ATTENTION, len(words) - WINDOW + 1
        u = np.zeros((2, 3 * h + a + 1, h + 1), np.float32)
        x = np.empty((2, 3 * h, len(words)), np.float32)
        for k, d in enumerate("fb"):
            own = slice(k * h, (k + 1) * h)
            u[k, :, :h] = np.hstack([0.5 * p["u" + d], p["wa"][own], p["v"][own, None]]).T  # a gate is half of 1 + tanh of half its input
            u[k, 2 * h : 3 * h, h] = 0.5 * p["n" + d]  # the last column is the bias
            x[k] = inputs[d][words].T
        x[:, : 2 * h] *= 0.5
        u[1, 3 * h :, h] = np.r_[p["ba"], p["c"]]
        s = np.zeros((2, h + 1, n), np.float32)
        s[:, h] = 1
        y, gates, new = np.empty((2, 3 * h + a + 1, n), np.float32), np.empty((2, 2 * h, n), np.float32), np.empty((2, h, n), np.float32)
        parts = np.zeros((WINDOW, a + 1, n), np.float32)  # of both directions' states in attention and logit
        z, r, state, inner, part = gates[:, :h], gates[:, h:], s[:, :h], y[:, 2 * h : 3 * h], y[:, 3 * h :]
        for t in range(WINDOW + 1):
            for k in (0, 1):
                np.matmul(u[k], s[k], out=y[k])  # one product of both is slower
            if t:
                parts[t - 1] += part[0]
                parts[WINDOW - t] += part[1]
            if t == WINDOW:
                break
            # words t of the windows forwards, words WINDOW - 1 - t backwards
            own = np.ndarray((2, 3 * h, n), np.float32, x, 4 * t, (x.strides[0] + 4 * (WINDOW - 1 - 2 * t), *x.strides[1:]))
            np.add(y[:, : 2 * h], own[:, : 2 * h], out=gates)
            np.tanh(gates, out=gates)
            gates += 1
            np.multiply(inner, r, out=new)
            new += own[:, 2 * h :]
            np.tanh(new, out=new)
            state -= new
            z *= 0.5
            state *= z
            state += new
        e = np.tanh(parts[:, :a], out=parts[:, :a])
        score = np.matmul(p["va"], e)
        score -= score.max(axis=0)
        weight = np.exp(score, out=score)
        return (weight * parts[:, a]).sum(axis=0) / weight.sum(axis=0)

    def every(self, inputs: dict[str, np.ndarray], which: np.ndarray, owner: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Logits of all windows of ``windows_of``: of shorter texts by forward, of others by adjacent."""
        out = np.empty(len(start), np.float32)
        short = np.flatnonzero(start + WINDOW > last[owner])
        for i in range(0, len(short), SIDE):
            at = short[i : i + SIDE]
            out[at] = self.forward(inputs, *gathered(start[at], last[owner[at]], which, len(inputs["x"]) - 1))
        full = np.flatnonzero(start + WINDOW <= last[owner])
        i = 0
        while i < len(full):
            begin = start[full[i]]
            stop = int(np.searchsorted(start[full[i : i + SIDE]], begin + SIDE)) + i
            at = full[i:stop]
            logit = self.adjacent(inputs, which[begin : start[at[-1]] + WINDOW])
            out[at] = logit[start[at] - begin]
            i = stop
        return out

    def gradients(self, features: np.ndarray, index: np.ndarray, held: np.ndarray, label: np.ndarray, learned: dict | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients; ``learned`` gets those of the learned inputs, by row of ``features``."""
        p, h, (steps, n) = self.p, HIDDEN, index.shape
        keep: dict = {}
        inputs = self.inputs(features)
        logit = self.forward(inputs, index, held, keep)
        prob = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((prob - label) / n).astype(np.float32)
        states, e, weight = keep["states"], keep["e"], keep["weight"]
        g["v"], g["c"] = keep["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["v"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nk,tnk->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_e = d_score[:, :, None] * p["va"] * (1 - e * e)
        g["va"] = np.einsum("tn,tna->a", d_score, e)
        g["wa"] = np.einsum("tnk,tna->ka", states, d_e)
        g["ba"] = d_e.sum(axis=(0, 1))
        d_states += d_e @ p["wa"].T
        d_in = np.zeros((steps, n, 2 * VECTOR), np.float32)
        for k, d in enumerate("fb"):
            carry = np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                s, z, r, inner, new = keep[d, t]
                ds = d_states[t, :, k * h : (k + 1) * h] + carry
                d_new = ds * (1 - z) * (1 - new * new)
                d_inner = d_new * r
                d_z = ds * (s - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_x = np.hstack([d_z, d_r, d_new])
                d_y = np.hstack([d_z, d_r, d_inner])
                carry = ds * z + d_y @ p["u" + d].T
                g["u" + d] += s.T @ d_y
                g["n" + d] += d_inner.sum(axis=0)
                g["b" + d] += d_x.sum(axis=0)
                g["w" + d] += inputs["x"][index[t]].T @ d_x
                if learned is not None:
                    d_in[t] += d_x @ p["w" + d][COUNTED:].T
        del g["scale"], g["shift"]
        if learned is not None:
            order = np.argsort(index.ravel(), kind="stable")
            rows, first = np.unique(index.ravel()[order], return_index=True)
            learned |= {"rows": rows, "d": np.add.reduceat(d_in.reshape(-1, 2 * VECTOR)[order], first, axis=0)}
        return loss, g


def blank_vectors() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((1 << VECTOR_BITS, VECTOR), np.float32), np.zeros((1 << VECTOR_BITS, VECTOR), np.float32)


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean of the slots' vectors; where one half trained none, the other's."""
    trained = (a != 0).any(axis=1, keepdims=True).astype(np.float32) + (b != 0).any(axis=1, keepdims=True)
    return (a + b) / np.maximum(trained, 1)


class Model:
    """Log-odds tables, tables of learned vectors and a network."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, network: Network, vectors: tuple[np.ndarray, np.ndarray] | None = None):
        self.words, self.grams, self.network = words, grams, network
        self.vectors = vectors or blank_vectors()

    def inputs(self, lex: Lexicon) -> np.ndarray:
        return np.hstack([lex.features(self.words, self.grams), lex.vectors(self.vectors)])

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the highest probability of its windows, the first word of that window (the first of equals), and the number of strides."""
        w = Words(texts)
        n = len(w.counts)
        top, where, number = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        if not len(w):
            return top, where, number
        lex = Lexicon(w)
        inputs = self.network.inputs(self.inputs(lex))
        owner, start = windows_of(w.counts, w.first)
        prob = np.round(_sigmoid(self.network.every(inputs, lex.which, owner, start, w.first[1:]).astype(np.float64)), 5)  # equal windows differ by rounding
        number = strides_of(w.counts)
        some = np.flatnonzero(number)
        begin = np.searchsorted(owner, some)
        top[some] = np.maximum.reduceat(prob, begin)
        hit = np.flatnonzero(prob == top[owner])[::-1]
        where[owner[hit]] = start[hit] - w.first[owner[hit]]
        return top, where, number


def fit(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Model:
    """A model of labelled documents, both classes present."""
    w = Words(pa.array(texts, pa.string()))
    lex = Lexicon(w)
    release()
    doc = w.owner()
    half = np.random.default_rng(seed).permutation(len(texts)) % 2
    gram_counts = np.diff(lex.first)

    def odds(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros((2, 2, 1 << BITS), np.int64)  # words and n-grams, clean and toxic
        for label in (0, 1):
            own = np.flatnonzero(chosen & (toxic == label))
            for i in range(0, len(own), 100):  # bounds the n-grams held at once
                at = ranges(w.first[own[i : i + 100]], w.counts[own[i : i + 100]])
                d, k = np.divmod(np.unique(doc[at] * len(lex.one) + lex.which[at]), len(lex.one))
                counts[0, label] += document_counts(lex.word[k], d)
                counts[1, label] += document_counts(lex.gram[ranges(lex.first[:-1][k], gram_counts[k])], np.repeat(d, gram_counts[k]))
        n = int((chosen & toxic).sum())
        return tuple(log_odds(t, c, n, int(chosen.sum()) - n) for c, t in counts)

    several = lex.features(*odds(half == 1)), lex.features(*odds(half == 0))
    size = len(lex.one)
    features = np.hstack([np.vstack(several), np.zeros((2 * size, 2 * VECTOR), np.float32)])  # a document's words are looked up in the part of the other half
    network, tables = Network(seed), (blank_vectors(), blank_vectors())  # of each half of the documents
    times = np.tile(np.bincount(lex.which, minlength=size), 2)  # how often each row is read
    mean = np.average(features[:, :COUNTED], axis=0, weights=times)
    network.p["shift"][:COUNTED] = mean
    network.p["scale"][:COUNTED] = 1 / (np.sqrt(np.average((features[:, :COUNTED] - mean) ** 2, axis=0, weights=times)) + 1e-3)
    which = lex.which + np.where(half[doc] == 0, 0, size)
    owner, start = windows_of(w.counts, w.first)
    label = toxic.astype(np.float32)
    strong = np.r_[0, np.cumsum(np.maximum(features[which, 1], 0) ** 2)]
    value = strong[np.minimum(start + WINDOW, w.first[owner + 1])] - strong[start]
    moments: dict[str, tuple] = {}
    r = np.random.default_rng(seed)
    queue = np.empty(0, np.int64)
    clean = np.flatnonzero(~toxic[owner])
    for step in range(1, STEPS + 1):
        if step > 1 and step % SEEK == 1:
            features[:, COUNTED:] = np.vstack([lex.vectors(tables[1]), lex.vectors(tables[0])])
            inputs = network.inputs(features)
            value = network.every(inputs, which, owner, start, w.first[1:])
            del inputs
            release()
        if step % SEEK == 1:
            order = np.lexsort((-value, owner))
            best = order[np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])]
            queue = queue[:0]
        if not len(queue):
            queue = r.permutation(np.r_[best, r.choice(clean, min(len(clean), len(best) // 2), replace=False)])
        b, queue = queue[:BATCH], queue[BATCH:]
        index, held = gathered(start[b], w.first[owner[b] + 1], which, 2 * size)
        rows, index = np.unique(index, return_inverse=True)
        own = rows[rows < 2 * size]
        part = np.searchsorted(own, size)  # from here on words of documents of the second half
        features[own, COUNTED:] = np.vstack([lex.vectors(tables[1], own[:part]), lex.vectors(tables[0], own[part:] - size)])
        learned: dict = {}
        _, g = network.gradients(features[own], index.reshape(held.shape), held, label[owner[b]], learned)
        places = dict(network.p)
        for h, at in enumerate((slice(0, part), slice(part, len(own)))):
            # a document reads the vectors of the other half and trains those of its own
            places |= {f"words{h}": tables[h][0], f"grams{h}": tables[h][1]}
            g |= zip((f"words{h}", f"grams{h}"), lex.spread(own[at] % size, learned["d"][: len(own)][at]), strict=True)
        for k, x in g.items():
            m, s = moments.get(k, (0, 0))
            m, s = 0.9 * m + 0.1 * x, 0.999 * s + 0.001 * x * x
            moments[k] = m, s
            rate = RATE * (1 - step / (STEPS + 1))
            places[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
            if k not in network.p:
                places[k] *= 1 - DECAY
    vectors = _mean(tables[0][0], tables[1][0]), _mean(tables[0][1], tables[1][1])
    return Model(*odds(np.ones(len(texts), bool)), network, vectors)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of at most ``sample`` documents of each class; None without both classes."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of contradicting labels the toxic one counts
    known = known.join(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # the smallest hashes of each class: a bounded heap in each task, no sort of all labels
    of = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for label in (0, 1)]
    chosen = {r.doc_id: r.toxic for r in of[0].unionByName(of[1]).collect()}
    if len(set(chosen.values())) < 2:
        return None
    ids = docs.where(F.col("text").isNotNull() & F.col("doc_id").isin(list(chosen)))
    one = ids.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))  # of rows that share an id, one
    rows = one.orderBy("doc_id").collect()
    texts = [(r.text, chosen[r.doc_id]) for r in rows if r.text.split()]
    toxic = np.array([t for _, t in texts], bool)
    return fit([x for x, _ in texts], toxic) if 0 < toxic.sum() < len(toxic) else None


def scored(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without ``text`` and with ``toxicity, toxic, worst_word, n_windows``.

    ``toxicity`` is the highest probability of all the text's windows of WINDOW words, one
    beginning at every word up to the one that ends with the text, rounded to 5 digits; a shorter text is one window.
    ``worst_word`` is that window's first word, of equals the first; ``toxic`` that it reaches the threshold.
    ``n_windows`` isn't the number of windows scored: it counts those that cover the text every STRIDE words.

    * A null text, and a model that couldn't be fitted for want of labels, give null, null, null and 0.
    * A text without a word has no window: 0.0, false, null, 0.
    * Very long texts are scored whole; repeated rows alike, each of them.
    * Other columns pass unchanged; input columns named as the new ones are replaced. An empty table gives an empty one.
    """
    made = ("toxicity", "toxic", "worst_word", "n_windows")
    rest, own = [c for c in docs.columns if c.lower() not in ("text", *made)], free("_text", docs.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, own, 1 << 20)):
            texts = b.column(b.num_columns - 1)
            top, where, number = model.scores(texts) if model else (np.zeros(len(texts)), np.full(len(texts), -1), np.zeros(len(texts), np.int64))
            none = np.array(texts.is_null()) | (model is None)
            columns = [pa.array(top, mask=none), pa.array(top >= threshold, mask=none), pa.array(where, pa.int64(), mask=none | (where < 0)), pa.array(np.where(none, 0, number), pa.int64())]
            yield pa.record_batch([*b.columns[:-1], *columns], names=[*rest, *made])

    schema = docs.select(*rest).schema.add("toxicity", "double").add("toxic", "boolean").add("worst_word", "long").add("n_windows", "long")
    return docs.select(*rest, F.col("text").alias(own)).mapInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
