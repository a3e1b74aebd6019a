"""The ten text operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.llm import op1_sentencepiece as op1
from plumbline.llm import op2_toxicity as op2
from plumbline.llm import op3_embeddings as op3
from plumbline.llm import op4_language as op4
from plumbline.llm import op5_substring as op5
from plumbline.llm import op6_lines as op6
from plumbline.llm import op7_jaccard as op7
from plumbline.llm import op8_suffix as op8
from plumbline.llm import op9_mixing as op9
from plumbline.llm import op10_exact as op10
from plumbline.llm.groups import components, likely

RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 4)) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    return list(np.random.default_rng(seed).choice(VOCABULARY, n))


PASSAGE = words(60, 1)
TEXTS = [
    " ".join(words(80, 2)),
    " ".join(words(80, 2)),  # a copy
    " ".join(words(30, 4) + PASSAGE + words(40, 5)),
    " ".join(words(10, 6) + PASSAGE + words(70, 7)),
    " ".join(words(120, 2)[:80] + ["changed"]),
    " ".join(words(20, 8) * 9),  # repeats itself
    "line one\nline two\nline three\nline four",
    "other\nline one\nline two\nline three\nend",
    "same\nsame\nsame\nsame\nsame",
    "",
    " \n ",
    "short",
    None,
    None,
    " ".join(words(30_000, 9)),
    "ein kurzer und der die das ist nicht für mit ß über",
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "s0", 1), (None, TEXTS[0], None, None, None), (100, TEXTS[3], None, "s1", None)]  # a repeated row, null columns
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    for c in ("h", "ids", "key", "node", "bucket", "component", "hash", "first", "shard", "keep", "spans", "toxicity", "removed_lines", "value", "path", "_text", "_id", "_key", "_source", "_copy", "_covered", "_lines", "_at", "_h", "_nth", "_text_", "text_"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_clashing_columns_pass(docs, language_model):
    """Operators that pass columns on keep all of them, but for those that they make."""
    wide = clashing(docs)
    made = {
        op1.encoded: {"ids", "n_ids", "round_trip"}, lambda d: op2.scored(d, None): {"toxicity", "toxic", "worst_word", "n_windows"}, op6.without_repeated_lines: {"removed_lines"},
        lambda d: op4.identified(d, language_model): {"main_lang", "main_share", "n_words", "keep", "spans"}, op9.mixed: {"shard", "position"}, op7.one_of_each_group: set(),
    }
    for operator, new in made.items():
        out = operator(wide)
        same = [c for c in wide.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", *new)]
        assert set(same) | new <= set(out.columns) and len(out.columns) == len(set(out.columns))
        assert all(r[c] == "x" for r in out.select(*same).collect() for c in same)


def brute_passages(rows, window):
    seen = defaultdict(list)
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - window + 1):
            seen[tuple(w[p : p + window])].append((i, p))
    hit = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                hit[i].update(range(p, p + window))
    out = set()
    for i, covered in hit.items():
        c = sorted(covered)
        start = c[0]
        for a, b in zip(c, c[1:] + [None], strict=True):
            if b != a + 1:
                out.add((i, start, a + 1, a + 1 - start))
                start = b
    return out


@pytest.mark.parametrize("operator", [op5.repeated_passages, op8.suffix_repeats])
def test_repeated_passages(docs, none, operator):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.text is not None]
    expected = brute_passages(rows, 50)
    assert {tuple(r) for r in operator(docs).select("doc_id", "start_word", "end_word", "n_words").collect()} == expected
    assert {2, 3, 100} <= {e[0] for e in expected}
    assert operator(none).count() == 0
    assert {tuple(r)[0] for r in operator(clashing(docs)).collect()} == {e[0] for e in expected}


def test_repeats_of_random_sequences(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("ab"), int(rng.integers(0, 60))))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_passages(rows, 8)
    for found in (op5.repeated_passages(df, 8), op8.suffix_repeats(df, 8, 3)):
        assert {tuple(r) for r in found.select("doc_id", "start_word", "end_word", "n_words").collect()} == expected


def test_one_window_in_every_text(spark):
    """A text, a passage and a phrase that all rows have: hot keys, split and combined under small bounds."""
    rng = np.random.default_rng(23)
    phrase, rows = words(20, 31), [(i, TEXTS[0]) for i in range(200)]
    rows += [(1000 + i, " ".join([*rng.choice(VOCABULARY, 45), *phrase, *rng.choice(VOCABULARY, 45)])) for i in range(150)]
    rows += [(2000 + i, " ".join([*rng.choice(VOCABULARY, 30), *PASSAGE, *rng.choice(VOCABULARY, 30)])) for i in range(150)]
    rows += [(3000, rows[200][1] + " x"), (3001, "y " + rows[350][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_passages(rows, 50)
    for found in (op5.repeated_passages(df), op8.suffix_repeats(df), op8.suffix_repeats(df, contents=20)):
        assert {tuple(r) for r in found.select("doc_id", "start_word", "end_word", "n_words").collect()} == expected


def test_bounded_prefixes_match_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        sequence = np.r_[rng.integers(1, 4, n), 0]
        order = op8.suffix_order(sequence)
        suffixes = sorted(range(len(sequence)), key=lambda i: list(sequence[i:]))
        assert order.tolist() == suffixes

        def common(a, b, s=sequence):
            k = 0
            while a + k < len(s) and b + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            return k

        for bound in (1, 2, 5):
            found = op8.bounded_prefixes(sequence, order, bound)
            true = [0, *(common(suffixes[i - 1], suffixes[i]) for i in range(1, len(suffixes))), 0]
            assert found.tolist() == [x if x < bound else -1 for x in true]


def test_exact_duplicates(docs, none, spark):
    groups = defaultdict(list)
    for r in docs.collect():
        if r.text is not None:
            groups[r.text].append(r.doc_id)
    expected = sorted((str(i), min(x for x in ids if x is not None), len(ids)) for ids in groups.values() for i in sorted(ids, key=lambda x: (x is None, x))[1:])
    for bucket, ids in ((1 << 26, 4096), (300, 4096), (1 << 26, 1), (300, 0)):  # the second and the last spill, the last two give ids out
        assert sorted((str(r.doc_id), r.kept_doc_id, r.n_copies) for r in op10.exact_duplicates(docs, bucket, ids).collect()) == expected
    assert op10.exact_duplicates(none).count() == 0
    assert op10.exact_duplicates(clashing(docs)).count() == len(expected)


def test_grace_spills_and_compares_contents(tmp_path):
    records = [(7 << 60 | i % 3, f"text {i % 50}".encode(), [i]) for i in range(200)]  # few hashes, many contents
    spill = op10.Spill(str(tmp_path))
    tables = list(op10.grace(iter(records), spill, 6000, None))
    spill.close()
    got = {c: sorted(ids) for t in tables if t for _, c, ids, *_ in t.records()}
    want = defaultdict(list)
    for i in range(200):
        want[(i % 3, i % 50)].append(i)
    assert sum(len(t.hash) for t in tables if t) == len(want) and sum(len(x) for t in tables if t for x in t.ids) == 200
    assert set(got) == {c for _, c, _ in records} and spill.files > 0


def brute_lines(rows):
    windows = sorted((i, p, tuple(x)) for i, t in rows for lines in [t.split("\n")] for p in range(len(lines) - 2) for x in [lines[p : p + 3]])
    seen, gone = set(), defaultdict(set)
    for i, p, x in windows:
        if x in seen:
            gone[i].update((p, p + 1, p + 2))
        seen.add(x)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_lines(docs, none):
    got = op6.without_repeated_lines(docs).collect()
    assert len(got) == docs.count()
    expected = brute_lines([(i, t) for i, t in enumerate(TEXTS) if t is not None])
    for r in got:
        if r.doc_id is not None and r.doc_id in expected:
            assert r.text == expected[r.doc_id]
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].text == "other\nend" and by_id[7].removed_lines == 3 and by_id[8].text == "same" and by_id[12].text is None
    assert op6.without_repeated_lines(none).count() == 0
    assert op6.without_repeated_lines(clashing(docs)).count() == docs.count()


def gram_set(text, n=3):
    import re

    w = [x for x in re.split(r"[\x00-/:-`{-\x7f]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    """``doc_id, class_id, n_links`` of rows with an id, by comparing all pairs."""
    rows = [(i, gram_set(t) if t is not None else set()) for i, t in rows]
    parent, links, pairs = list(range(len(rows))), [0] * len(rows), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows[:a]):
            if x and y and (o := len(x & y)) and o >= 0.5 * (len(x) + len(y) - o):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
                pairs[min(i, j), max(i, j)] = round(o / (len(x) + len(y) - o), 6)
    low = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        low[find(a)].append(i)
    return sorted((i, min(low[find(a)]), links[a]) for a, (i, _) in enumerate(rows)), pairs


def test_jaccard(docs, none, spark):
    rng = np.random.default_rng(4)
    base = [words(60, 50 + k) for k in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, len(w)))] = VOCABULARY[int(rng.integers(0, 400))]
        rows.append((1000 + i, " ".join(w)))
    every = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None] + rows
    expected, pairs = brute_classes(every)
    table = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    for bucket, grams in ((op7.BUCKET, op7.BLOCK_GRAMS), (3, 300)):  # the second takes the prefix filter, and cuts blocks into chunks
        assert sorted(map(tuple, op7.similar_classes(clashing(table), bucket=bucket, block_grams=grams).collect())) == expected
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in op7.similar_pairs(table).collect()}
    first = {}
    for i, t in sorted((i, t) for i, t in every if t is not None):
        first.setdefault(frozenset(gram_set(t)), i)
    named = {i: first[frozenset(gram_set(t))] for i, t in every if t is not None}
    assert got == {tuple(sorted((named[a], named[b]))): v for (a, b), v in pairs.items() if named[a] != named[b]}
    assert op7.similar_classes(none).count() == op7.similar_pairs(none).count() == op7.one_of_each_group(none).count() == 0
    kept = {r.doc_id for r in op7.one_of_each_group(clashing(docs)).collect()}
    assert {0, 2, 9, 11, 12, None} <= kept and not {1, 4, 100} & kept


@pytest.mark.parametrize("bucket", [op7.BUCKET, 24])
def test_jaccard_with_a_shared_passage(spark, bucket):
    """Similar pairs just over the threshold, in texts that all share a passage: two fifths of each text, so that unrelated ones have 0.25."""
    rng = np.random.default_rng(17)
    fresh = lambda n: ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, 7))]
    passage, rows = fresh(82), []
    for i in range(500):
        common = fresh(54)
        rows += [(2 * i, " ".join(passage + common + fresh(66))), (2 * i + 1, " ".join(fresh(66) + passage + common))]
    got = {(r.doc_id, r.class_id, r.n_links) for r in op7.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    assert 0.5 <= len(x := gram_set(rows[0][1]) & gram_set(rows[1][1])) / (400 - len(x)) < 0.51
    assert len(got) == 1000 and len(got & {(i, i // 2 * 2, 1) for i in range(1000)}) >= 998


@pytest.mark.parametrize("bucket", [op7.BUCKET, 4])
def test_jaccard_sends_few_texts(spark, bucket):
    """Texts that are similar to none, and their band keys, aren't shuffled but for the first grouping of the keys; with small buckets the prefix filter runs too."""
    rng = np.random.default_rng(23)
    fresh = lambda n: ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, 7))]
    passage = fresh(80)
    rows = [(i, " ".join(fresh(2500))) for i in range(300)] + [(1000 + i, " ".join(passage + fresh(50))) for i in range(12)]
    rows += [(2000, rows[-1][1] + " end"), (2001, rows[3][1] + " end")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    assert table.count() == 314
    sent = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = sent()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in op7.similar_classes(table, bucket=bucket).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got[2000] == got[1011] == (1011, 1) and got[2001] == got[3] == (3, 1) and len(got) == 314
    assert sum(n for _, n in got.values()) == 4
    assert sent() - before < 0.4 * sum(len(t) for _, t in rows)
    table.unpersist()


def test_likely_keeps_all_keys(spark):
    rows, keys = spark.range(-3000, 3000).withColumnRenamed("id", "k"), spark.range(0, 300, 3).withColumnRenamed("id", "k")
    for most in (1 << 25, 64):  # the second bitmap is too small for its keys
        got = {r.k for r in likely(rows, "k", keys, most).collect()}
        assert {*range(0, 300, 3)} <= got and (len(got) < 900 or most == 64)
    assert likely(rows, "k", keys.limit(0)).count() == 0


def test_signature_tree_is_exact():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50))).astype(np.uint64)) for _ in range(90)]
    for t in (0.3, 0.5, 0.9):
        for most in (1 << 20, 200):
            i, j, s = (np.concatenate(c) for c in zip((np.empty(0, int), np.empty(0, int), np.empty(0)), *op7.block_pairs(sets, t, most), strict=True))
            got = {(min(a, b), max(a, b)): x for a, b, x in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)}
            want = {}
            for a in range(90):
                for b in range(a + 1, 90):
                    o = len(np.intersect1d(sets[a], sets[b]))
                    x = o / (len(sets[a]) + len(sets[b]) - o)
                    if x >= t:
                        want[a, b] = x
            assert got.keys() == want.keys() and len(i) == len(got) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(200 + i, 201 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (5, None), edges[0]], "src long, dst long")
    for one_task in (1000, 0):  # the second runs the rounds
        assert {(r.node, r.component) for r in components(df, one_task=one_task).collect()} == {(x, find(x)) for x in parent}
    assert components(df.where("false")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((150, 32))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(base)]
    for i in range(150, 400):
        v = base[i % 150] + rng.standard_normal(32) * 0.18
        rows.append((i, v.tolist()))
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [None] * 32), (905, rows[0][1]), (905, rows[0][1]), (None, rows[1][1]), (906, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    small = {tuple(r) for r in op3.components_of_embeddings(clashing(df), chunk=7).collect()}  # buckets and blocks are cut
    found = op3.components_of_embeddings(clashing(df)).collect()
    got = {r.vec_id: r for r in found}
    assert small == {tuple(r) for r in found} and len(found) == df.where("vec_id is not null").count()
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T) >= 0.9
    pairs = [(a, b) for a in range(400) for b in range(a) if near[a, b]]
    assert len(pairs) > 100 and np.mean([got[a].component == got[b].component for a, b in pairs]) >= 0.995
    copies = {0: 3}  # rows of each vector: 905 is a copy of 0, twice, and the row without an id isn't counted
    links = [sum(copies.get(b, 1) for b in range(400) if near[a, b]) - 1 for a in range(400)]
    assert np.mean([got[i].n_links == links[i] for i in range(400)]) >= 0.98 and all(got[i].n_links <= links[i] for i in range(400))
    for i in range(900, 905):
        assert got[i].component == i and got[i].keep
    assert got[905].component == got[0].component and not got[905].keep and None not in got and got[906].keep
    assert op3.components_of_embeddings(df.where("false")).count() == 0


@pytest.fixture(scope="session")
def language_model():
    return op4.Classifier({"en": ["the quick brown fox and the lazy dog that was with this thing"] * 3, "de": ["der schnelle braune fuchs und die nicht für über ein mädchen ist schön"] * 3})


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    best = scores[0].astype(float)
    back = []
    for t in range(1, n):
        options = best[None, :] - penalty * (1 - np.eye(k))
        back.append(options.argmax(axis=1))
        best = options.max(axis=1) + scores[t]
    return best.max()


def path_score(scores, labels, penalty):
    return sum(scores[t, s] for t, s in enumerate(labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:], strict=False))


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    counts = [0, 5, 1, 40, 0, 17]
    first = np.r_[0, np.cumsum(counts)]
    scores = rng.standard_normal((sum(counts), 4)).astype(np.float32) * 3
    labels = op4.viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            assert abs(path_score(scores[a:b], labels[a:b].tolist(), 2.0) - brute_viterbi(scores[a:b], 2.0)) < 1e-3


def test_language(docs, none, language_model):
    got = {(r.doc_id, r.n_chars): r for r in op4.identified(clashing(docs), language_model).collect()}
    assert len(got) == len({(r.doc_id, r.n_chars) for r in docs.collect()}) and op4.identified(clashing(docs), language_model).count() == docs.count()
    german = next(r for k, r in got.items() if k[0] == 15)
    assert german.main_lang == "de" and german.keep and german.spans[-1].end_word == german.n_words
    for i in (9, 10, 12):
        r = next(r for k, r in got.items() if k[0] == i)
        assert r.main_lang is None and not r.keep and r.spans == []
    assert op4.identified(none, language_model).count() == 0
    langs, shares, _, _, spans = op4.labelled(pa.array(["the fox and the dog Привет мой мир 12 東京", "99 %%"]), language_model, op4.PENALTY)
    assert langs == ["en", None] and [s["lang"] for s in spans.to_pylist()[0]] == ["en", "ru", "zh"]
    assert [s["end_word"] for s in spans.to_pylist()[0]][-1] == 10 and shares[1] is None


def test_mixed_texts_stay_and_noise_goes(spark, language_model):
    df = spark.createDataFrame([(1, "the fox and the dog der fuchs und die мой мир новый"), (2, "12 %% 99 ## 1 2 3 4 5 6 7 8 9 the"), (3, "| the | fox | and |")], "doc_id long, text string")
    assert {r.doc_id: r.keep for r in op4.identified(df, language_model).collect()} == {1: True, 2: False, 3: True}


def test_language_without_labels(none, spark):
    model = op4.fitted(none, op4.LANGUAGES, 10)
    df = spark.createDataFrame([(1, "only latin words"), (2, "мир")], "doc_id long, text string")
    assert {r.doc_id: r.main_lang for r in op4.identified(df, model).collect()} == {1: None, 2: "ru"}


def test_mixing(docs, none, spark):
    rows = [(i, f"t{i}", "en", "abc"[min(i % 7, 2)], i) for i in range(700)]
    df = spark.createDataFrame(rows + [(0, "t0", "en", "a", 0), (None, "x", "en", "a", 0), (5000, "x", "en", None, 0), (5001, None, None, "b", None)], SCHEMA)
    weights = {"a": 1, "b": 2, "c": 1, "unknown": 5}
    got = op9.mixed(df, weights, block=4, shard_docs=16).collect()
    counts = defaultdict(int)
    for r in got:
        counts[r.source] += 1
    sizes = {"a": 101, "b": 101, "c": 500}
    assert counts == op9.quotas(sizes, weights) == {"a": 50, "b": 101, "c": 50}
    ids = [(r.doc_id, r.source) for r in got]
    assert len(set(ids)) == len(ids) - (ids.count((0, "a")) == 2)  # the repeated row may be drawn twice, being two documents
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and max(map(len, shards.values())) <= 24
    assert sorted(map(str, op9.mixed(df, weights, block=4, shard_docs=16).collect())) == sorted(map(str, got))
    assert op9.mixed(none).count() == 0 and op9.mixed(docs, {"nothing": 1}).count() == 0
    assert op9.mixed(clashing(docs)).count() == op9.mixed(docs).count() > 0
    with pytest.raises(ValueError):
        op9.quotas({"a": 1}, {"a": -1.0})


def test_mixing_matches_plain_loops(spark):
    """Every place, drawn again row by row from the hashes, quotas, tree and permutation."""
    from pyspark.sql import functions as F

    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(900)] + [(3, "c"), (3, "c"), (None, "a"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("text", F.lit(None).cast("string"))
    weights, block, shard_docs = {"a": 1.0, "b": 3.0, "c": 2.0}, 4, 16
    copies, keyed = defaultdict(int), []
    for i, s in rows:
        if i is not None and s is not None:
            copies[i, s] += 1
            keyed.append((i, s, copies[i, s]))
    hashed = spark.createDataFrame(keyed, "i long, s string, c long").select("i", "s", "c", F.xxhash64(F.lit(op9.SEED), "s", "i", "c").alias("h"), F.xxhash64(F.lit(op9.SEED + 1), "s", "i", "c").alias("g")).collect()
    sizes = {s: sum(r.s == s for r in hashed) for s in "abc"}
    quota = op9.quotas(sizes, weights)
    scarcest = min(sizes[s] / weights[s] for s in "abc")
    assert quota == {s: int(scarcest * weights[s] + 1e-9) for s in "abc"}
    names = sorted(s for s in quota if quota[s])
    counts = [-(-quota[s] // block) for s in names]
    shards = -(-sum(quota.values()) // shard_docs)
    table = op9.split(np.array(counts), shards)
    home = {}
    for k, s in enumerate(names):
        order = op9.permuted(np.arange(counts[k]), counts[k], op9.SEED + k).tolist()
        assert sorted(order) == list(range(counts[k]))
        for shard in range(shards):
            for _ in range(table[shard, k]):
                home[s, order.pop(0)] = shard
    by_shard = defaultdict(list)
    for s in names:
        for rank, r in enumerate(sorted((r for r in hashed if r.s == s), key=lambda r: (r.h, r.i, r.c))[: quota[s]]):
            by_shard[home[s, rank // block]].append(r)
    want = {(r.i, r.s, shard, p) for shard, own in by_shard.items() for p, r in enumerate(sorted(own, key=lambda r: (r.g, r.s, r.i, r.c)))}
    got = [(r.doc_id, r.source, r.shard, r.position) for r in op9.mixed(df, weights, block, shard_docs).collect()]
    assert len(got) == len(want) == sum(quota.values()) and set(got) == want


def test_subtrees_are_drawn_apart():
    blocks, shards = np.array([1000, 70, 0, 313]), 213
    total = int(blocks.sum())
    table = op9.split(blocks, shards)
    parts = list(op9.draw(0, shards, blocks, total, shards, op9.SEED, 20))
    again = [own for low, high, have in parts for _, _, own in op9.draw(low, high, have, total, shards, op9.SEED)]
    assert len(parts) > 5 and np.array_equal(np.stack(again), table)
    for n in (1, 2, 3, 17, 4096, 5000):
        assert sorted(op9.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_scripts_without_blanks():
    model = op4.Classifier({"en": ["the quick brown fox and the lazy dog that was with this thing"] * 3, "de": ["der schnelle braune fuchs und die nicht für über ein mädchen ist schön"] * 3})
    for text, expected in (
        ("日本語の文章です。これは難しいですか", [(0, 6, "ja")]),
        ("这是一个中文句子没有空格", [(0, 1, "zh")]),
        ("the fox日本語のテキストand the dog", [(0, 2, "en"), (2, 4, "ja"), (4, 7, "en")]),
        ("Це українська мова і вона має літери", [(0, 7, "uk")]),
        ("это русский язык и он ещё имеет буквы", [(0, 8, "ru")]),
        ("این یک متن فارسی است که", [(0, 6, "fa")]),
        ("هذه جملة باللغة العربية", [(0, 4, "ar")]),
        ("\U00020000\U00020001 the fox", [(0, 1, "zh"), (1, 3, "en")]),
    ):
        spans = op4.labelled(pa.array([text]), model, op4.PENALTY)[-1].to_pylist()[0]
        assert [(x["first_word"], x["end_word"], x["lang"]) for x in spans] == expected, text


def test_splitting_tree():
    blocks = np.array([100, 7, 0, 31])
    table = op9.split(blocks, 13)
    assert table.sum(axis=0).tolist() == blocks.tolist() and np.ptp(table.sum(axis=1)) <= 1 and (table >= 0).all()
    draws = np.array([op9.split(np.array([30, 10]), 4, seed)[0, 1] for seed in range(300)])
    assert abs(draws.mean() - 2.5) < 0.25  # a shard of ten blocks gets a quarter of the rarer source


@pytest.fixture(scope="session")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=op1.MODEL)


def test_encoding_matches_the_library(docs, none, library):
    texts = [t for t in TEXTS if t is not None] + ["a  b\n\n\tc " + " " * 40 + "x", "東京 😀 naïve\x00", "aaaaaaaaaaaaaaaaaaaaaaaa", "don't <s> </s>"]
    rng = np.random.default_rng(9)
    texts += ["".join(rng.choice(list("etaoin shr\n.,Théß東"), int(rng.integers(0, 80)))) for _ in range(400)]
    v = op1.vocabulary(op1.MODEL)
    assert op1.encode_column(pa.array(texts), v).to_pylist() == [library.encode(t) for t in texts]
    assert op1.decode_column(op1.encode_column(pa.array(texts), v), v).to_pylist() == [t.encode() for t in texts]
    got = op1.encoded(clashing(docs)).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got if r.ids is not None) and sum(r.ids is None for r in got) == 2
    assert op1.encoded(none).count() == 0
    assert op1.decode_column(op1.encode_column(pa.array(["a▁b", None]), v), v).to_pylist() == [b"a b", None]


def test_a_finished_task_holds_no_vocabulary(spark):
    """Of an idle worker's memory nothing is the vocabulary's."""
    from pyspark.sql import functions as F

    def held(batches):
        yield pa.record_batch([pa.array([len(op1._loaded)])], names=["n"])

    texts = spark.range(8).repartition(4).select(F.concat(F.lit("some text "), "id").alias("text"))
    assert op1.encoded(texts).where("round_trip").count() == 8
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_streaming_holds_a_bounded_window(library):
    v = op1.vocabulary(op1.MODEL)
    text = (op1.MARK + " ".join(words(3000, 12))).replace(" ", op1.MARK)
    search, ids, held = op1.StreamingViterbi(v), [], 0
    for c in text:
        ids += search.feed(c)
        held = max(held, len(search.piece))
    ids += search.finish()
    assert ids == library.encode(text[1:].replace(op1.MARK, " ")) and held <= 8 * v.longest


def test_compatible_pairs_match_merging():
    v = op1.vocabulary(op1.MODEL)
    rng = np.random.default_rng(11)
    pieces = list(v.id)
    for _ in range(3000):
        a, b = pieces[int(rng.integers(0, len(pieces)))], pieces[int(rng.integers(0, len(pieces)))]
        assert v._compatible(a, b) == (v.merges([*a, *b]) == [a, b])


def test_language_held_out():
    """Main languages of documents outside the sample, and spans of two of them joined."""
    d = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas().dropna().sort_values("doc_id")
    d = d[d.text.str.split().str.len() >= 5].drop_duplicates("text")
    nth = d.groupby("lang").cumcount()
    sample, rest = d[nth < op4.SAMPLE], d[(nth >= op4.SAMPLE) & (nth < op4.SAMPLE + 200) & d.lang.isin(op4.LANGUAGES)]
    model = op4.Classifier({k: sample[sample.lang == k].text.tolist() for k in op4.LANGUAGES})
    langs = op4.labelled(pa.array(rest.text.tolist()), model, op4.PENALTY)[0]
    assert len(rest) == 800 and (rest.lang.to_numpy() == np.array(langs)).mean() >= 0.99
    parts = {k: [t.split()[:60] for t in rest[rest.lang == k].text] for k in op4.LANGUAGES}
    texts, expected = [], []
    for k in range(150):
        a, b = op4.LANGUAGES[k % 4], op4.LANGUAGES[(k % 4 + 1 + k // 4 % 3) % 4]
        texts.append(" ".join(parts[a][k] + parts[b][k]))
        expected += [a] * len(parts[a][k]) + [b] * len(parts[b][k])
    spans = op4.labelled(pa.array(texts), model, op4.PENALTY)[-1]
    got = [x["lang"] for row in spans.to_pylist() for x in row for _ in range(x["end_word"] - x["first_word"])]
    assert (np.array(got) == np.array(expected)).mean() >= 0.99


def toxic_texts():
    rng = np.random.default_rng(13)
    texts, labels = [], []
    for i in range(500):
        w = list(rng.choice(VOCABULARY, int(rng.integers(5, 150))))
        bad = i % 2 == 0
        if bad:
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(["zworthy", "zworthable", "Zscumly", "xtrashed"]))
        texts.append(" ".join(w))
        labels.append(bad)
    return texts, np.array(labels)


def test_toxicity(docs, none, spark):
    texts, toxic = toxic_texts()
    model = op2.fit(texts[:350], toxic[:350])
    top, _, _ = model.scores(pa.array(texts[350:]))
    assert ((top >= 0.5) == toxic[350:]).mean() >= 0.95  # held out
    w = words(100, 40)
    w[70] = "zworthy"
    top, where, number = model.scores(pa.array([" ".join(w), "", "zworthy"]))
    assert top[0] >= 0.5 and where[0] <= 70 < where[0] + op2.WINDOW and number.tolist() == [6, 0, 1] and where[1] == -1
    got = op2.scored(clashing(docs), model).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[12].toxicity is None and by_id[12].n_windows == 0 and by_id[9].toxicity == 0.0 and not by_id[9].toxic
    assert by_id[14].n_windows == -(-(30_000 - op2.WINDOW) // op2.STRIDE) + 1
    assert op2.scored(none, model).count() == 0
    labels = spark.createDataFrame([(0, 1), (1, 1), (None, 0)], "doc_id long, toxic int")
    assert op2.fitted(docs, labels) is None
    assert all(r.toxicity is None for r in op2.scored(docs, None).collect())


def test_toxicity_at_every_offset():
    """Each text's score is the highest of windows that begin at every word, wherever its passage lies."""
    r = np.random.default_rng(4)
    model = op2.Model(*(r.standard_normal((2, 1 << op2.BITS)).astype(np.float32) * 3), op2.Network(1))
    rows = [" ".join(words(offset, 50) + words(24, 53) + words(60 - offset, 51)) for offset in range(40)] + [" ".join(words(n, 52)) for n in (3, 24, 25, 90)]
    top, where, _ = model.scores(pa.array(rows))
    for i, row in enumerate(rows):
        w = row.split()
        one, _, _ = model.scores(pa.array([" ".join(w[k : k + op2.WINDOW]) for k in range(max(len(w) - op2.WINDOW, 0) + 1)]))
        assert abs(top[i] - one.max()) < 1e-4 and abs(one[where[i]] - one.max()) < 1e-4, i


def plain_score(model, words_):
    """Highest probability of a text's windows and its first word, one word after another in float64."""
    p = {k: v.astype(float) for k, v in model.network.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    lex = op2.Lexicon(op2.Words(pa.array([" ".join(words_)])))
    x = (model.inputs(lex).astype(float)[lex.which] - p["shift"]) * p["scale"]
    h, found = op2.HIDDEN, []
    for first in range(max(len(words_) - op2.WINDOW, 0) + 1):
        rows = x[first : first + op2.WINDOW]
        states = np.zeros((len(rows), 2 * h))
        for k, d in enumerate("fb"):
            s = np.zeros(h)
            if d == "b":  # a short text's window is padded at its end, which the backward pass reads first
                for _ in range(op2.WINDOW - len(rows)):
                    y, i = s @ p["ub"], p["bb"]
                    z, r = sigmoid(i[:h] + y[:h]), sigmoid(i[h : 2 * h] + y[h : 2 * h])
                    s = (1 - z) * np.tanh(i[2 * h :] + r * (y[2 * h :] + p["nb"])) + z * s
            for t in range(len(rows)) if d == "f" else range(len(rows) - 1, -1, -1):
                i, y = rows[t] @ p["w" + d] + p["b" + d], s @ p["u" + d]
                z, r = sigmoid(i[:h] + y[:h]), sigmoid(i[h : 2 * h] + y[h : 2 * h])
                s = (1 - z) * np.tanh(i[2 * h :] + r * (y[2 * h :] + p["n" + d])) + z * s
                states[t, k * h : (k + 1) * h] = s
        weight = np.exp(np.tanh(states @ p["wa"] + p["ba"]) @ p["va"])
        found.append(float(sigmoid(weight / weight.sum() @ states @ p["v"] + p["c"][0])))
    return max(found), int(np.argmax(found))


def test_scores_match_plain_loops():
    texts, toxic = toxic_texts()
    model = op2.fit(texts[:120], toxic[:120])
    rows = texts[120:140] + [" ".join(words(n, 60 + n)) for n in (1, 5, 24, 25, 300)]
    top, where, _ = model.scores(pa.array(rows))
    for i, row in enumerate(rows):
        best, at = plain_score(model, row.split())
        assert abs(top[i] - best) < 1e-3 and (where[i] == at or abs(plain_score(model, row.split()[where[i] : where[i] + op2.WINDOW])[0] - best) < 1e-3), i
    same = " ".join(words(24, 70))  # equal windows: the first counts
    top, where, _ = model.scores(pa.array([" ".join(["w"] * 60), same]))
    assert where.tolist() == [0, 0]


def test_adjacent_windows_take_little_memory():
    """Logits are those of windows taken one by one, and what is worked on is under 1.5 kB a window."""
    import tracemalloc

    r = np.random.default_rng(6)
    net, features, which = op2.Network(2), r.standard_normal((500, op2.FEATURES)).astype(np.float32), r.integers(0, 500, op2.SIDE + op2.WINDOW - 1)
    net.p |= {k: r.standard_normal(net.p[k].shape).astype(np.float32) for k in ("nf", "nb", "ba", "c")}
    inputs = net.inputs(features)
    tracemalloc.start()
    got = net.adjacent(inputs, which)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    start = np.arange(op2.SIDE)
    index, held = op2.gathered(start, start + op2.WINDOW, which, 500)
    assert held.all() and np.abs(got - net.forward(inputs, index, held)).max() < 1e-4
    assert peak < 1500 * op2.SIDE


def test_distinct_values_match_numpy():
    x = np.random.default_rng(8).integers(0, 2**64, 300, dtype=np.uint64)[np.random.default_rng(9).integers(0, 300, 900)]
    for values in (x, x[:0]):
        _, one, which = np.unique(values, return_index=True, return_inverse=True)
        got = op2._distinct(values)
        assert np.array_equal(got[0], one) and np.array_equal(got[1], which)


def test_toxicity_held_out():
    """What the README says of sf0.01: four folds, each fitted on the other three."""
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pandas().merge(pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas(), on="doc_id").dropna()
    d = d[d.text.str.strip() != ""].sample(frac=1, random_state=1)
    toxic, texts, found = d.toxic.to_numpy().astype(bool), d.text.to_numpy(), np.zeros(len(d), bool)
    for fold in range(4):
        test = np.arange(len(d)) % 4 == fold
        found[test] = op2.fit(list(texts[~test]), toxic[~test]).scores(pa.array(list(texts[test])))[0] >= op2.THRESHOLD
    assert found[toxic].mean() >= 0.7 and (found == toxic).mean() >= 0.93


def test_gradients():
    r = np.random.default_rng(0)
    net = op2.Network(1)
    features = r.standard_normal((30, op2.FEATURES)).astype(np.float32)
    index, held = r.integers(0, 30, (5, 7)), np.ones((5, 7), bool)
    held[3:, 2] = False
    label = (r.random(7) > 0.5).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    learned = {}
    net.gradients(features, index, held, label, learned)
    for row, column in ((learned["rows"][0], 0), (learned["rows"][-1], 5)):  # gradients of learned inputs
        sides = []
        for step in (1e-2, -1e-2):
            moved = features.copy()
            moved[row, op2.COUNTED + column] += step
            sides.append(net.gradients(moved, index, held, label)[0])
        assert abs((sides[0] - sides[1]) / 2e-2 - learned["d"][list(learned["rows"]).index(row), column]) < 3e-3
    _, g = net.gradients(features, index, held, label)
    for k in g:
        at = tuple(int(r.integers(0, s)) for s in net.p[k].shape)
        old, e, sides = net.p[k][at], 1e-2, []
        for step in (e, -e):
            net.p[k][at] = old + step
            sides.append(net.gradients(features, index, held, label)[0])
        net.p[k][at] = old
        assert abs((sides[0] - sides[1]) / 2 / e - g[k][at]) < 3e-3, k
