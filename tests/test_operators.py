"""Relational operators on hand-computed tables and against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.lang.lexer import SyntaxProblem
from plumbline.lang.parser import parse_functions
from plumbline.operators import coverage as C
from plumbline.operators import graph as G
from plumbline.operators import history as H
from plumbline.operators import report as R
from plumbline.operators import scoring as S
from plumbline.policy import WHOLE_FILE_END


@pytest.mark.parametrize(("n", "p95", "p99"), [(20, 19, 19), (21, 19, 20), (40, 38, 39), (100, 95, 99)])
def test_order_statistics(spark, n, p95, p99):
    r = S.order_statistics(spark.range(n), ["id"]).first()
    assert (r.n, r.max_value, r.p95, r.p99) == (n, n - 1, p95, p99)


@pytest.mark.parametrize(("ones", "cap"), [(19, 100.0), (99, 100.0), (199, 1.0)])
def test_caps(spark, ones, cap):
    df = spark.createDataFrame([(1,)] * ones + [(100,)], "x long")
    assert S.caps_row(df, ["x"]).first().cap_x == cap
    assert S.caps_row(df.where("false"), ["x"]).first().cap_x == 1.0


def test_percentiles(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)], "k long, x double")
    got = {r.k: r.p for r in S.with_percentiles(df, {"x": "p"}).collect()}
    assert got[1] == 0 and got[4] == 100 and math.isclose(got[2], 100 / 3) and got[2] == got[3]
    assert S.with_percentiles(df.where("k = 1"), {"x": "p"}).first().p == 100
    rows = [(i, float((i * 7919) % 83)) for i in range(300)]
    got = {r.k: r.p for r in S.with_percentiles(spark.createDataFrame(rows, "k long, x double"), {"x": "p"}).collect()}
    assert all(math.isclose(got[k], sum(y < x for _, y in rows) / 299 * 100) for k, x in rows)


def test_velocity_and_drivers(spark):
    pairs = [(1, 1, "stable"), (1, 2, "accelerating"), (1, 18, "cooling"), (1, 13, "stable"), (1, 10, "accelerating")]
    df = spark.createDataFrame(pairs, "d7 long, d90 long, want string")
    assert df.where(X.velocity("d7", "d90") != F.col("want")).count() == 0
    tie = {m: F.lit(0.0) for m in ("churn_recent", "fan_in", "cyclomatic", "loc", "authors", "coverage_gap")} | {"cognitive": F.lit(0.2), "churn": F.lit(0.3)}
    assert spark.range(1).select(X.primary_driver(tie).alias("d")).first().d == "cognitive"
    quality = spark.createDataFrame([(0, 9, "missing"), (79, 8, "sparse"), (80, 8, "adequate"), (10, 7, "adequate")], "b long, c long, want string")
    assert quality.where(X.doc_quality("b", "c") != F.col("want")).count() == 0


def test_text_expressions(spark):
    names = [("Self::analyze", "analyze"), ("git::commit::push", "push"), ("this.process", "process"), ("Option::<T>::unwrap", "unwrap"), ("ptr->method", "method"), ("??", "")]
    assert spark.createDataFrame(names, "t string, want string").where(X.call_name("t") != F.col("want")).count() == 0
    r = spark.createDataFrame([("// a\n\n/* b\n * c */\nx = 1; // FooBar todo\n",)], "t string").select(X.comment_lines("t").alias("c"), X.solid_lines("t").alias("s"), X.placeholder_count("t").alias("p")).first()
    assert (r.c, r.s, r.p) == (3, 4, 3)


def test_white_space_around_comments(spark):
    rows = [("\t// a\n\t\n\t * b\nx", 2, 3), (" \t\n\u00a0\n", 0, 0), ("\u3000/* a\r\nb\r\n", 1, 2), ("", 0, 0)]
    df = spark.createDataFrame(rows, "t string, c long, s long")
    assert df.where((X.comment_lines("t") != F.col("c")) | (X.solid_lines("t") != F.col("s"))).count() == 0


def test_content_hash(spark, tmp_path):
    """Published test values of the 128-bit hash: of nothing, and of one letter."""
    from plumbline.plans import catalog

    spark.createDataFrame([(1, ""), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.content_hash for r in catalog.content_hash(spark, str(tmp_path)).collect()}
    assert got == {1: "99aa06d3014798d86001c324468d497f", 2: "a96faf705af16834e6c632b61e964e1f", 3: None}


def test_churn(spark):
    rows = [("a", "c1", "x", 0, False), ("a", "c1", "x", 0, False), ("a", "c2", "y", 8 * 86400, True), ("a", "c3", "y", 8 * 86400, False)]
    df = spark.createDataFrame(rows, "path string, commit string, author string, ts long, is_bug_fix boolean")
    r = H.churn(df, ["path"]).first()
    assert (r.times_modified, r.bug_fix_commits, r.authors_count, r.d7_modifications, r.d30_modifications) == (3, 1, 2, 2, 3)
    assert math.isclose(r.churn_score, 5 * math.log10(3))
    more = [("b", f"c{i % 7}", f"x{i * i % 5}" if i % 4 else None, i * 40_000, i % 6 == 0) for i in range(200)] + [("d", "c", None, 5, False)]
    got = {r.path: r for r in H.churn(spark.createDataFrame(more, df.schema), ["path"]).collect()}
    last = {c: max(t for _, k, _, t, _ in more[:-1] if k == c) for c in {x[1] for x in more[:-1]}}
    b = got["b"]
    assert (b.times_modified, b.bug_fix_commits, b.authors_count, b.d7_modifications) == (7, len({c for _, c, _, _, x in more[:-1] if x}), len({a for _, _, a, _, _ in more[:-1] if a}), sum(t >= max(last.values()) - 7 * 86400 for t in last.values()))
    assert (got["d"].times_modified, got["d"].authors_count) == (1, 1)


def test_churn_sends_its_rows_once_to_all_partitions(spark):
    """Partitions that are merged to as many as cores hold more memory as the input grows."""
    df = spark.range(0, 50, 1, 2).select((F.col("id") % 20).alias("path"), F.col("id").alias("commit"), (F.col("id") % 3).alias("author"), F.col("id").alias("ts"), F.lit(False).alias("is_bug_fix"))
    out = H.churn(df, ["path"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_range_join_matches_nested_loop(spark):
    functions = [(i % 3, f"f{i}", i * 7 % 200 + 1, i * 7 % 200 + 1 + i * 13 % 150) for i in range(60)]
    changes = [(i % 4, f"c{i}", i * 11 % 300 + 1, i * 11 % 300 + i * 5 % 90 + 1, i) for i in range(80)] + [(0, "root", 1, WHOLE_FILE_END, 0)]
    f = spark.createDataFrame(functions, "file long, name string, line long, end_line long")
    c = spark.createDataFrame(changes, "path long, commit string, start_line long, end_line long, ts long")
    got = sorted((r.name, r.commit) for r in H.overlapping(f, c).collect())
    assert got == sorted((n, k) for a, n, x, y in functions for p, k, s, e, _ in changes if a == p and x <= e and s <= y)


def test_renames(spark):
    renames = [("a", "b", 1), ("b", "c", 1), ("x", "y", 1), ("y", "x", 1), ("p", "wrong", 1), ("p", "q", 2)]
    closure = H.rename_closure(H.rename_aliases(spark.createDataFrame(renames, "old_path string, new_path string, seq long")))
    assert {(r.old_path, r.final_path) for r in closure.collect()} == {("a", "c"), ("b", "c"), ("x", "x"), ("y", "y"), ("p", "q")}
    assert H.rename_closure(closure.where("false").withColumnRenamed("final_path", "new_path")).count() == 0
    # a long chain, a cycle of three with a tail of two, a path renamed to itself
    long = [(f"n{i}", f"n{i + 1}", 1) for i in range(37)] + [("r", "s", 1), ("s", "t", 1), ("t", "r", 1), ("v", "u", 1), ("u", "s", 1), ("z", "z", 1)]
    found = {r.old_path: r.final_path for r in H.rename_closure(H.rename_aliases(spark.createDataFrame(long, "old_path string, new_path string, seq long"))).collect()}
    assert found == {f"n{i}": "n37" for i in range(37)} | {"r": "r", "s": "s", "t": "t", "u": "s", "v": "s", "z": "z"}
    paths = spark.createDataFrame([("a",), ("c",), ("x",)], "path string")
    assert sorted(r.path for r in H.with_renames(paths, closure).collect()) == ["a", "c", "c", "x"]


@pytest.mark.parametrize(("counts", "want"), [((5, 3, 2), 1), ((4, 3, 3), 2), ((), 0), ((1, 1, 1, 1, 1), 3)])
def test_bus_factor(spark, counts, want):
    df = spark.createDataFrame([(f"a{i}", n) for i, n in enumerate(counts)], "author string, contributions long")
    assert H.bus_factor(df).first().bus_factor == want


def test_graph(spark):
    f = spark.createDataFrame([(1, "m.rs", "main", "unreachable_private", 3), (2, "m.rs", "used", "unreachable_private", 4), (3, "m.rs", "dead", "unreachable_private", 5), (4, "x/tests/t.rs", "probe", "unreachable_private", 1)], "key long, file string, name string, kind string, lines_of_code long")
    calls = spark.createDataFrame([(1, "used"), (1, "used"), (3, "dead"), (2, "nobody")], "caller long, callee_name string")
    r = {x.name: x for x in G.reachability(G.coupling(f, G.call_edges(calls, f))).collect()}
    assert r["used"].fan_in == 1 and r["main"].fan_out == 1 and r["main"].instability == 1.0 and not r["dead"].is_reachable
    assert r["main"].kind == "reachable" and r["probe"].kind == "test_only" and r["dead"].kind == "unreachable_private"
    d = G.dead_code(G.reachability(G.coupling(f, G.call_edges(calls, f)))).first()
    assert (d.unreachable_functions, d.unreachable_loc, d.safe_to_delete) == (1, 5, 1)


def test_coupling_by_sums_is_coupling_by_edges(spark):
    import random

    r = random.Random(5)
    functions = [(i, f"file{r.randrange(4)}", f"name{r.randrange(9)}") for i in range(40)]  # names repeat within and across files
    calls = [(r.randrange(45), f"name{r.randrange(12)}") for _ in range(150)] + [(i, n) for i, _, n in functions[:12]]  # unknown callers and names, and functions that call themselves
    f = spark.createDataFrame(functions, "key long, file string, name string")
    c = spark.createDataFrame(calls, "caller long, callee_name string")
    columns = ["key", "has_caller", "fan_in", "fan_out", "instability"]
    want = sorted(map(tuple, G.coupling(f, G.call_edges(c, f)).select(columns).collect()))
    assert sorted(map(tuple, G.coupling_counts(f, c).select(columns).collect())) == want and any(x[2] for x in want)


def test_functions_are_never_broadcast(spark):
    """After explode Spark takes a table to be small, and a broadcast of millions of functions ends the driver."""
    f = spark.range(2).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select(F.concat_ws("/", "id", "i").alias("key"), F.lit("m").alias("file"), F.concat_ws(".", "id", "i").alias("name"))
    calls = spark.range(9).select(F.concat(F.lit("0/"), F.col("id") % 3 + 1).alias("caller"), F.concat(F.lit("1."), F.col("id") % 4).alias("callee_name"))
    for df in (G.coupling_counts(f, calls), G.coupling(f, G.call_edges(calls, f)), G.callers(f, G.call_edges(calls, f)), G.uncalled(f, calls)):
        assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_uncalled_and_callers_match_nested_loop(spark):
    functions = [(f"k{i}", f"file{i % 3}", f"name{i % 7}") for i in range(30)]
    calls = [(f"k{i * 5 % 31}", f"name{i * i % 11}") for i in range(12)] + [("k5", "name5"), ("k5", "name5"), (None, "name6")]
    f, c = spark.createDataFrame(functions, "key string, file string, name string"), spark.createDataFrame(calls, "caller string, callee_name string")
    ref = {k: f"{file}:{name}" for k, file, name in functions}
    edges = {(a, k) for a, called in calls for k, _, name in functions if name == called and a is not None and a != k}
    assert sorted(r.key for r in G.uncalled(f, c).collect()) == sorted(set(ref) - {k for _, k in edges})
    want = {k: sorted({ref[a] for a, b in edges if b == k and a in ref}) for _, k in edges}
    twice = f.unionByName(f)  # a function that is listed twice has one row
    got = G.callers(twice, G.call_edges(c, twice)).collect()
    assert len(got) == len({r.key for r in got}) and {r.key: r.callers for r in got} == {k: x for k, x in want.items() if x}


def test_lcov(spark):
    text = "DA:7,1\nSF:/r/a\nDA:2,1\nDA:2,0\nDA:2, 1\nDA:x,1\nBRDA:2,0,0,0\nBRDA:2,0,1,-\nend_of_record\nDA:5,2\nSF:b\nDA:1,1\nSF:/r/a\nDA:9,3\n"
    lines, branches = C.lcov(C.numbered_lines(spark.createDataFrame([(text,)], "value string")), "/r")
    assert {tuple(x) for x in lines.collect()} == {("a", 9, 3), ("b", 5, 2), ("b", 1, 1)} and branches.count() == 0
    text = "SF: a b\nDA:1,4294967295\nDA:2,4294967296\nDA:4294967296,1\nDA:3,+7\nDA:4,-1\nDA:5\nBRDA:1,0,0, -\nBRDA:2,0,0,-\nBRDA:3,0,0\nBRDA: 4,0,0,1\nend_of_record\n"
    lines, branches = C.lcov(C.numbered_lines(spark.createDataFrame([(text,)], "value string")))
    assert {tuple(x) for x in lines.collect()} == {(" a b", 1, 4294967295), (" a b", 3, 7)}
    assert {tuple(x) for x in branches.collect()} == {(" a b", 1, True), (" a b", 2, False)}


def test_function_coverage_matches_nested_loop(spark):
    functions = [(i, i % 3, i * 17 % 400 + 1, i * 17 % 400 + 1 + i * 29 % 200) for i in range(50)]
    hits = [(p, line, (line * 7 + p) % 3) for p in range(2) for line in range(1, 600, 3)]
    f = spark.createDataFrame(functions, "key long, file long, line long, end_line long")
    lines = spark.createDataFrame(hits, "path long, line long, hits long")
    branches = spark.createDataFrame([(p, line, h > 1) for p, line, h in hits if line % 2], "path long, line long, taken boolean")
    got = {r.key: (r.line_coverage, r.branch_coverage) for r in C.function_coverage(f, lines, branches).collect()}
    mean = lambda x: sum(x) / len(x) if x else None
    for k, file, a, b in functions:
        own = [(line, h) for p, line, h in hits if p == file and a <= line <= b]
        assert (k in got) == (file < 2) and (file == 2 or got[k] == (mean([h > 0 for _, h in own]) or 0.0, mean([h > 1 for line, h in own if line % 2]))), k


def test_sorting(spark):
    assert R.sort_metric("risk_score") == ("risk", True) and R.sort_metric("nope") == ("location", False)
    f = spark.createDataFrame([("a", "x", 1, 5), ("b", "y", 1, 9), ("a", "w", 2, 9)], "file string, name string, line long, cognitive long")
    assert [r.name for r in R.sorted_report(f, "cognitive", {"cognitive": "cognitive"}).collect()] == ["w", "y", "x"]
    assert R.sorted_report(f, None, {}, 0).count() == 0 and R.sorted_report(f, "loc", {"loc": "cognitive"}, 1).first().name == "w"


def metrics(source, language):
    return [(r["name"], r["cyclomatic_complexity"], r["cognitive_complexity"], r["nesting_depth"]) for r in parse_functions(source, "f", language)]


def test_parser():
    assert metrics("function f(x: number) {\n  if (x) {}\n}\n", "ts") == [("f", 2, 1, 1)]
    assert metrics("function outer() { function inner(y) { if (y) { return 1; } } return inner; }", "ts") == [("outer", 1, 0, 0), ("inner", 2, 1, 1)]
    assert metrics("const f = (x) => { if (x) { g(); } };", "ts") == [("f", 2, 1, 1)]
    assert metrics("fn f(x: i32) -> i32 { match x { 1 => 1, 2 => 2, _ => 3, } }", "rust") == [("f", 8, 1, 0)]
    assert metrics("fn f(x: i32) { match x { 1 => { if x > 0 { a(); } } _ => {} } }", "rust")[0][2] == 2
    assert metrics("fn f(x: i32) { if x > 0 { match x { 1 => {}, _ => {} } } }", "rust")[0][2] == 3
    assert metrics("fn f() { if a {} else if b {} }", "rust")[0][2] == 3
    assert metrics("int f(int a) { do { a--; } while (a && b || c); return a ? 1 : 0; }", "c") == [("f", 5, 4, 1)]
    kinds = {r["name"]: (r["exported"], r["test_entry"]) for r in parse_functions("pub fn a() {}\nimpl S { pub fn b(&self) {} fn c(&self) {} }\n#[tokio::test]\nasync fn d() {}\nimpl Show for S { fn e(&self) {} }", "f", "rust")}
    assert kinds == {"a": (True, False), "b": (True, False), "c": (False, False), "d": (False, True), "e": (True, False)}
    assert [r["name"] for r in parse_functions("export function App() {\n  return <div title=\"x\">it's {items.map(i => <b key={i}>{i}</b>)}</div>;\n}", "f", "tsx")][0] == "App"
    for text, language in (("function broken( {", "ts"), ("fn f() {", "rust"), ("int f(void) { \"open }", "c")):
        with pytest.raises(SyntaxProblem):
            parse_functions(text, "f", language)
