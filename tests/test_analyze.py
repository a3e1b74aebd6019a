"""End to end on small repositories: parse, history, coverage, state."""

import json
import math
import subprocess

import pytest

from plumbline.lang.lexer import SyntaxProblem
from plumbline.lang.parser import Parser
from plumbline.lang.spec import BY_NAME
from plumbline.plans.analyze import analyze


class Repository:
    def __init__(self, root):
        self.root = root
        self.git("init", "-q", "-b", "main")

    def git(self, *args):
        subprocess.run(["git", "-C", str(self.root), "-c", "user.name=Test User", "-c", "user.email=test@example.com", *args], check=True, capture_output=True)

    def write(self, path, text):
        p = self.root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    def commit(self, message):
        self.git("add", "-A", "--", ".", ":!.plumbline")
        self.git("commit", "-q", "-m", message)


@pytest.fixture
def repository(tmp_path):
    return Repository(tmp_path)


def report(spark, r, **more):
    return json.loads(analyze(spark, str(r.root), **more).first().report)


TWO = "function a(x: number) {\n  if (x) {}\n}\nconst b = () => {};\n"


def test_small_repository(spark, repository):
    repository.write("src/index.ts", TWO)
    repository.commit("first")
    r = report(spark, repository)
    assert r["schema_version"] == "0.4.0" and r["quality"]["git"]["processed_commits"] == 1
    assert r["quality"]["status"] == "complete" and not r["quality"]["warnings"] and r["quality"]["git"]["cache_reset"]
    a, b = r["functions"]
    assert (a["name"], b["name"]) == ("a", "b") and (a["cyclomatic_complexity"], b["cyclomatic_complexity"]) == (2, 1)
    assert a["normalized"]["cyclomatic"] == 1 and math.isclose(b["normalized"]["cyclomatic"], math.log(2) / math.log(3), abs_tol=1e-12)
    assert math.isclose(b["normalized"]["loc"], 0.5) and a["percentile"]["risk"] == 100 and b["percentile"]["risk"] == 0
    assert a["times_modified"] == 1 and a["churn"]["velocity"] == "stable" and len(a["body_hash"]) == 32 and a["authors"] is None
    again = report(spark, repository, include_authors=True)
    assert again["quality"]["cache"]["ast_hits"] == 1 and not again["quality"]["git"]["cache_reset"]
    assert again["analysis"] == r["analysis"] and again["functions"][0]["authors"] == ["test@example.com"]
    # a dirty file misses the memo
    repository.write("src/index.ts", "function fresh() { return 1; }\n")
    dirty = report(spark, repository)
    assert [f["name"] for f in dirty["functions"]] == ["fresh"] and dirty["quality"]["cache"]["ast_misses"] == 1
    # a branch resets the history
    repository.git("checkout", "-q", "-b", "other")
    assert report(spark, repository)["quality"]["git"]["cache_reset"]


def test_template_interpolations():
    source = "export function show(x) {\n  return `<${x ? `a${format(x)}` : 'n'}${[x].map((y) => y && y.z)}> \\${skipped(x)}`;\n}\n"
    show, arrow = Parser(source, BY_NAME["ts"]).run()
    assert show.name == "show" and show.cyclomatic == 2 and show.cognitive == 1
    assert "format" in show.identifiers and "map" in show.identifiers and "skipped" not in show.identifiers
    assert arrow.cyclomatic == 2 and sorted(arrow.identifiers) == ["y", "y", "y", "z"]
    for broken in ("`${(1}`", "`${1", "`${1}", "`${1)}`"):
        with pytest.raises(SyntaxProblem):
            Parser(f"function f() {{ return {broken}; }}", BY_NAME["ts"])


def test_class_fields_and_do():
    for header in ("Foo extends React.Component<Props, State>", "Foo extends Base<{ a: string }> implements One, Two", "Foo"):
        named = {f.name: f.exported for f in Parser(f"class {header} {{ handle = (e) => {{ return e; }}; run() {{ const x = () => 1; y = () => 2; }} }}", BY_NAME["ts"]).run()}
        assert named == {"handle": True, "run": False, "x": False, "y": False}, header
    long = "x = f(" + ", ".join(["a"] * 60) + ");"
    for body in (f"do {long} while (a);", "do { b(); } while (a)", "do b()\n while (a);", f"do if (a) {{ {long} }} while (a);"):
        (f,) = Parser(f"function f() {{ {body} }}", BY_NAME["ts"]).run()
        (g,) = Parser(f"function f() {{ {body} while (c) {{}} }}", BY_NAME["ts"]).run()
        assert g.cyclomatic == f.cyclomatic + 1 and g.cognitive == f.cognitive + 1, body
    (f,) = Parser(f"function f() {{ do {long} while (a); }}", BY_NAME["ts"]).run()
    (g,) = Parser("function f() { do { x(); } while (a); }", BY_NAME["ts"]).run()
    assert (f.cyclomatic, f.cognitive) == (g.cyclomatic, g.cognitive)
    (f,) = Parser("function f() { do x(); while (a); while (b); }", BY_NAME["ts"]).run()
    assert f.cognitive == 2


def test_history(spark, repository):
    body = "export function entry(x) {\n  return helper(x);\n}\nfunction helper(y) {\n  return y;\n}\nfunction unused(z) {\n  const value = z;\n  return value;\n}\n"
    repository.write("plumbline.toml", '[git]\nbug_fix_patterns = ["CL-[0-9]+"]\n')
    repository.write("src/old.ts", body)
    repository.commit("start")
    repository.git("mv", "src/old.ts", "src/new.ts")
    repository.commit("CL-123 move")
    repository.write("coverage/lcov.info", "SF:src/new.ts\nDA:1,1\nDA:2,0\nDA:3,1\nBRDA:2,0,0,0\nBRDA:2,0,1,-\nend_of_record\n")
    repository.write("src/broken.ts", "function broken( {\n")
    r = report(spark, repository, sort="cognitive", limit=2)
    assert r["quality"]["status"] == "partial" and [s["path"] for s in r["quality"]["skipped_files"]] == ["src/broken.ts"]
    assert len(r["functions"]) == 2 and r["summary"]["total_functions"] == 2
    every = {f["name"]: f for f in report(spark, repository)["functions"]}
    entry, helper, unused = every["entry"], every["helper"], every["unused"]
    assert entry["times_modified"] >= 2 and entry["bug_fix_commits"] == 1 and entry["coupling"]["fan_out"] == 1
    assert helper["coupling"]["fan_in"] == 1 and helper["reachability"] == {"is_reachable": True, "kind": "reachable"}
    assert unused["reachability"]["kind"] == "unreachable_private"
    assert math.isclose(entry["coverage"]["line_coverage"], 2 / 3) and entry["coverage"]["branch_coverage"] == 0.5 and unused["coverage"]["line_coverage"] == 0
    dead = report(spark, repository, sort="nonsense")
    assert dead["summary"]["project_stats"]["dead_code"]["safe_to_delete"] == 1 and "unsupported_sort" in [w["code"] for w in dead["quality"]["warnings"]]
    assert dead["summary"]["project_stats"]["bus_factor"] == 1 and dead["summary"]["project_stats"]["total_unique_authors"] == 1


def test_without_functions_or_git(spark, tmp_path):
    (tmp_path / "a.ts").write_text("const x = 1;\n")
    r = json.loads(analyze(spark, str(tmp_path)).first().report)
    assert {w["code"] for w in r["quality"]["warnings"]} == {"git_unavailable", "no_functions_found"} and r["functions"] == []
    with pytest.raises(FileNotFoundError):
        analyze(spark, str(tmp_path / "missing"))


def test_fixture_queries_match_their_sql(spark):
    import duckdb

    from plumbline.plans import fixture

    for name, query in fixture.QUERIES.items():
        want = duckdb.sql(fixture.SQL[name])
        got = query(spark, "")
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        order = lambda rows: sorted(rows, key=str)
        assert order(map(tuple, got.select(columns).collect())) == order(want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), name


def test_ignored_files(repository, tmp_path_factory):
    from plumbline.sources import repository as repo

    for path in ("a.ts", "b.ts", "build/c.ts", "sub/d.ts", "sub/e.ts", ".hidden/f.ts"):
        repository.write(path, "const x = 1;\n")
    repository.commit("all")
    repository.write(".gitignore", "build/\n")
    repository.write(".ignore", "b.ts\n")
    repository.write("sub/.ignore", "e.ts\n")
    notes = repo.Diagnostics()
    assert repo.walk(str(repository.root), notes) == [".hidden/f.ts", "a.ts", "sub/d.ts"]
    bare = tmp_path_factory.mktemp("bare")
    for name in ("a.ts", "b.ts"):
        (bare / name).write_text("const x = 1;\n")
    (bare / ".ignore").write_text("b.ts\n")
    assert repo.walk(str(bare), notes) == ["a.ts"]


def test_diffs_of_awkward_paths_and_lines(spark, repository):
    """Content that looks like headers, carriage returns within lines, names that git would quote."""
    from plumbline.sources import repository as repo

    names = ["plain.ts", "a b/x b/y.ts", 'quote".ts', "tab\t.ts", "naïve.ts"]
    for n in names:
        repository.write(n, "one\ntwo\nthree\n")
    repository.commit("start")
    for n in names:
        repository.write(n, "one\n@@ -1 +99 @@\rdiff --git a/q b/q\nthree\n-- x\n")
    repository.commit("change")
    (repository.root / "moved to b").mkdir()
    (repository.root / "plain.ts").rename(repository.root / "moved to b" / "plain.ts")
    repository.commit("move")
    got = {(r.path, r.start_line, r.end_line, r.old_path) for r in repo.changed_ranges(repo.commits(spark, str(repository.root)).where("size(parents) > 0"), str(repository.root)).collect()}
    assert got == {(n, a, b, None) for n in names for a, b in ((2, 2), (4, 4))} | {("moved to b/plain.ts", 1, 1_000_000_000, "plain.ts")}


def test_declarators_and_methods():
    names = lambda text, language: [(f.name, first_lines(text, language)[i]) for i, f in enumerate(Parser(text, BY_NAME[language]).run())]
    assert names("int (*q(int a))(int) {\n  return 0;\n}\nint f(void) __attribute__((cold)) {\n}\nstruct s { int a; } g(void) {\n}\nint a[] = { f(1), 2 };\nint last(void) {\n}\n", "c") == [("<anonymous>", 1), ("f", 4), ("g", 6), ("last", 9)]
    methods = "class A<T> {\n m<U extends X<Y>>(x: U) {}\n #p() {}\n *g() {}\n async *h() {}\n [k]() {}\n 'k'() {}\n 3() {}\n get v() { return 1; }\n static s() {}\n @d() e() {}\n f = 1\n n() {}\n}\n"
    assert [n for n, _ in names(methods, "ts")] == ["m", "<anonymous>", "g", "h", "<anonymous>", "<anonymous>", "<anonymous>", "v", "s", "e", "n"]


def first_lines(text, language):
    from plumbline.lang.parser import parse_functions

    return [r["line"] for r in parse_functions(text, "f", language)]


def test_rust_and_c_and_test_files(spark, repository, tmp_path_factory):
    """Metrics of Rust and C side by side, a file of tests, rows instead of the document, and a state elsewhere."""
    repository.write("src/main.rs", "fn main() {\n    if let Some(x) = get() {\n        match x {\n            1 => {}\n            _ => {}\n        }\n    }\n}\n")
    repository.write("src/add.c", "int add(int a, int b) {\n  if (a) return b;\n  return a + b;\n}\n")
    repository.write("tests/integration.rs", "#[test]\nfn works() {\n    assert!(true);\n}\nfn helper() {}\n")
    repository.commit("first")
    state = f"file://{tmp_path_factory.mktemp('state')}"
    rows = {r.name: r for r in analyze(spark, str(repository.root), rows=True, state_dir=state).collect()}
    assert rows["main"].cognitive_complexity >= 2 and rows["add"].cyclomatic_complexity == 2
    assert rows["works"].reachability.is_reachable and rows["works"].reachability.kind == "test_only" and rows["main"].reachability.kind == "reachable"
    again = report(spark, repository, state_dir=state)
    assert again["quality"]["cache"]["ast_hits"] == 3 and not again["quality"]["git"]["cache_reset"]
    dead = [f["name"] for f in again["summary"]["project_stats"]["dead_code"]["functions"]]
    assert dead == ["add", "helper"] and not (repository.root / ".plumbline").exists()
