"""Queries over a small repository made on the spot, whose commits, files and results are known.

The repository lies in the shared folder, which executors must be able to read as files.
"""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..lang.lexer import SyntaxProblem
from ..lang.parser import parse_functions
from ..operators.lineage import shared_dir
from ..policy import DEFAULT_BUG_FIX_PATTERNS
from ..sources import repository as repo
from .analyze import analyze

SCRIPT = """export function entry(x) {
  if (x && helper(x)) {
    return 1;
  }
  return helper(0);
}
function helper(y) {
  // TODO check
  return y ? 1 : 2;
}
/** Unused. */
function unused(z) {
  const value = z;
  return value;
}
"""
BOX = """class Box {
  peek<U>(u: U) {
    return u;
  }
  *walk() {
    yield 1;
  }
  #hidden() {}
}
"""
RUST = """pub fn area(w: u32, h: u32) -> u32 {
    match w {
        0 => 0,
        _ => w * h,
    }
}
#[cfg(test)]
mod tests {
    #[test]
    fn computes() {
        assert_eq!(super::area(2, 3), 6);
    }
}
"""
C = """int add(int a, int b) {
  return a + b;
}
int *find(int *p) {
  while (*p) p++;
  return p;
}
int (*pick(int k))(int) {
  return k ? add1 : 0;
}
int quiet(void) __attribute__((cold)) {
  return 0;
}
"""
OTHER = "module.exports = function () {\n  throw 1;\n};\n"


def build(root: str) -> None:
    """Six commits by three authors: a start, a fix, a rename, a change on a branch, a new file, a merge of the two."""

    def git(*args: str, day: str = "2024-01-01", who: str = "alice") -> None:
        names = {f"GIT_{x}_{y}": v for x in ("AUTHOR", "COMMITTER") for y, v in (("NAME", who), ("EMAIL", f"{who}@example.com"), ("DATE", f"{day}T00:00:00Z"))}
        subprocess.run(["git", "-c", "safe.directory=*", "-c", "commit.gpgsign=false", "-C", root, *args], check=True, capture_output=True, env=os.environ | names)

    def write(path: str, text: str) -> None:
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", newline="") as f:
            f.write(text)

    def commit(message: str, **who: str) -> None:
        git("add", "-A")
        git("commit", "-q", "-m", message, **who)

    os.makedirs(root)
    git("init", "-q", "-b", "main")
    for path, text in (("src/index.ts", SCRIPT), ("src/lib.rs", RUST), ("src/util.c", C)):
        write(path, text)
    commit("Start")
    write("src/index.ts", SCRIPT.replace("return 1;", "return 2;") + BOX)
    commit("Fix the result", day="2024-02-01", who="bob")
    git("mv", "src/lib.rs", "src/core.rs")
    commit("Move the library", day="2024-02-02")
    git("checkout", "-q", "-b", "side")
    write("src/util.c", C.replace("return 0;", "return 1;"))
    commit("Side", day="2024-02-03", who="carol")
    git("checkout", "-q", "main")
    write("src/other.js", OTHER)
    commit("Add another", day="2024-02-04")
    git("merge", "-q", "--no-ff", "-m", "Join", "side", day="2024-02-05")


def _made(spark: SparkSession) -> str:
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError("the fixture needs a shared folder that is mounted as files")
    root = f"{folder}/fixture-{uuid.uuid4().hex}"
    build(root)
    return root


def history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges of each commit of the fixture, with author, time and class of the commit."""
    root = _made(spark)
    history = repo.commits(spark, root)
    ranges = repo.last_parent(repo.changed_ranges(history, root))
    facts = history.select("commit", "message", X.author_identity("email", "name").alias("author"), "ts", X.is_bug_fix("message", DEFAULT_BUG_FIX_PATTERNS).alias("is_bug_fix"))
    return ranges.join(facts, "commit").select(F.trim(F.replace("message", F.lit("\n"), F.lit(""))).alias("message"), "path", "start_line", "end_line", "old_path", "author", "ts", "is_bug_fix")


HISTORY_SQL = """SELECT message, path, start_line, end_line, old_path, who || '@example.com' AS author, CAST(epoch(day) AS BIGINT) AS ts, message LIKE 'Fix%' AS is_bug_fix FROM (VALUES
  ('Start', 'src', 1::BIGINT, 1000000000::BIGINT, NULL, 'alice', TIMESTAMP '2024-01-01'), ('Start', 'src/index.ts', 1, 1000000000, NULL, 'alice', TIMESTAMP '2024-01-01'),
  ('Start', 'src/lib.rs', 1, 1000000000, NULL, 'alice', TIMESTAMP '2024-01-01'), ('Start', 'src/util.c', 1, 1000000000, NULL, 'alice', TIMESTAMP '2024-01-01'),
  ('Fix the result', 'src/index.ts', 3, 3, NULL, 'bob', TIMESTAMP '2024-02-01'), ('Fix the result', 'src/index.ts', 16, 24, NULL, 'bob', TIMESTAMP '2024-02-01'),
  ('Move the library', 'src/core.rs', 1, 1000000000, 'src/lib.rs', 'alice', TIMESTAMP '2024-02-02'),
  ('Side', 'src/util.c', 12, 12, NULL, 'carol', TIMESTAMP '2024-02-03'), ('Add another', 'src/other.js', 1, 3, NULL, 'alice', TIMESTAMP '2024-02-04'),
  ('Join', 'src/util.c', 12, 12, NULL, 'alice', TIMESTAMP '2024-02-05'), ('Join', 'src/other.js', 1, 3, NULL, 'alice', TIMESTAMP '2024-02-05')
) t(message, path, start_line, end_line, old_path, who, day)"""

_WINDOW = "struct<modifications long>"
_FUNCTION = (
    "struct<name string, file string, line long, end_line long, cyclomatic_complexity long, cognitive_complexity long, nesting_depth long, lines_of_code long, executable_statements long, hollow_kind string, "
    "comment_ratio double, placeholder_count long, has_docstring boolean, documentation_quality string, identifier_verbosity double, times_modified long, bug_fix_commits long, authors_count long, authors array<string>, "
    f"churn struct<last_modified string, velocity string, windows struct<d7 {_WINDOW}, d30 {_WINDOW}, d90 {_WINDOW}>>, "
    "coverage struct<line_coverage double, branch_coverage double>, coupling struct<fan_in long, fan_out long, callers array<string>, callees array<string>>, reachability struct<is_reachable boolean, kind string>, "
    "percentile struct<cognitive double>>"
)
_REPORT = (
    f"schema_version string, functions array<{_FUNCTION}>, summary struct<total_functions long, project_stats struct<total_unique_authors long, bus_factor long, dead_code struct<unreachable_functions long, safe_to_delete long>>>, "
    "quality struct<status string, git struct<processed_commits long, cache_reset boolean>, cache struct<loaded boolean, saved boolean, ast_hits long, ast_misses long>, warnings array<struct<code string>>, skipped_files array<struct<path string>>>"
)


def _functions(spark: SparkSession) -> DataFrame:
    root = _made(spark)
    os.makedirs(f"{root}/coverage")
    with open(f"{root}/coverage/lcov.info", "w") as f:
        f.write("SF:src/index.ts\nDA:2,1\nDA:3,0\nDA:5,4\nBRDA:2,0,0,0\nBRDA:2,0,1,-\nBRDA:2,0,2, -\nDA:8,4294967296\nend_of_record\n")
    report = analyze(spark, root, include_authors=True)
    return report.select(F.from_json("report", _REPORT).alias("r")).select(F.inline("r.functions"))


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax metrics of each function of the fixture, from the report."""
    f = _functions(spark)
    # whether a closing expression of Rust is a statement depends on the grammar's version
    statements = F.when(~F.col("file").endswith(".rs"), F.col("executable_statements"))
    return f.select(
        "file", "line", "name", "end_line", F.col("cyclomatic_complexity").alias("cyclomatic"), F.col("cognitive_complexity").alias("cognitive"), F.col("nesting_depth").alias("nesting"), "lines_of_code",
        statements.alias("statements"), "hollow_kind", F.round("comment_ratio", 6).alias("comment_ratio"), "placeholder_count", "has_docstring", "documentation_quality",
        F.when(~F.col("file").endswith(".rs"), F.round("identifier_verbosity", 6)).alias("verbosity"), F.round("percentile.cognitive", 6).alias("cognitive_percentile"),
    )


METRICS_SQL = """WITH f AS (SELECT * FROM (VALUES
  ('src/index.ts', 1, 'entry', 6, 3, 2, 1, 5, 'none', 0.0, 0, false, 20 / 6.0), ('src/index.ts', 7, 'helper', 10, 2, 1, 1, 1, 'none', 0.25, 1, false, 8 / 3.0), ('src/index.ts', 12, 'unused', 15, 1, 0, 0, 2, 'none', 0.0, 0, true, 3.6),
  ('src/index.ts', 17, 'peek', 19, 1, 0, 0, 1, 'none', 0.0, 0, false, 1.6), ('src/index.ts', 20, 'walk', 22, 1, 0, 0, 2, 'none', 1 / 3.0, 0, false, 4.0), ('src/index.ts', 23, '<anonymous>', 23, 1, 0, 0, 0, 'empty', 0.0, 0, false, 0.0),
  ('src/core.rs', 1, 'area', 6, 6, 1, 0, NULL, 'none', 0.0, 0, false, NULL), ('src/core.rs', 10, 'computes', 12, 1, 0, 0, NULL, 'none', 0.0, 0, false, NULL),
  ('src/util.c', 1, 'add', 3, 1, 0, 0, 1, 'none', 0.0, 0, false, 1.4), ('src/util.c', 4, '<anonymous>', 7, 2, 1, 1, 3, 'none', 0.0, 0, false, 1.6), ('src/util.c', 8, '<anonymous>', 10, 2, 1, 1, 1, 'none', 0.0, 0, false, 2.5),
  ('src/util.c', 11, 'quiet', 13, 1, 0, 0, 1, 'none', 0.0, 0, false, 4.5), ('src/other.js', 1, 'module.exports', 3, 1, 0, 0, 1, 'none', 0.0, 0, false, 0.0)
) t(file, line, name, end_line, cyclomatic, cognitive, nesting, statements, hollow_kind, comment_ratio, placeholder_count, has_docstring, verbosity))
SELECT file, line::BIGINT AS line, name, end_line::BIGINT AS end_line, cyclomatic::BIGINT AS cyclomatic, cognitive::BIGINT AS cognitive, nesting::BIGINT AS nesting, (end_line - line + 1)::BIGINT AS lines_of_code, statements::BIGINT AS statements,
  hollow_kind, round(comment_ratio::DOUBLE, 6) AS comment_ratio, placeholder_count::BIGINT AS placeholder_count, has_docstring, CASE WHEN has_docstring THEN 'adequate' ELSE 'missing' END AS documentation_quality, round(verbosity::DOUBLE, 6) AS verbosity,
  round(percent_rank() OVER (ORDER BY cognitive) * 100, 6) AS cognitive_percentile FROM f"""


def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn, coupling, reachability and coverage of each function of the fixture, from the report."""
    f = _functions(spark)
    windows = [F.col(f"churn.windows.d{d}.modifications").alias(f"d{d}") for d in (7, 30, 90)]
    return f.select(
        "file", "line", "times_modified", "bug_fix_commits", "authors_count", F.concat_ws(" ", "authors").alias("authors"), F.col("churn.last_modified").alias("last_modified"), *windows, F.col("churn.velocity").alias("velocity"),
        "coupling.fan_in", "coupling.fan_out", F.concat_ws(" ", "coupling.callers").alias("callers"), F.concat_ws(" ", "coupling.callees").alias("callees"), "reachability.is_reachable", "reachability.kind",
        F.round("coverage.line_coverage", 6).alias("line_coverage"), "coverage.branch_coverage",
    )


HISTORY_OF_FUNCTIONS_SQL = """WITH f AS (SELECT * FROM (VALUES
  ('src/index.ts', 1, 2, 1, 'alice bob', '2024-02-01', 1, 1, 2, 'accelerating', 0, 1, '', 'src/index.ts:helper', 'reachable', 2 / 3.0, 2 / 3.0), ('src/index.ts', 7, 1, 0, 'alice', '2024-01-01', 1, 1, 1, 'stable', 1, 0, 'src/index.ts:entry', '', 'reachable', 0.0, NULL),
  ('src/index.ts', 12, 1, 0, 'alice', '2024-01-01', 1, 1, 1, 'stable', 0, 0, '', '', 'unreachable_private', 0.0, NULL), ('src/index.ts', 17, 2, 1, 'alice bob', '2024-02-01', 1, 1, 2, 'accelerating', 0, 0, '', '', 'unreachable_private', 0.0, NULL),
  ('src/index.ts', 20, 2, 1, 'alice bob', '2024-02-01', 1, 1, 2, 'accelerating', 0, 0, '', '', 'unreachable_private', 0.0, NULL), ('src/index.ts', 23, 2, 1, 'alice bob', '2024-02-01', 1, 1, 2, 'accelerating', 0, 0, '', '', 'unreachable_private', 0.0, NULL),
  ('src/core.rs', 1, 2, 0, 'alice', '2024-02-02', 1, 1, 2, 'accelerating', 1, 0, 'src/core.rs:computes', '', 'reachable', NULL, NULL), ('src/core.rs', 10, 2, 0, 'alice', '2024-02-02', 1, 1, 2, 'accelerating', 0, 1, '', 'src/core.rs:area', 'test_only', NULL, NULL),
  ('src/util.c', 1, 1, 0, 'alice', '2024-01-01', 1, 1, 1, 'stable', 0, 0, '', '', 'unreachable_private', NULL, NULL), ('src/util.c', 4, 1, 0, 'alice', '2024-01-01', 1, 1, 1, 'stable', 0, 0, '', '', 'unreachable_private', NULL, NULL),
  ('src/util.c', 8, 1, 0, 'alice', '2024-01-01', 1, 1, 1, 'stable', 0, 0, '', '', 'unreachable_private', NULL, NULL), ('src/util.c', 11, 3, 0, 'alice carol', '2024-02-05', 2, 2, 3, 'accelerating', 0, 0, '', '', 'unreachable_private', NULL, NULL),
  ('src/other.js', 1, 2, 0, 'alice', '2024-02-05', 2, 2, 2, 'accelerating', 0, 0, '', '', 'unreachable_private', NULL, NULL)
) t(file, line, times_modified, bug_fix_commits, who, day, d7, d30, d90, velocity, fan_in, fan_out, callers, callees, kind, line_coverage, branch_coverage))
SELECT file, line::BIGINT AS line, times_modified::BIGINT AS times_modified, bug_fix_commits::BIGINT AS bug_fix_commits, len(string_split(who, ' ')) AS authors_count, array_to_string(list_transform(string_split(who, ' '), lambda x: x || '@example.com'), ' ') AS authors,
  day || 'T00:00:00+00:00' AS last_modified, d7::BIGINT AS d7, d30::BIGINT AS d30, d90::BIGINT AS d90, velocity, fan_in::BIGINT AS fan_in, fan_out::BIGINT AS fan_out, callers, callees, kind NOT LIKE 'un%' AS is_reachable, kind,
  round(line_coverage::DOUBLE, 6) AS line_coverage, branch_coverage::DOUBLE AS branch_coverage FROM f"""


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's figures and the quality block of three runs: the first, one that finds its state, one after a change on a new branch."""
    root = _made(spark)
    with open(f"{root}/src/broken.ts", "w") as f:
        f.write("function broken( {\n")
    with open(f"{root}/.ignore", "w") as f:
        f.write("ignored.ts\n")
    with open(f"{root}/src/ignored.ts", "w") as f:
        f.write("function ignored() {}\n")
    runs = [analyze(spark, root, sort="nonsense")]
    runs[0].collect()
    runs.append(analyze(spark, root))
    subprocess.run(["git", "-c", "safe.directory=*", "-C", root, "checkout", "-q", "-b", "other"], check=True, capture_output=True)
    with open(f"{root}/src/other.js", "a") as f:
        f.write("const more = () => 1;\n")
    runs.append(analyze(spark, root, limit=1))
    out = None
    for n, r in enumerate(runs, 1):
        one = r.select(F.lit(n).alias("run"), F.from_json("report", _REPORT).alias("r")).select(
            "run", "r.schema_version", F.size("r.functions").alias("shown"), "r.summary.total_functions", "r.summary.project_stats.total_unique_authors", "r.summary.project_stats.bus_factor", "r.summary.project_stats.dead_code.unreachable_functions",
            "r.summary.project_stats.dead_code.safe_to_delete", "r.quality.status", "r.quality.git.processed_commits", "r.quality.git.cache_reset", "r.quality.cache.loaded", "r.quality.cache.saved", "r.quality.cache.ast_hits", "r.quality.cache.ast_misses",
            F.concat_ws(" ", "r.quality.warnings.code").alias("warnings"), F.concat_ws(" ", "r.quality.skipped_files.path").alias("skipped"),
        )
        out = one if out is None else out.unionByName(one)
    return out


SUMMARY_SQL = """SELECT run, '0.4.0' AS schema_version, shown, shown::BIGINT AS total_functions, 3::BIGINT AS total_unique_authors, 1::BIGINT AS bus_factor, dead::BIGINT AS unreachable_functions, dead::BIGINT AS safe_to_delete, 'partial' AS status,
  commits::BIGINT AS processed_commits, reset AS cache_reset, run > 1 AS loaded, true AS saved, hits::BIGINT AS ast_hits, misses::BIGINT AS ast_misses, warnings, 'src/broken.ts' AS skipped
FROM (VALUES (1, 13, 9, 6, true, 0, 5, 'unsupported_sort'), (2, 13, 9, 0, false, 5, 0, ''), (3, 1, 10, 6, true, 4, 1, '')) t(run, shown, dead, commits, reset, hits, misses, warnings)"""

CASES = [
    ("empty_if", "ts", "function f(x) {\n  if (x) {\n  }\n}\n"),
    ("nested_function", "ts", "function outer(x) {\n  function inner(y) {\n    if (y) {}\n  }\n}\n"),
    ("bound_arrow", "ts", "const f = (x) => {\n  if (x) {}\n};\n"),
    ("flat_match", "rust", "fn f(x: i32) -> i32 { match x { 1 => 1, 2 => 2, _ => 3 } }"),
    ("if_in_arm", "rust", "fn f(x: i32) -> i32 { match x { 1 => if x > 0 { 1 } else { 2 }, _ => 3 } }"),
    ("match_in_if", "rust", "fn f(x: i32) { if x > 0 { match x { 1 => {}, _ => {} } } }"),
    ("public", "rust", "pub fn a() {}\nstruct S;\nimpl S {\n    pub fn b(&self) {}\n    fn c(&self) {}\n}\n"),
    ("tests", "rust", "#[test]\nfn a() {}\n#[tokio::test]\nasync fn b() {}\nmod m {\n    #[test]\n    fn c() {}\n}\nfn d() {}\n"),
    ("trait_impl", "rust", "impl Display for S {\n    fn fmt(&self) {}\n}\n"),
    ("callback", "rust", "fn f(value: R) { value.map_err(callback); }"),
    ("jsx", "tsx", "export function View() {\n  return <p>text</p>;\n}\n"),
    ("else_if", "c", "int f(int a) {\n  if (a) {} else if (a > 1) { while (a && a || a) {} } else {}\n  switch (a) { case 1: break; default: break; }\n  do { a--; } while (a);\n  return a ? 1 : 2;\n}\n"),
    ("methods", "ts", "export class A {\n  constructor() { this.x(); }\n  async go() { for (const a of b) {} }\n  get v() { return 1; }\n  handle = (e) => { try {} catch (e) {} };\n  ['c']() {}\n  'd'() {}\n}\nconst o = { m() {}, n: function () {} };\n"),
    ("template", "ts", "const t = (a) => `${a ? f(a) : 1}`;\n"),
    ("no_function", "c", "struct s { int a; };\n"),
    ("open", "ts", "function broken( {"), ("operand", "ts", "function f(a) { return a + ; }"), ("twice", "ts", "let x = = 3;"), ("nameless", "ts", "let = ;"), ("side_by_side", "rust", "fn f() { a b; }"), ("no_operand", "c", "int f() { return 1 == ; }"),
]


def parse_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser's findings in small sources; a rejected source is a row of its own."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for case, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    found = parse_functions(text, case, language)
                    rows += [(case, r["ordinal"], r["name"], r["cyclomatic_complexity"], r["cognitive_complexity"], r["nesting_depth"], r["exported"], r["test_entry"], "callback" in r["callee_names"], False) for r in found]
                except SyntaxProblem:
                    rows.append((case, None, None, None, None, None, None, None, None, True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in out.split(", ")])

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_()]
    out = "source string, nth long, name string, cyclomatic long, cognitive long, nesting long, exported boolean, test_entry boolean, calls_back boolean, rejected boolean"
    return spark.createDataFrame(CASES, "source string, language string, text string").repartition(1).mapInArrow(parse, out)


CASES_SQL = """SELECT source, nth::BIGINT AS nth, name, cyclomatic::BIGINT AS cyclomatic, cognitive::BIGINT AS cognitive, nesting::BIGINT AS nesting, exported, test_entry, name IS NOT NULL AND source = 'callback' AS calls_back, false AS rejected FROM (VALUES
  ('empty_if', 0, 'f', 2, 1, 1, false, false), ('nested_function', 0, 'outer', 1, 0, 0, false, false), ('nested_function', 1, 'inner', 2, 1, 1, false, false), ('bound_arrow', 0, 'f', 2, 1, 1, false, false),
  ('flat_match', 0, 'f', 8, 1, 0, false, false), ('if_in_arm', 0, 'f', 7, 2, 1, false, false), ('match_in_if', 0, 'f', 7, 3, 1, false, false),
  ('public', 0, 'a', 1, 0, 0, true, false), ('public', 1, 'b', 1, 0, 0, true, false), ('public', 2, 'c', 1, 0, 0, false, false),
  ('tests', 0, 'a', 1, 0, 0, false, true), ('tests', 1, 'b', 1, 0, 0, false, true), ('tests', 2, 'c', 1, 0, 0, false, true), ('tests', 3, 'd', 1, 0, 0, false, false),
  ('trait_impl', 0, 'fmt', 1, 0, 0, true, false), ('callback', 0, 'f', 1, 0, 0, false, false), ('jsx', 0, 'View', 1, 0, 0, true, false),
  ('else_if', 0, 'f', 10, 9, 2, false, false),
  ('methods', 0, 'constructor', 1, 0, 0, true, false), ('methods', 1, 'go', 2, 1, 1, true, false), ('methods', 2, 'v', 1, 0, 0, true, false), ('methods', 3, 'handle', 2, 1, 1, true, false), ('methods', 4, '<anonymous>', 1, 0, 0, true, false),
  ('methods', 5, '<anonymous>', 1, 0, 0, true, false), ('methods', 6, 'm', 1, 0, 0, false, false), ('methods', 7, '<anonymous>', 1, 0, 0, false, false), ('template', 0, 't', 2, 1, 1, false, false)
) t(source, nth, name, cyclomatic, cognitive, nesting, exported, test_entry)
UNION ALL SELECT source, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM (VALUES ('open'), ('operand'), ('twice'), ('nameless'), ('side_by_side'), ('no_operand')) r(source)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"history_changes": history_changes, "report_metrics": report_metrics, "report_history": report_history, "report_summary": report_summary, "parse_cases": parse_cases}
SQL = {"history_changes": HISTORY_SQL, "report_metrics": METRICS_SQL, "report_history": HISTORY_OF_FUNCTIONS_SQL, "report_summary": SUMMARY_SQL, "parse_cases": CASES_SQL}
