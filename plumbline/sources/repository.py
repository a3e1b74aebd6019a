"""A working tree and its history: files, commits, changed line ranges, configuration, coverage report."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.lexer import SyntaxProblem
from ..lang.parser import parse_functions
from ..lang.spec import BY_EXTENSION
from ..policy import DEFAULT_BUG_FIX_PATTERNS, WHOLE_FILE_END

COMMITS_PER_TASK = 32
FILES_PER_TASK = 64
FIRST_DAY = "1970-01-01T00:00:00+00:00"

FUNCTIONS = (
    "file string, ordinal long, name string, id string, line long, end_line long, body_hash string, body_text string, cyclomatic_complexity long, cognitive_complexity long, "
    "nesting_depth long, executable_statements long, doc_bytes long, identifier_verbosity double, callee_names array<string>, exported boolean, test_entry boolean, content_hash string, error string"
)
CHANGES = "commit string, parent long, path string, start_line long, end_line long, old_path string, error string"
COMMITS = "commit string, parents array<string>, email string, name string, ts long, message string, seq long"


def git(root: str, *args: str, given: str = "", **env: str) -> str:
    """What git prints, with its own line ends; ``given`` is its input."""
    done = subprocess.run(["git", "-c", "core.quotepath=false", "-c", "safe.directory=*", "-C", root, *args], input=given.encode(), capture_output=True, check=True, env=os.environ | env)
    return done.stdout.decode(errors="replace")


@dataclass
class Diagnostics:
    """Warnings by code, and skipped files by path."""

    warnings: list[tuple[str, str]] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)

    def warn(self, code: str, message: object) -> None:
        self.warnings.append((code, str(message)))


def head(root: str, notes: Diagnostics) -> tuple[str, str, str]:
    """Branch, commit and the commit's time; ``unknown``, empty and the epoch where there is none."""
    try:
        git(root, "rev-parse", "--git-dir")
    except (subprocess.CalledProcessError, FileNotFoundError) as e:
        notes.warn("git_unavailable", e)
        return "unknown", "", FIRST_DAY
    try:
        branch = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
        commit, ts = git(root, "log", "-1", "--format=%H %ct").split()
    except (subprocess.CalledProcessError, ValueError):
        return "unknown", "", FIRST_DAY
    return branch, commit, pd.Timestamp(int(ts), unit="s", tz="UTC").isoformat()


def walk(root: str, notes: Diagnostics) -> list[str]:
    """Relative paths of supported files, hidden ones kept.

    Files that a ``.ignore`` matches are left out; in a repository, those that its ignore rules match too, tracked or not.
    """
    try:
        found = _listed(root, "--exclude-standard") - _listed(root, "-i", "--exclude-per-directory=.ignore")
    except (subprocess.CalledProcessError, FileNotFoundError):
        found = set()
        for folder, _, names in os.walk(root, onerror=lambda e: notes.warn("walk_entry_failed", e)):
            found |= {os.path.relpath(os.path.join(folder, n), root) for n in names}
        found -= _ignored_outside(root)
    return sorted(p for p in found if p.rpartition(".")[2] in BY_EXTENSION and "." in os.path.basename(p) and os.path.isfile(os.path.join(root, p)))


def _listed(root: str, *options: str) -> set[str]:
    every = lambda *x: {p for p in git(root, "ls-files", "-co", "-z", *x).split("\0") if p}
    return every(*options) if "-i" in options else every(*options) - every("-i", *options)


def _ignored_outside(root: str) -> set[str]:
    """Files below a folder without a repository that a ``.ignore`` matches, by an empty repository made for the question."""
    with tempfile.TemporaryDirectory() as empty:
        try:
            git(empty, "init", "-q", "--bare")
            env = {"GIT_DIR": empty, "GIT_WORK_TREE": root}
            return {p for p in git(root, "ls-files", "-o", "-i", "-z", "--exclude-per-directory=.ignore", **env).split("\0") if p}
        except (subprocess.CalledProcessError, FileNotFoundError):
            return set()


def hashed(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """``path, content_hash`` of files; null where a file can't be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = []
            for p in b["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        hashes.append(xxhash.xxh3_128_hexdigest(f.read()))
                except OSError:
                    hashes.append(None)
            yield b.assign(content_hash=hashes)

    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(max(1, -(-len(paths) // FILES_PER_TASK))).mapInPandas(read, "path string, content_hash string")


def parsed(files: DataFrame, root: str) -> DataFrame:
    """Function rows of ``files(path, ...)``; a rejected file gives one row with ``error``, one without functions a row with neither."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FUNCTIONS.split(", ")]
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        raw = f.read()
                except OSError as e:
                    rows.append({"file": p, "error": f"failed to read file: {e}"})
                    continue
                h = xxhash.xxh3_128_hexdigest(raw)
                try:
                    found = parse_functions(raw.decode(), p, BY_EXTENSION[p.rpartition(".")[2]].name)
                    rows += [r | {"content_hash": h} for r in found] or [{"file": p, "content_hash": h}]
                except (SyntaxProblem, UnicodeDecodeError) as e:
                    rows.append({"file": p, "content_hash": h, "error": f"failed to analyze file: {e}"})
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype(object).where(out.notna(), None)

    return files.select("path").mapInPandas(parse, FUNCTIONS)


def commits(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Commits from HEAD in topological order, those reachable from ``since`` left out.

    The driver lists ids alone, 40 bytes each; messages and authors are read by tasks, one git process for each batch of commits.
    """
    ids = git(root, "rev-list", "--topo-order", f"{since}..HEAD" if since else "HEAD").split()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (x for x in batches if len(x)):  # without ids git would read HEAD
            text = git(root, "log", "--no-walk=unsorted", "--stdin", "--format=%H%x00%P%x00%ae%x00%an%x00%ct%x00%B%x01", given="\n".join(b["commit"]) + "\n")
            seq, rows = dict(zip(b["commit"], b["seq"], strict=True)), []
            for record in (x for x in text.split("\x01") if x.strip()):
                commit, parents, email, name, ts, message = record.strip("\n").split("\0", 5)
                rows.append((commit, parents.split(), email, name, int(ts), message, seq[commit]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COMMITS.split(", ")])

    listed = spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "commit string, seq long")
    return listed.repartition(max(1, -(-len(ids) // (8 * COMMITS_PER_TASK)))).mapInPandas(read, COMMITS)


_HUNK = re.compile(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@")


def _diff(root: str, parent: str, commit: str) -> Iterator[tuple[str, int, int, str | None]]:
    """Path, range and, of a rename, the old path, of each changed range against one parent; a change without hunks is of the whole file.

    Paths come from the raw list, whose entries and the patch's sections have one order. A line of
    the patch that begins with ``diff --git`` or ``@@`` is never content, which has a sign before it.
    """
    text = git(root, "diff-tree", "-r", "-U0", "-M", "-z", "--raw", "-p", "--no-color", "--no-ext-diff", parent, commit)
    sections: list[tuple[str, str | None]] = []
    while text.startswith(":"):
        meta, path, text = text.split("\0", 2)
        status, old = meta.split()[-1], None
        if status[0] in "RC":
            old, (path, text) = path, text.split("\0", 1)
        # a change of type is a removal and an addition
        sections += [(path, old if status[0] == "R" else None)] * (1 + (status[0] == "T"))
    hunks: list[list[tuple[int, int]]] = []
    for line in text.lstrip("\0\n").split("\n"):
        if line.startswith("diff --git "):
            hunks.append([])
        elif line.startswith("@@ ") and (m := _HUNK.match(line)):
            start = max(int(m[1]), 1)
            hunks[-1].append((start, start + max(int(m[2] or 1), 1) - 1))
    for (path, old), ranges in zip(sections, hunks, strict=True):
        for start, end in ranges or [(1, WHOLE_FILE_END)]:
            yield path, start, end, old


def changed_ranges(history: DataFrame, root: str) -> DataFrame:
    """Changed ranges of each commit against each of its parents; of a root commit every entry, whole.

    A commit that can't be read gives one row with ``error``.
    """

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for commit, parents in zip(b["commit"], b["parents"], strict=True):
                try:
                    own = []
                    if not len(parents):
                        names = [x for x in git(root, "ls-tree", "-r", "-t", "-z", "--name-only", commit).split("\0") if x]
                        own = [(commit, 0, p, 1, WHOLE_FILE_END, None, None) for p in names]
                    for k, parent in enumerate(parents):
                        own += [(commit, k, p, s, e, old, None) for p, s, e, old in _diff(root, parent, commit)]
                    rows += own
                except (subprocess.CalledProcessError, OSError) as e:
                    rows.append((commit, 0, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])
            yield out.astype(object).where(out.notna(), None)

    parts = max(1, -(-history.count() // COMMITS_PER_TASK))
    return history.select("commit", "parents").repartition(parts).mapInPandas(diff, CHANGES)


def last_parent(ranges: DataFrame) -> DataFrame:
    """Of a merge, a path's ranges against the last parent that has it replace the others."""
    top = ranges.groupBy("commit", "path").agg(F.max("parent").alias("parent"))
    return ranges.join(top, ["commit", "path", "parent"])


def bug_fix_patterns(root: str, tool: str, notes: Diagnostics) -> tuple[str, ...]:
    """Patterns of ``<tool>.toml``; the default ones where it has none or one of them isn't valid."""
    try:
        with open(os.path.join(root, f"{tool}.toml"), "rb") as f:
            raw = f.read()
    except FileNotFoundError:
        return DEFAULT_BUG_FIX_PATTERNS
    except OSError as e:
        notes.warn("config_read_failed", e)
        return DEFAULT_BUG_FIX_PATTERNS
    try:
        found = tomllib.loads(raw.decode()).get("git", {}).get("bug_fix_patterns", [])
        if not all(isinstance(p, str) for p in found):
            raise ValueError("bug_fix_patterns must be strings")
    except (ValueError, AttributeError, UnicodeDecodeError) as e:
        notes.warn("config_parse_failed", e)
        return DEFAULT_BUG_FIX_PATTERNS
    for p in found:
        try:
            re.compile(p)
            if re.search(r"\(\?<?[=!]|\\[1-9]", p):
                raise re.error("look-around and back-references aren't supported")
        except re.error as e:
            notes.warn("invalid_bug_fix_pattern", f"{p}: {e}")
            return DEFAULT_BUG_FIX_PATTERNS
    return tuple(found) or DEFAULT_BUG_FIX_PATTERNS


def coverage_text(spark: SparkSession, root: str, notes: Diagnostics) -> DataFrame | None:
    path = os.path.join(root, "coverage", "lcov.info")
    if not os.path.exists(path):
        return None
    try:
        with open(path, encoding="utf-8") as f:
            f.read(1)
    except (OSError, UnicodeDecodeError) as e:
        notes.warn("coverage_read_failed", e)
        return None
    return spark.read.text(f"file://{os.path.abspath(path)}", wholetext=True)
