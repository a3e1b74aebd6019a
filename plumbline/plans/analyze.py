"""The repository report: parse, history, coverage, coupling, scores, ranks, one JSON document."""

from __future__ import annotations

import logging
import os
import subprocess

import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import coverage as C
from ..operators import graph as G
from ..operators import history as H
from ..operators import report as R
from ..operators import scoring as S
from ..operators.lineage import cut
from ..policy import SCHEMA_VERSION, THRESHOLDS, WEIGHTS
from ..sources import repository as repo
from ..sources.state import Meta, State, default_folder

TOOL = "plumbline"
log = logging.getLogger(TOOL)
SORT_COLUMNS = {"churn_score": "churn_score", "risk": "final_score", "cognitive": "cognitive", "cyclomatic": "cyclomatic", "loc": "loc"}
METRIC_COLUMNS = {"cognitive": "cognitive", "churn": "churn_score", "churn_recent": "churn_recent", "fan_in": "fan_in", "cyclomatic": "cyclomatic", "loc": "loc", "authors": "authors_count", "coverage_gap": "coverage_gap"}


def _history(spark: SparkSession, root: str, state: State, meta: Meta, patterns: tuple[str, ...], notes: repo.Diagnostics, git: dict) -> tuple[DataFrame | None, DataFrame | None]:
    """Line changes and renames of all commits: the state's and those since its cursor."""
    old = state.meta
    fits = old is not None and (old.repository, old.branch, old.patterns) == (meta.repository, meta.branch, meta.patterns) and bool(old.head)
    since = old.head if fits else None
    if since and since != meta.head:
        try:
            repo.git(root, "merge-base", "--is-ancestor", since, meta.head)
        except subprocess.CalledProcessError:
            notes.warn("git_partial", "the cursor isn't an ancestor of HEAD; history was read anew")
            since = None
    git["cache_reset"] = since is None
    kept = (state.table("changes"), state.table("renames")) if since else None
    if since == meta.head:
        return cut(kept[0]), cut(kept[1])  # the state's folder may be replaced before the report is read
    history = cut(repo.commits(spark, root, since))
    ranges = cut(repo.changed_ranges(history, root))
    failed = ranges.where("error is not null").count()
    if failed:
        git["partial"] = True
        notes.warn("git_partial", f"{failed} commits couldn't be read")
    git["processed_commits"] = history.count() - failed
    fine = ranges.where("error is null")
    author = X.author_identity("email", "name")
    facts = history.select("commit", author.alias("author"), "ts", X.is_bug_fix("message", patterns).alias("is_bug_fix"), "seq")
    changes = repo.last_parent(fine).join(facts, "commit").select("path", "commit", "author", "ts", "is_bug_fix", "start_line", "end_line")
    renames = fine.where("old_path is not null").join(facts, "commit").select("old_path", F.col("path").alias("new_path"), "seq").distinct()
    if kept:
        changes = kept[0].unionByName(changes)
        # an earlier run's renames are older, and the oldest of a path wins
        renames = kept[1].withColumn("seq", F.col("seq") + 1_000_000_000).unionByName(renames)
    return cut(changes), cut(renames)


def analyze(spark: SparkSession, path: str, sort: str | None = None, limit: int | None = None, include_authors: bool = False, state_dir: str | None = None, rows: bool = False) -> DataFrame:
    """One row with ``report``, the JSON document of the repository at ``path``; or, with ``rows``, a row for each function.

    ``state_dir`` keeps what the next run can use again: a folder, or a URI of a file system that
    Spark knows. By default it is ``<path>/.plumbline``, and on a cluster a folder beside
    ``spark.checkpoint.dir``'s. It isn't written for a repository without functions or with
    unreadable commits. ``path`` must be mounted where executors run. The document is one value, so
    a repository whose report is over a gigabyte needs ``rows``.
    """
    root = os.path.realpath(path)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    notes = repo.Diagnostics()
    branch, commit, when = repo.head(root, notes)
    patterns = repo.bug_fix_patterns(root, TOOL, notes)
    state = State(spark, state_dir or default_folder(spark, root, TOOL))
    cache = {"enabled": True, "loaded": False, "saved": False, "ast_hits": 0, "ast_misses": 0}
    try:
        state.prepare()
    except (OSError, Py4JJavaError) as e:
        cache["enabled"] = False
        notes.warn("cache_unavailable", e)
    try:
        cache["loaded"] = state.load()
    except (ValueError, KeyError, TypeError, OSError, Py4JJavaError) as e:
        notes.warn("cache_load_failed", e)
    meta = Meta(root, branch, commit, xxhash.xxh3_128_hexdigest("\n".join(patterns).encode()))
    git = {"available": bool(commit), "partial": False, "cache_reset": False, "processed_commits": 0}

    # functions: those of unchanged files from the state, the others parsed
    paths = [p for p in repo.walk(root, notes) if not p.startswith(f".{TOOL}/")]
    files = cut(repo.hashed(spark, root, paths))
    memo = state.table("functions")
    if memo is None:
        memo = spark.createDataFrame([], repo.FUNCTIONS)
    known = memo.select(F.col("file").alias("path"), "content_hash").distinct()
    hits = files.join(known, ["path", "content_hash"], "left_semi")
    misses = files.join(known, ["path", "content_hash"], "left_anti")
    fresh = repo.parsed(misses, root)
    units = cut(memo.join(hits.select(F.col("path").alias("file"), "content_hash"), ["file", "content_hash"], "left_semi").unionByName(fresh))
    cache["ast_hits"], cache["ast_misses"] = hits.count(), misses.count()
    notes.skipped += [(r.file, r.error) for r in units.where("error is not null").select("file", "error").orderBy("file").collect()]
    parsed = units.where("error is null and name is not null")

    # history
    changes = renames = None
    if commit:
        try:
            changes, renames = _history(spark, root, state, meta, patterns, notes, git)
        except (subprocess.CalledProcessError, OSError) as e:
            git["partial"] = True
            notes.warn("git_metrics_failed", e)
    if changes is None:
        changes = spark.createDataFrame([], "path string, commit string, author string, ts long, is_bug_fix boolean, start_line long, end_line long")
        renames = spark.createDataFrame([], "old_path string, new_path string, seq long")
    named = H.with_renames(changes, H.rename_closure(H.rename_aliases(renames)))
    total_authors = H.unique_authors(named)
    active = H.active_only(named, files)

    key = F.concat_ws("#", "file", F.col("ordinal").cast("string"))
    f = parsed.withColumn("key", key).select(
        "*",
        F.col("cyclomatic_complexity").alias("cyclomatic"), F.col("cognitive_complexity").alias("cognitive"), (F.col("end_line") - F.col("line") + 1).alias("loc"),
        X.comment_ratio("body_text").alias("comment_ratio"), X.comment_lines("body_text").alias("_comments"), X.placeholder_count("body_text").alias("placeholder_count"),
        (F.col("doc_bytes") > 0).alias("has_docstring"), X.doc_quality("doc_bytes", "cognitive_complexity").alias("documentation_quality"),
        (F.col("executable_statements") == 0).alias("is_hollow"), X.initial_reachability("test_entry", "exported").alias("kind"),
    ).withColumn("hollow_kind", X.hollow_kind("executable_statements", "_comments")).withColumn("lines_of_code", F.col("loc"))
    f = cut(f.drop("body_text", "content_hash", "error", "_comments"))
    n = f.count()

    # joins to the facts
    spans = f.select("key", "file", "line", "end_line")
    met = H.overlapping(spans, active)
    churn = H.churn(met, ["key"])
    authors = met.groupBy("key").agg(F.sort_array(F.collect_set("author")).alias("authors"))
    changed = active.select(F.col("path").alias("file")).distinct().withColumn("_known", F.lit(True))
    f = f.join(churn, "key", "left").join(authors, "key", "left").join(changed, "file", "left")
    zero = {c: 0 for c in ("times_modified", "bug_fix_commits", "authors_count", "d7_modifications", "d30_modifications", "d90_modifications")}
    f = f.fillna(zero | {c: 0.0 for c in ("churn_score", "d7_score", "d30_score", "d90_score")})
    f = f.withColumn("velocity", F.coalesce("velocity", F.when(F.col("_known"), "stable"), F.lit(""))).withColumn("churn_recent", F.col("d7_score"))
    report = repo.coverage_text(spark, root, notes)
    if report is not None:
        cov_lines, cov_branches = C.lcov(C.numbered_lines(report), root)
        f = f.join(C.function_coverage(spans, cov_lines, cov_branches), "key", "left")
    else:
        f = f.withColumn("line_coverage", F.lit(None).cast("double")).withColumn("branch_coverage", F.lit(None).cast("double")).withColumn("coverage_gap", F.lit(None).cast("double"))
    calls = f.select(F.col("key").alias("caller"), F.explode("callee_names").alias("callee_name"))
    f = G.reachability(G.coupling(f, G.call_edges(calls, f.select("key", "name"))))
    f = cut(S.ranked(S.scored(S.normalised(f, METRIC_COLUMNS)), "churn_score", "cognitive"))

    _, fine = R.sort_metric(sort)
    if not fine:
        notes.warn("unsupported_sort", f"unsupported sort key: {sort}")
    if not n:
        notes.warn("no_functions_found", "no functions were found")
    elif commit and not git["partial"] and cache["enabled"]:
        try:
            state.save(meta, functions=units, changes=changes, renames=renames)
            cache["saved"] = True
        except (OSError, Py4JJavaError) as e:
            notes.warn("cache_save_failed", e)
    log.info("%d functions, %d files skipped, %d commits read", n, len(notes.skipped), git["processed_commits"])
    for code, message in notes.warnings:
        log.warning("%s: %s", code, message)
    if rows:
        return R.sorted_report(f, sort, SORT_COLUMNS, limit).select(_function_struct(include_authors).alias("_f")).select("_f.*")
    return _report(spark, f, n, total_authors, active, sort, limit, include_authors, notes, git, cache, report is not None, (root, commit, branch, when))


def _function_struct(include_authors: bool) -> Column:
    window = lambda d: F.struct(F.col(f"d{d}_modifications").alias("modifications"), F.col(f"d{d}_score").alias("score")).alias(f"d{d}")
    covered = F.when(F.col("line_coverage").isNotNull(), F.struct(
        F.lit(True).alias("available"), "line_coverage", "branch_coverage", F.array().cast("array<string>").alias("covered_by"), C.risk_gap("final_score", "line_coverage").alias("risk_coverage_gap")))
    authors = F.col("authors") if include_authors else F.lit(None).cast("array<string>")
    return F.struct(
        "id", "name", "file", "line", "end_line", "body_hash", "cyclomatic_complexity", "cognitive_complexity", "nesting_depth", "lines_of_code", "executable_statements",
        "is_hollow", "hollow_kind", "comment_ratio", "placeholder_count", "has_docstring", "documentation_quality", "identifier_verbosity",
        "times_modified", "bug_fix_commits", "authors_count", authors.alias("authors"),
        F.struct(F.col("churn_score").alias("score"), "times_modified", X.rfc3339("last_modified").alias("last_modified"), F.struct(window(7), window(30), window(90)).alias("windows"), "velocity").alias("churn"),
        "churn_score", covered.alias("coverage"),
        F.struct("fan_in", "fan_out", "callers", "callees", "instability").alias("coupling"), F.struct("is_reachable", "kind").alias("reachability"),
        F.struct(*[F.col(f"norm_{m}").alias(m) for m in ("cyclomatic", "churn", "churn_recent", "cognitive", "fan_in", "loc", "authors", "coverage_gap")]).alias("normalized"),
        F.struct("base_score", "nesting_penalty", "final_score", F.col("risk_level").alias("level"), "primary_driver").alias("risk"),
        F.struct(F.col("risk_percentile").alias("risk"), F.col("churn_percentile").alias("churn"), F.col("cognitive_percentile").alias("cognitive")).alias("percentile"),
    )


def _report(spark, f, n, total_authors, active, sort, limit, include_authors, notes, git, cache, covered, where) -> DataFrame:
    """The document; rows of functions are gathered only here, as they are its content."""
    root, commit, branch, when = where
    out = spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(F.lit(root).alias("repository"), F.lit(commit).alias("commit"), F.lit(branch).alias("branch"), F.lit(when).alias("timestamp")).alias("analysis"))
    weights = F.struct(*[F.lit(w).alias(m) for m, w in WEIGHTS.items()])
    limits = F.struct(*[F.lit(getattr(THRESHOLDS, k)).alias(k) for k in ("critical", "high", "medium")])
    out = out.withColumn("scoring_policy", F.struct(weights.alias("weights"), limits.alias("thresholds"), F.lit("Weighted sum of log-normalised metrics, raised by nesting and fan-in; levels by percentile.").alias("description")))
    if n:
        column = lambda df, name: df.select(F.struct(*df.columns).alias(name))
        shown = R.sorted_report(f, sort, SORT_COLUMNS, limit)
        metric, _ = R.sort_metric(sort)
        rank = [F.lit(0.0) if metric == "location" else -F.col(SORT_COLUMNS[metric]).cast("double"), "file", "name", "line", "ordinal"]
        listed = shown.select(F.struct(*rank).alias("_k"), _function_struct(include_authors).alias("_f"))
        functions = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_f"))), lambda x: x["_f"]).alias("functions"), F.count("*").alias("_shown"))
        hot = R.hotspots(f).select(F.struct((-F.col("final_score")).alias("a"), (-F.col("churn_score")).alias("b"), (-F.col("cognitive")).alias("c"), "file", "line").alias("_k"), F.struct("id", "name", "file", "line", F.col("final_score").alias("risk_score"), "churn_score", "cognitive_complexity").alias("_h"))
        hot = hot.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"]).alias("_hot"))
        safe = F.col("kind") == "unreachable_private"
        dead = f.where("not is_reachable").select(F.struct("file", "name", "line", "id", "lines_of_code", "kind", safe.alias("safe_to_delete")).alias("_d"))
        dead = dead.agg(F.transform(F.array_sort(F.collect_list("_d")), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["file"].alias("file"), x["line"].alias("line"), x["lines_of_code"].alias("lines_of_code"), x["kind"].alias("kind"), x["safe_to_delete"].alias("safe_to_delete"))).alias("_dead"))
        top = f.agg(F.max("cyclomatic").alias("cyclomatic"), F.max("cognitive").alias("cognitive"), F.max("churn_score").alias("churn"), F.max("loc").alias("loc"))
        p95 = S.order_statistics(f, ["final_score", "churn_score", "cognitive"]).agg(*[F.max(F.when(F.col("metric") == m, F.col("p95"))).alias(k) for m, k in (("final_score", "risk_p95"), ("churn_score", "churn_p95"), ("cognitive", "cognitive_p95"))])
        parts = [functions, hot, dead, column(top, "_max"), column(p95, "_p95"), total_authors, H.bus_factor(H.contributions(active)), R.debt_density(f), column(G.dead_code(f), "_rollup"), column(C.project_coverage(shown), "_cov")]
        for p in parts:
            out = out.crossJoin(F.broadcast(p))
        roll = lambda k: F.col(f"_rollup.{k}").alias(k)
        stats = F.struct("total_unique_authors", "bus_factor", "tech_debt_density", F.col("_hot").alias("top_hotspots"), F.struct(roll("unreachable_functions"), roll("unreachable_loc"), roll("safe_to_delete"), F.col("_dead").alias("functions")).alias("dead_code"))
        coverage = F.when(F.lit(covered) & F.col("_cov.available"), F.col("_cov"))
        summary = F.struct(F.col("_shown").alias("total_functions"), stats.alias("project_stats"), coverage.alias("coverage"), F.col("_max").alias("max_values"), F.col("_p95").alias("distributions"))
        out = out.withColumn("summary", summary)
    else:
        out = out.withColumn("functions", F.array()).withColumn("summary", F.struct(F.lit(0).alias("total_functions")))
    complete = not notes.warnings and not notes.skipped and not git["partial"]
    literal = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    pairs = lambda rows, a, b: F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in rows]) if rows else F.array()
    quality = F.struct(F.lit("complete" if complete else "partial").alias("status"), literal(git).alias("git"), literal(cache).alias("cache"), pairs(notes.warnings, "code", "message").alias("warnings"), pairs(notes.skipped, "path", "reason").alias("skipped_files"))
    document = F.struct("schema_version", "analysis", "scoring_policy", "summary", quality.alias("quality"), "functions")
    return out.select(F.to_json(document, {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))
