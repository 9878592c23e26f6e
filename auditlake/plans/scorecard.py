"""The whole audit: all checks, their scores by formula, seven categories, one score.

A check counts what its formula needs, from its issues by rule and from the files.  What has no data (no
commits, no change set, no sessions) scores 100, as a repository without them has nothing to answer for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.extract import CatchBlocks, Functions, extract
from ..functions.fixed_values import CHECK_CATEGORIES
from ..operators import changes, code, graph, history, scoring
from ..sources.kept import Kept
from . import agents, audit, formulas, owasp

#: Checks that read the tree: name to plan of issues.
TREE = {
    "scan": audit.scan, "source-security": audit.source_security, "secrets": audit.secrets, "models": audit.models, "permissions": audit.permissions, "guard": audit.guard,
    "integrity": audit.integrity, "tests": audit.tests, "ready": audit.ready, "debt": audit.debt, "clones": audit.clones, "deps": audit.deps, "deep": audit.deep,
}
CHECKS = [name for names in CHECK_CATEGORIES.values() for name in names]
_COUNTS = {
    "scan": {"critical": "severity = 'error'", "high": "severity = 'warning'"},
    "integrity": {"unresolved": "rule_id = 'unresolved-import'", "empty": "rule_id = 'empty-catch'", "stubs": "severity = 'error' AND rule_id <> 'unresolved-import'", "awaits": "rule_id = 'open-await'"},
    "debt": {"copies": "rule_id IN ('exact-duplicate', 'near-duplicate')", "orphans": "rule_id = 'orphan-export'"},
    "memory": {"stale": "rule_id = 'stale-package'", "broken": "rule_id = 'broken-path'", "against": "rule_id = 'contradiction'"},
    "clones": {"blocks": "true"},
    "explain": {}, "diff": {}, "history": {}, "hotspots": {},
}


def issues_of_tree(files: DataFrame, topics: DataFrame, names: Sequence[str] = tuple(CHECKS)) -> list[DataFrame]:
    parts = [plan(files) for name, plan in TREE.items() if name in names]
    if "owasp" in names:
        parts.append(owasp.issues(topics))
    if "memory" in names:
        parts += [audit.memory(files, audit.manifests(files).select("repo", "package").distinct()), agents.contradictions(files)]
    return parts


def issues_of_changes(diff_lines: DataFrame) -> DataFrame:
    """Findings in added lines, and files by risk, of a change set."""
    found = changes.diff_issues(diff_lines).select("repo", F.lit("diff").alias("check_name"), "rule_id", "severity", "message", F.col("path").alias("file"), F.col("new_line_no").cast("int").alias("line"))
    tiers = changes.explain(diff_lines).where("tier <> 'SAFE'").withColumn("line", F.lit(None))
    severity = F.when(F.col("tier") == "RISKY", "error").otherwise("warning")
    return found.unionByName(audit.issues_of(tiers, "explain", "risk", severity, F.concat_ws(": ", "tier", "path")))


def issues_of_history(commits: DataFrame, commit_files: DataFrame, *, last: int = 20, large: int = 20) -> DataFrame:
    """Repositories of whose last commits more than two are very large."""
    seen = history.history_summary(commits, commit_files, last=last, large=large).where("n_large > 2")
    return audit.issues_of(seen, "history", "large-commits", "warning", F.concat(F.col("n_large").cast("string"), F.lit(" very large commits")), None, None)


def _sub_scores(files: DataFrame) -> list[DataFrame]:
    """The numbers that formulas take from the tree itself, by repository."""
    own = audit.is_code(files)
    source = own.where("NOT is_test")
    n_lines = F.size(F.split("content", "\n"))
    base = files.groupBy("repo").agg(F.count("*").alias("n_files"), F.bool_or(F.col("path") == ".gitignore").alias("has_ignore"))
    code_ = own.groupBy("repo").agg(
        F.count_if(~F.col("is_test")).alias("n_src"), F.count_if(F.col("is_test")).alias("n_tests"), F.sum(n_lines).alias("n_lines"),
        F.avg(F.col("ext").isin(".ts", ".tsx", ".mts", ".cts").cast("double")).alias("ts_share"), F.max("depth").alias("max_depth"),
        (F.count("*") / F.count_distinct(X.directory(F.col("path")))).alias("per_dir"), F.sum(F.length("content")).alias("chars"),
    )
    found = extract(source, Functions)
    size = F.col("end_line") - F.col("line") + 1
    named = (F.length("name") > 2) & ~F.lower("name").contains("anonymous") & ~((F.length("name") <= 4) & (F.col("name") == F.lower("name")))
    functions = found.groupBy("repo").agg(
        F.avg((size <= 25).cast("double")).alias("short"), F.avg((F.col("n_params") < 5).cast("double")).alias("few_params"), F.avg((F.col("params_typed") & F.col("has_return_type")).cast("double")).alias("typed"),
        F.avg((F.col("cyclomatic") <= 10).cast("double")).alias("simple"), F.avg((F.col("nesting") <= 4).cast("double")).alias("flat"), F.avg(named.cast("double")).alias("named"),
    )
    catches = extract(source, CatchBlocks).groupBy("repo").agg(F.count_if("is_empty").alias("empty_catches"), F.count_if("only_comment").alias("lazy_catches"))
    hard = code.file_metrics(source).groupBy("repo").agg(F.avg("maintainability").alias("mean_mi"))
    loose = agents.densities(source).groupBy("repo").agg((F.sum(F.col("any_density") * F.col("n_lines")) / F.sum("n_lines")).alias("any_density"))
    edges = graph.resolve_imports(graph.imports_of(source), source).where("dst_path IS NOT NULL")
    load = agents.context_load(edges, files)
    style = agents.naming_styles(files).select("repo", F.col("share").alias("style_share"))
    declared = audit.manifests(files).groupBy("repo").agg(F.count_distinct("package").alias("n_deps"))
    context = audit.context_cost(files).groupBy("repo", "path").agg(F.sum("est_tokens").alias("t"))
    context = context.groupBy("repo").agg(F.count("*").alias("n_context"), F.sum("t").alias("tokens"), F.count_if(F.col("t") > 10_000).alias("large_context"))
    guide = audit.review(files).groupBy("repo").agg(X.half_up(F.avg("score")).cast("double").alias("review"))
    config = agents.config_quality(files, audit.manifests(files)).select("repo", "complete", "consistent", "specific")
    return [base, code_, functions, catches, hard, loose, load, style, declared, context, guide, config, audit.completeness(files)]


def _architecture(files: DataFrame) -> DataFrame:
    parts = audit.architecture(files)
    modules = parts["modules"].groupBy("repo").agg(F.count("*").alias("modules"), F.count_if((F.col("instability") > 0.8) & (F.col("ca") >= 3)).alias("unstable"))
    count = lambda name, alias: parts[name].groupBy("repo").agg(F.count("*").alias(alias))
    out = modules
    for part in (count("cycles", "cycles"), count("hubs", "hubs"), count("violations", "violations")):
        out = out.join(part, "repo", "left")
    edges = parts["edges"]
    q = graph.modularity(graph.module_edges(edges), parts["communities"], ["repo"]).select("repo", F.col("q_adjacent").alias("q"))
    return out.join(q, "repo", "left").fillna({"cycles": 0, "hubs": 0, "violations": 0})


def _context_points(load: Column) -> Column:
    """100 up to 2 imports a file, 10 less for each more, from 8 on 5 less, never below 20."""
    return (
        F.when(load <= 2, 100.0).when(load <= 4, 100 - (load - 2) * 10).when(load <= 6, 80 - (load - 4) * 10).when(load <= 8, 60 - (load - 6) * 10).otherwise(F.greatest(F.lit(20.0), 40 - (load - 8) * 5))
    )


def _fit_points(fit: Column) -> Column:
    """Points by the share of the source that a window of 128,000 tokens holds."""
    return F.when(fit >= 1, 100.0).when(fit >= 0.5, 70 + fit * 30).when(fit >= 0.25, 40 + fit * 60).otherwise(F.greatest(F.lit(10.0), X.half_up(fit * 160).cast("double")))


def check_scores(files: DataFrame, issues: DataFrame, topics: DataFrame, kept: Kept, more: DataFrame | None = None) -> DataFrame:
    """``repo``, ``category``, ``name``, ``score``, ``n_err``, ``n_warn``, ``n_info`` of every check.

    ``topics``: findings of agent security.  ``more``: (repo, name, score) of checks that read sessions,
    claims or embeddings; they take the place of the 100 that is theirs without data.
    """
    severities = {"err": "error", "warn": "warning", "info": "info"}
    keys = [F.concat(F.col("check_name"), F.lit("_"), F.when(F.col("severity") == s, F.lit(k))) for k, s in severities.items()]
    keys += [F.when((F.col("check_name") == c) & F.expr(e), F.lit(f"{c}_{k}")) for c, own in _COUNTS.items() for k, e in own.items()]
    counted = issues.select("repo", F.explode(F.array_compact(F.array(*keys))).alias("key")).groupBy("repo", "key").agg(F.count("*").alias("n"))
    counted = counted.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counted"))
    # A row for each repository: each part is a table, so that no plan holds all of them.
    wide = files.select("repo").distinct()
    for i, part in enumerate((*_sub_scores(files), _architecture(files), counted, owasp.deductions(topics), agents.ai_framework(files))):
        wide = wide.join(kept.add(f"part-{i}", part), "repo", "left")
    wide = kept.add("wide", wide)
    n = lambda c: F.coalesce(F.col(c) if c in wide.columns else F.try_element_at("counted", F.lit(c)), F.lit(0))
    share = lambda c: 100 * F.coalesce(F.col(c), F.lit(1.0))
    by = lambda c, size=None: scoring.clamp_issues(c, n(f"{c}_err"), n(f"{c}_warn"), n(f"{c}_info"), size)
    src = n("n_src")
    rounded = lambda x: X.half_up(x).cast("double")
    fit = F.least(F.lit(1.0), 128_000.0 / F.greatest(n("chars") / 4, F.lit(1)))
    discover = 100 - F.when(n("max_depth") > 6, F.least(F.lit(20), (n("max_depth") - 6) * 5)).otherwise(0) - rounded((1 - F.coalesce("style_share", F.lit(1.0))) * 30) - F.when(n("per_dir") > 20, F.least(F.lit(15.0), (n("per_dir") - 20) * 2)).otherwise(0)
    types = rounded(F.coalesce("ts_share", F.lit(0.0)) * 100 * (1 - F.least(F.lit(1.0), F.coalesce("any_density", F.lit(0.0)) * 50)))
    clarity = rounded((share("short") + share("few_params")) / 2)
    caught = F.greatest(F.lit(20), 100 - 20 * n("empty_catches") - 10 * n("lazy_catches"))
    has_config = F.col("complete").isNotNull()
    scores = {
        "scan": formulas.scan(n("scan_critical"), n("scan_high")),
        "source-security": by("source-security"),
        "secrets": scoring.clamp_issues("secrets", n("secrets_err"), n("secrets_warn"), n("secrets_info")),
        "config": F.when(has_config, formulas.config(F.lit(10), n("complete"), n("consistent"), n("specific"), ~F.col("has_ignore"))).otherwise(100.0),
        "models": formulas.models(n("models_err"), F.coalesce("ai_framework", F.lit(False))),
        "owasp": formulas.owasp(n("points")),
        "permissions": by("permissions"),
        "guard": by("guard"),
        "diff": by("diff"),
        "integrity": formulas.integrity(src, n("integrity_unresolved"), n("integrity_empty"), n("integrity_stubs"), n("integrity_awaits")),
        "memory": formulas.memory(n("memory_stale"), n("memory_broken"), n("memory_against"), F.lit(0)),
        "tests": formulas.tests(n("n_tests"), n("tests_err"), n("tests_warn"), n("tests_info")),
        "completeness": F.coalesce("completeness", F.lit(0.0)),
        "explain": by("explain"),
        "ready": by("ready", n("n_files")),
        "history": by("history"),
        "debt": formulas.debt(src, n("debt_copies"), n("debt_orphans")),
        "clones": formulas.too_small(src, 2, formulas.clones(10 * n("clones_blocks") / F.greatest(n("n_lines"), F.lit(1)))),
        "deps": by("deps", n("n_deps")),
        "architecture": formulas.too_small(src, 5, formulas.architecture(n("modules"), n("cycles"), n("hubs"), n("unstable"), n("violations"), F.coalesce("q", F.lit(1.0)))),
        "aiready": formulas.too_small(src, 3, formulas.aiready(_context_points(n("imports_per_file")), clarity, types, F.greatest(F.lit(20), discover), rounded(100 * F.coalesce("typed", F.lit(0.0))), _fit_points(fit))),
        "deep": formulas.too_small(src, 3, formulas.deep(rounded(share("simple")), rounded(share("flat")), caught, rounded(share("named")), rounded(F.coalesce("mean_mi", F.lit(100.0))))),
        "context": F.when(n("n_context") == 0, 85.0).otherwise(formulas.context(n("large_context"), F.lit(0), n("tokens"))),
        "review": F.coalesce("review", F.lit(0.0)),
    }
    parts = []
    for category, names in CHECK_CATEGORIES.items():
        rows = [F.struct(F.lit(category).alias("category"), F.lit(c).alias("name"), scores.get(c, F.lit(100.0)).cast("double").alias("score"), *[n(f"{c}_{k}").cast("long").alias(f"n_{k}") for k in severities]) for c in names]
        parts.append(wide.select("repo", F.explode(F.array(*rows)).alias("x")).select("repo", "x.*"))
    out = audit.union(parts)
    if more is not None:
        out = out.join(more.select("repo", "name", F.col("score").alias("told")), ["repo", "name"], "left").withColumn("score", F.coalesce("told", "score")).drop("told")
    return out


def audit_all(
    files: DataFrame, checks: Sequence[str] | None = None, *, diff_lines: DataFrame | None = None, commits: DataFrame | None = None, commit_files: DataFrame | None = None, more: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issues, check scores and score cards of all repositories in ``files``.

    All checks count towards seven weighted categories; the whole is scaled by completeness.  With ``checks`` only these
    are reported and count, and nothing is scaled.  Results are tables in the shared folder.
    """
    chosen, kept = list(checks or CHECKS), Kept(files.sparkSession)
    topics = kept.add("topics", owasp.findings(files))
    found = issues_of_tree(files, topics, chosen)
    if diff_lines is not None:
        found.append(issues_of_changes(diff_lines))
    if commits is not None and commit_files is not None:
        found.append(issues_of_history(commits, commit_files))
    issues = kept.add("issues", *found) if found else kept.add("issues", audit.issues_of(files.limit(0), "", "", "", "", None, None))
    scored = kept.add("scored", check_scores(files, issues, topics, kept, more).where(F.col("name").isin(chosen)))
    cats = scoring.categories(scored)
    if checks:
        return issues, scored, scoring.scorecards(cats)
    complete = scored.where("name = 'completeness'").select("repo", F.col("score").alias("completeness"))
    return issues, scored, scoring.scaled_scorecards(cats, complete)
