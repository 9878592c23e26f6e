"""``python -m auditlake.cli COMMAND PATH...``: audits, reports on history and change sets, and session forensics.

``audit`` ends with exit code 1 below the least score; all other commands print rows as JSON lines.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, history, sessions
from .plans import agents, scorecard
from .plans import audit as checks
from .plans.report import badges, report_json, report_text
from .sources.files import read_files
from .sources.git import commit_files, commits, read_diff, read_log
from .sources.session_logs import latest, read_sessions


def _parsed(spark: SparkSession, paths: list[str]) -> DataFrame:
    return sessions.entries(read_sessions(spark, paths[0]))


def _fleet(spark: SparkSession, paths: list[str]) -> DataFrame:
    calls = sessions.tool_calls(_parsed(spark, paths))
    return sessions.with_conflicts(sessions.rollup(calls), calls)


def _compact(spark: SparkSession, paths: list[str]) -> DataFrame:
    parsed = _parsed(spark, paths).where("text IS NOT NULL")
    explicit = F.coalesce(F.col("type").rlike("(?i)compact|summary"), F.lit(False))
    cut = sessions.compaction_events(parsed, explicit, (F.col("role") == "system") & (F.length("text") > 500), F.col("role").isin("user", "assistant"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    before = cut.where("NOT event").groupBy("session", "segment").agg(said.alias("before"))
    after = cut.where("event").groupBy("session", "segment").agg(F.min_by("text", "seq").alias("summary"))
    met = before.join(after, ["session", "segment"])
    own = agents.terms(F.col("before"))
    gone = lambda c, low: F.filter(own[c], lambda x: ~F.contains(F.lower("summary") if low else F.col("summary"), F.lower(x) if low else x))
    lost = F.filter(own["instructions"], lambda x: agents.lost_instruction(x, F.col("summary")))
    return met.select("session", "segment", gone("paths", False).alias("paths"), gone("identifiers", True).alias("identifiers"), lost.alias("instructions"))


def _hotspots(spark: SparkSession, paths: list[str]) -> DataFrame:
    from .operators.code import indentation

    log = commit_files(read_log(spark, *paths, since="6 months ago"))
    rows = log.select(F.concat_ws("/", "repo", "path").alias("path"), "sha", F.col("author_name").alias("author"), (F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))).alias("lines"))
    deep = indentation(checks.is_code(read_files(spark, *paths))).select(F.concat_ws("/", "repo", "path").alias("path"), "complexity")
    return history.hotspots(history.churn(rows), deep).orderBy(F.desc("risk"), "path")


COMMANDS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {
    "fleet": _fleet,
    "receipt": lambda s, p: sessions.receipt(sessions.tool_calls(sessions.entries(latest(read_sessions(s, p[0]))))),
    "subsidy": lambda s, p: sessions.cost(_parsed(s, p)).orderBy(F.desc("cost")),
    "loop": lambda s, p: agents.loops(_parsed(s, p)),
    "compact": _compact,
    "triage": lambda s, p: changes.triage(read_diff(s, *p)),
    "explain": lambda s, p: changes.explain(read_diff(s, *p, policy="explain"), ("repo", "path")),
    "diff": lambda s, p: changes.diff_issues(read_diff(s, *p)),
    "split": lambda s, p: history.commit_concerns(commit_files(read_log(s, *p, last=20))),
    "history": lambda s, p: history.history_summary(commits(read_log(s, *p)), commit_files(read_log(s, *p))),
    "hotspots": _hotspots,
    "map": lambda s, p: checks.visibility(read_files(s, *p)),
    "context": lambda s, p: checks.context_cost(read_files(s, *p)),
    "review": lambda s, p: checks.review(read_files(s, *p)),
    "guard": lambda s, p: checks.guard(read_files(s, *p)),
    "permissions": lambda s, p: checks.permissions(read_files(s, *p)),
    "sandbox": lambda s, p: agents.sandbox_points(agents.environment(s)),
    "bloat": lambda s, p: agents.densities(read_files(s, *p)),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["audit", *COMMANDS])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--checks", help="comma-separated names: " + ", ".join(scorecard.CHECKS))
    parser.add_argument("--format", choices=["text", "json", "badge"], default="text")
    parser.add_argument("--least", type=float, default=60)
    own = parser.parse_args(argv)
    spark = SparkSession.builder.appName("auditlake").getOrCreate()
    if own.command != "audit":
        rows = COMMANDS[own.command](spark, own.paths)
        for row in rows.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator():
            print(row["json"])
        return 0
    files = read_files(spark, *own.paths).persist()
    issues, scored, cards = (x.persist() for x in scorecard.audit_all(files, own.checks.split(",") if own.checks else None))
    if own.format == "text":
        print(report_text(cards, scored, issues))
    else:
        column, frame = ("json", report_json(cards, scored, issues)) if own.format == "json" else ("url", badges(cards))
        for row in frame.toLocalIterator():
            print(row[column])
    return int(cards.where(cards["score"] < own.least).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
