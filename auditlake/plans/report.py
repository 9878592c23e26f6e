"""Score cards and issues as text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import badge_url
from ..operators.lines import first_per


def report_json(cards: DataFrame, scored: DataFrame, issues: DataFrame) -> DataFrame:
    """One JSON document for each repository, with all its checks and the number of its issues."""
    checks = scored.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("category", "name", "score", "n_err", "n_warn", "n_info"))).alias("checks"))
    counts = issues.groupBy("repo").agg(F.count("*").alias("total_issues"))
    joined = cards.join(checks, "repo", "left").join(counts, "repo", "left").fillna(0, ["total_issues"])
    return joined.select("repo", F.to_json(F.struct("repo", "score", "grade", "passed", "total_issues", "checks")).alias("json"))


def badges(cards: DataFrame, label: str = "code audit") -> DataFrame:
    return cards.select("repo", badge_url(F.lit(label), F.col("score").cast("double")).alias("url"))


def worst(issues: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` issues of each repository by severity."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return first_per(issues.withColumn("_s", rank), ["repo"], ["_s", "check_name", "rule_id", "file", "line"], n).drop("_s")


def report_text(cards: DataFrame, scored: DataFrame, issues: DataFrame, n: int = 5) -> str:
    """A page for each repository of a small set: grade, bars of categories, first fixes."""
    first = {}
    for r in worst(issues, n).orderBy("repo").collect():
        first.setdefault(r["repo"], []).append(f"  {r['severity']:<8}{r['message']} ({r['file'] or 'repository'}{':' + str(r['line']) if r['line'] else ''})")
    bars = {}
    for r in scored.groupBy("repo", "category").agg(F.avg("score").alias("s")).orderBy("repo", "category").collect():
        bars.setdefault(r["repo"], []).append(f"  {r['category']:<14}{'#' * round(r['s'] / 5):<20} {r['s']:.0f}")
    pages = [
        "\n".join([f"{c['repo']}: {c['score']}/100, grade {c['grade']}", *bars.get(c["repo"], []), *first.get(c["repo"], [])]) for c in cards.orderBy("repo").collect()
    ]
    return "\n\n".join(pages)
