"""Score cards: issues to checks, categories, one weighted score and a grade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp, completeness_multiplier, grade, half_up, size_scale
from .lines import first_per

#: Category weights, and checks without a floor.
WEIGHTS = {
    "security": 0.20,
    "integrity": 0.20,
    "debt": 0.15,
    "deps": 0.10,
    "architecture": 0.10,
    "aiready": 0.10,
    "history": 0.15,
}
UNFLOORED = ["scan", "secrets", "permissions", "owasp"]
SEVERITIES = ["error", "warning", "info"]


def severity_counts(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n_err``, ``n_warn`` and ``n_info`` of each key."""
    return issues.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).cast("long").alias(n) for s, n in zip(SEVERITIES, ("n_err", "n_warn", "n_info"), strict=True)]
    )


def deduct(errors: float = 0, warnings: float = 0, infos: float = 0, scale: Column | None = None) -> Column:
    """100 less so much for each issue, never below 0."""
    total = errors * F.col("n_err") + warnings * F.col("n_warn") + infos * F.col("n_info")
    return clamp(100.0 - (total if scale is None else scale * total))


#: For each check: points for an error, a warning, an info, and size scale (start, slope, floor) if any.
FORMULAS = {
    "source-security": (30, 10, 0, None),
    "secrets": (20, 0, 0, None),
    "models": (20, 0, 0, None),
    "permissions": (30, 15, 5, None),
    "guard": (15, 5, 0, None),
    "diff": (20, 7.5, 0, None),
    "tests": (8, 4, 2, (5, 0.5, 0.15)),
    "ready": (30, 15, 3, (20, 0.35, 0.4)),
    "history": (0, 10, 0, None),
    "deps": (20, 5, 0, (5, 0.4, 0.3)),
    "explain": (15, 5, 0, None),
    "triage": (25, 10, 5, None),
    "compact": (30, 15, 5, None),
    "fleet": (25, 15, 0, None),
}


def clamp_issues(check: str, errors: Column, warnings: Column, infos: Column, n_parts: Column | None = None) -> Column:
    """The score of a check that only counts issues, from the counts."""
    points = FORMULAS[check]
    total = points[0] * errors + points[1] * warnings + points[2] * infos
    return clamp(100.0 - (size_scale(n_parts, *points[3]) * total if points[3] and n_parts is not None else total))


def check_score(check: str, n_parts: Column | None = None) -> Column:
    """The score of a check that only counts issues."""
    errors, warnings, infos, scaled = FORMULAS[check]
    return deduct(errors, warnings, infos, size_scale(n_parts, *scaled) if scaled and n_parts is not None else None)


def floored(name: Column, score: Column) -> Column:
    return F.when(name.isin(UNFLOORED), score).otherwise(F.greatest(F.lit(25.0), score))


def categories(checks: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Mean of the floored scores of each category; checks whose ``status`` is not ok do not count."""
    if "status" in checks.columns:
        checks = checks.where("status = 'ok'")
    return checks.groupBy(*keys, "category").agg(half_up(F.avg(floored(F.col("name"), F.col("score")))).alias("score"))


def scorecards(cats: DataFrame, keys: Sequence[str] = ("repo",), multiplier: Column | None = None) -> DataFrame:
    """Weighted score, grade and whether the least score is reached, for each key.  ``multiplier``: an aggregate over its rows."""
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("category") == name, F.lit(w)).otherwise(weight)
    whole = F.sum(weight * F.col("score")) / F.sum(weight)
    out = cats.groupBy(*keys).agg(half_up(F.round(whole if multiplier is None else whole * multiplier, 9)).alias("score"))  # sums of any order agree
    return out.withColumn("grade", grade(F.col("score"))).withColumn("passed", F.col("score") >= 60)


def scaled_scorecards(cats: DataFrame, completeness: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Score cards of categories, scaled before rounding by the unfloored completeness of each key."""
    factor = completeness_multiplier(F.coalesce("completeness", F.lit(100.0)))
    joined = cats.join(completeness, list(keys), "left").withColumn("_factor", factor)
    return scorecards(joined, keys, F.max("_factor"))


def with_multiplier(cards: DataFrame, completeness: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Cards scaled by the unfloored completeness score (column ``completeness``) of each key."""
    joined = cards.join(completeness, list(keys), "left")
    factor = completeness_multiplier(F.coalesce("completeness", F.lit(100.0)))
    score = half_up(F.col("score") * factor)
    return joined.withColumn("score", score).withColumn("grade", grade(F.col("score"))).withColumn("passed", F.col("score") >= 60).drop("completeness")


def top_fixes(issues: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` errors, then warnings, of each key."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return first_per(issues.where("severity <> 'info'").withColumn("_sev", rank), keys, ["_sev", *order], n).drop("_sev")


def only_changed(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Issues without a file, or in a changed one (``repo``, ``file``)."""
    return issues.where("file is null").unionByName(issues.where("file is not null").join(changed, ["repo", "file"], "left_semi"))


def rescored(issues: DataFrame) -> DataFrame:
    """Mean over checks that still have issues of 100 less 25, 10 and 2 points for each; no floor."""
    by_check = severity_counts(issues, ["repo", "check_name"]).withColumn("s", 100 - 25 * F.col("n_err") - 10 * F.col("n_warn") - 2 * F.col("n_info"))
    return by_check.groupBy("repo").agg(half_up(F.avg("s")).alias("score"))
