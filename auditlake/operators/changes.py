"""Change sets: risk tiers, triage, diff findings, claims against files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.expressions import extension
from .rules import Rule, first_rule, scan

#: Rules on added lines; the first that holds counts.
DIFF_RULES = [Rule(name, severity, name.replace("-", " "), pattern) for name, severity, pattern in FV.DIFF_PATTERNS]


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("|".join(patterns))


def path_tier(path: Column) -> Column:
    """RISKY, REVIEW or SAFE by path."""
    lower = F.lower(path)
    risky = _any(F.substring_index(lower, "/", -1), FV.RISKY_NAMES) | _any(lower, FV.RISKY_PATHS)
    return F.when(risky, "RISKY").when(_any(lower, FV.REVIEW_PATHS), "REVIEW").otherwise("SAFE")


def removes_risky(text: Column) -> Column:
    """Whether a removed line holds a destructive word, letter for letter."""
    return _any(text, FV.RISKY_REMOVED)


def adds_open_end(text: Column) -> Column:
    return _any(text, FV.REVIEW_ADDED)


def bumped(tier: Column, removed: Column, added: Column) -> Column:
    """A tier raised by destructive words on removed lines, or by open ends on added ones."""
    return F.when(F.coalesce(removed, F.lit(False)), "RISKY").when(F.coalesce(added, F.lit(False)) & (tier == "SAFE"), "REVIEW").otherwise(tier)


def explain(diff_lines: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Each file's tier, from (kind, text) of its changed lines."""
    flags = diff_lines.groupBy(*keys).agg(
        F.bool_or((F.col("kind") == "-") & removes_risky(F.col("text"))).alias("removed"),
        F.bool_or((F.col("kind") == "+") & adds_open_end(F.col("text"))).alias("added"),
    )
    return flags.withColumn("tier", bumped(path_tier(F.col("path")), F.col("removed"), F.col("added")))


def security_path(path: Column) -> Column:
    return path.rlike(FV.SECURITY_PATH) & ~F.lower(extension(path)).isin(FV.SECURITY_SKIP)


def schema_path(path: Column) -> Column:
    return path.rlike(FV.SCHEMA_PATH)


def triage_rank(security: Column, handler: Column, schema: Column, untested: Column) -> Column:
    """CRITICAL for a security file with a schema or without an error handler it had, HIGH for any of the three, MEDIUM
    for many lines without a test, else SKIP."""
    return F.when(security & (handler | schema), "CRITICAL").when(security | handler | schema, "HIGH").when(untested, "MEDIUM").otherwise("SKIP")


def triage(diff_lines: DataFrame, stat: DataFrame | None = None, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Signals and urgency of each changed file; whether any test changed is asked of the whole change set.

    ``stat`` names further changed files (``path``), as a summary of changes does.  ``why`` tells cosmetic
    changes (under five lines, or comments and blank lines alone) from those without a signal.
    """
    cosmetic_line = (F.trim("text") == "") | F.col("text").rlike(FV.COMMENT_LINE)
    by = diff_lines.where(F.col("kind").isin("+", "-")).groupBy(*keys, "path").agg(
        F.count_if(F.col("kind") == "+").alias("added"),
        F.count_if(F.col("kind") == "-").alias("removed"),
        F.bool_or((F.col("kind") == "-") & F.col("text").rlike(FV.ERROR_HANDLER)).alias("handler"),
        F.every(cosmetic_line).alias("only_blank"),
    )
    if stat is not None:
        by = by.join(stat.select(*keys, "path").distinct(), [*keys, "path"], "full").fillna({"added": 0, "removed": 0, "handler": False, "only_blank": True})
    tested = by.groupBy(*keys).agg(F.bool_or(F.col("path").rlike(FV.TEST_PATH)).alias("tested"))
    by = by.join(tested, list(keys))
    security, schema = security_path(F.col("path")), schema_path(F.col("path"))
    rank = triage_rank(security, F.col("handler"), schema, (F.col("added") >= 50) & ~F.col("tested"))
    cosmetic = F.col("only_blank") | (F.col("added") + F.col("removed") < 5)
    return by.withColumns({"security": security, "schema": schema, "rank": rank, "why": F.when(rank == "SKIP", F.when(cosmetic, "cosmetic").otherwise("no signals"))})


def stat_lines(text: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """``path``, ``changes`` and ``binary`` from lines ``path | 12 +++--`` of a summary (``text``).

    A path that was moved, ``a/{b => c}/d``, is the new one.
    """
    form = r"^\s*(.+?)\s+\|\s+(?:(\d+)\b|Bin\b)"
    path = F.regexp_replace(F.regexp_extract("text", form, 1), r"\{[^{}]* => ([^{}]*)\}", "$1")
    path = F.regexp_replace(F.regexp_replace(path, "//+", "/"), r"^.* => ", "")
    found = text.where(F.col("text").rlike(form)).select(*keys, path.alias("path"), F.regexp_extract("text", form, 2).alias("n"))
    return found.select(*keys, "path", F.when(F.col("n") != "", F.col("n").cast("long")).alias("changes"), (F.col("n") == "").alias("binary"))


def diff_issues(diff_lines: DataFrame, rules: Sequence[Rule] = DIFF_RULES) -> DataFrame:
    """The first finding of each added line."""
    added = diff_lines.where("kind = '+'")
    hits = scan(added, rules)
    first = added.withColumn("_first", first_rule(F.col("text"), rules)).where("_first IS NOT NULL")
    return hits.join(first.select("repo", "path", "new_line_no", F.col("_first").alias("rule_id")).distinct(), ["repo", "path", "new_line_no", "rule_id"], "left_semi")


def rewrites(diff_lines: DataFrame) -> DataFrame:
    """Files that are rewritten rather than changed, and files that mostly gained comments."""
    comment = F.trim("text").rlike(r"^(//|#|/\*|\*)")
    by = diff_lines.groupBy("repo", "path").agg(
        F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"), F.count_if((F.col("kind") == "+") & comment).alias("comments")
    )
    ratio = F.least("added", "removed") / F.greatest("added", "removed")
    wholesale = (F.col("added") > 10) & (F.col("removed") > 20) & (ratio > 0.7)
    dense = (F.col("added") >= 10) & (F.col("comments") > 5) & (F.col("comments") / F.col("added") > 0.4)
    return by.withColumns({"rewrite": wholesale, "dense_comments": dense})


def verified_claims(changed: DataFrame, claimed: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Union of changed and claimed files: whether each was claimed and exists."""
    every = changed.select(key).union(claimed.select(key)).distinct()
    out = every.join(claimed.select(key, F.lit(True).alias("claimed")).distinct(), key, "left").join(existing.select(key, F.lit(True).alias("found")).distinct(), key, "left")
    return out.select(key, F.coalesce("claimed", F.lit(False)).alias("claimed"), F.coalesce("found", F.lit(False)).alias("found"))


def claims(messages: DataFrame) -> DataFrame:
    """File names that commit messages say were made, fixed or removed."""
    form = r"(?i)\b(?:add(?:ed|s)?|creat(?:e|ed|es)|updat(?:e|ed|es)|fix(?:ed|es)?|remov(?:e|ed|es)|delet(?:e|ed|es)|implement(?:ed|s)?|refactor(?:ed|s)?)\s+(?:the\s+)?[`'\"]?([\w./-]+\.[A-Za-z]{1,5})\b"
    return messages.select("repo", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(form), F.lit(1)))).alias("path")).distinct()
