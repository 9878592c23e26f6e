"""Pattern rules over lines: one projection for a fixed rule set, no join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import lines_of


@dataclass(frozen=True)
class Rule:
    """A pattern with its finding; ``paths`` restricts it to matching paths, ``unless`` exempts lines."""

    rule_id: str
    severity: str
    message: str
    pattern: str
    paths: str | None = None
    unless: str | None = None

    def holds(self, text: Column, path: Column | None = None) -> Column:
        hit = text.rlike(self.pattern)
        if self.unless:
            hit = hit & ~text.rlike(self.unless)
        if self.paths and path is not None:
            hit = hit & path.rlike(self.paths)
        return F.coalesce(hit, F.lit(False))


def scan(lines: DataFrame, rules: Sequence[Rule], *, text: str = "text", path: str | None = None) -> DataFrame:
    """A row for each rule that holds on each line: ``rule_id``, ``severity``, ``message``, ``rule_ord``."""
    at = F.col(path) if path else None
    found = F.array(
        *[
            F.when(
                r.holds(F.col(text), at),
                F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(i).alias("rule_ord")),
            )
            for i, r in enumerate(rules)
        ]
    )
    kept = lines.withColumn("_hit", F.explode(F.array_compact(found)))
    return kept.select(*lines.columns, "_hit.*")


def first_rule(text: Column, rules: Sequence[Rule], path: Column | None = None) -> Column:
    """The id of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.holds(text, path), F.lit(r.rule_id)).otherwise(out)
    return out


def ignored(content: Column, directive: str, lines: int = 5) -> Column:
    """Whether one of the first lines holds an ignore directive."""
    return F.exists(F.slice(F.split(content, "\n"), 1, lines), lambda x: x.rlike(directive))


def file_issues(files: DataFrame, check: str, rules: Sequence[Rule], *, skip: str | None = None) -> DataFrame:
    """Issues (repo, check_name, rule_id, severity, message, file, line) of a rule set over ``files(repo, path, content)``."""
    if skip:
        files = files.where(~ignored(F.col("content"), skip))
    hits = scan(lines_of(files, ["repo", "path"]), rules, path="path")
    return hits.select(
        "repo", F.lit(check).alias("check_name"), "rule_id", "severity", "message", F.col("path").alias("file"), F.col("line_no").cast("int").alias("line")
    )
