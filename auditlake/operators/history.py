"""Commit history: churn, hotspots, files that change together, commit concerns, naming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import directory
from ..functions.fixed_values import AI_AUTHORS, AI_SUBJECTS, VERBS
from .lines import first_per


def churn(commit_files: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``commits``, distinct ``authors`` and changed lines of each file, from (sha, path, author, lines)."""
    return commit_files.groupBy(*keys).agg(
        F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"), F.sum("lines").cast("double").alias("lines_changed")
    )


def hotspots(churned: DataFrame, complexity: DataFrame, key: str = "path") -> DataFrame:
    """Risk log2(commits + 1) x ``complexity`` of each file."""
    return churned.join(complexity, key).withColumn("risk", F.log2(F.col("commits") + 1) * F.col("complexity"))


def cochange(commit_files: DataFrame, *, largest_commit: int = 20, least: int = 3, strength: float = 0.5) -> DataFrame:
    """Pairs of files (``a`` before ``b``) that change together, with ``strength`` by the rarer one.

    Commits of over ``largest_commit`` files say nothing and would make most pairs.
    """
    files = commit_files.select("sha", "path").distinct()
    commits = files.groupBy("path").agg(F.count("*").alias("n"))
    small = files.groupBy("sha").agg(F.collect_list("path").alias("p"), F.count("*").alias("size")).where(F.col("size").between(2, largest_commit))
    pairs = small.select(F.explode(F.expr("flatten(transform(array_sort(p), (x, i) -> transform(slice(array_sort(p), i + 2, size), y -> struct(x AS a, y AS b))))")).alias("_p")).select("_p.*")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    a, b = commits.select(F.col("path").alias("a"), F.col("n").alias("na")), commits.select(F.col("path").alias("b"), F.col("n").alias("nb"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.withColumn("strength", F.col("together") / F.least("na", "nb")).where(F.col("strength") > strength).select("a", "b", "together", "strength")


def surprising(pairs: DataFrame) -> DataFrame:
    """Pairs that change together though they stand in different directories, tests left out."""
    apart = directory(F.col("a")) != directory(F.col("b"))
    return pairs.where(apart & ~F.col("a").contains("test") & ~F.col("b").contains("test"))


def ai_commit(subject: Column, author: Column) -> Column:
    """Whether a subject or an author names an assistant."""
    return F.coalesce(subject.rlike("|".join(AI_SUBJECTS)), F.lit(False)) | F.coalesce(author.rlike(AI_AUTHORS), F.lit(False))


def history_summary(commits: DataFrame, commit_files: DataFrame, *, last: int = 50, large: int = 20) -> DataFrame:
    """Of the last commits of each repository: number, share by assistants, and commits of over ``large`` files."""
    recent = first_per(commits, ["repo"], [F.desc("ord")], last)
    sizes = commit_files.groupBy("repo", "sha").agg(F.count_distinct("path").alias("files"))
    joined = recent.join(sizes, ["repo", "sha"], "left")
    ai = ai_commit(F.col("subject"), F.col("author_name"))
    return joined.groupBy("repo").agg(
        F.count("*").alias("n_commits"), (100.0 * F.count_if(ai) / F.count("*")).alias("ai_percent"), F.count_if(F.col("files") > large).alias("n_large")
    )


def concern(path: Column) -> Column:
    """test, config, or the first source directory of a path."""
    base = F.substring_index(path, "/", -1)
    return (
        F.when(path.rlike(r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+\z"), F.lit("test"))
        .when(base.rlike(r"^\.|\.(json|ya?ml|toml|ini|lock|config\.[cm]?[jt]s)\z|^Dockerfile|^Makefile"), F.lit("config"))
        .otherwise(F.concat(F.lit("src:"), F.when(F.instr(path, "/") > 0, F.substring_index(F.regexp_replace(path, "^(src|lib|app)/", ""), "/", 1)).otherwise("(root)")))
    )


def commit_concerns(commit_files: DataFrame) -> DataFrame:
    """Clusters and files of each commit, the points they cost, and a word for each cluster's message."""
    by = commit_files.withColumn("concern", concern(F.col("path"))).groupBy("repo", "sha", "concern").agg(
        F.count_distinct("path").alias("files"), F.every(F.col("status") == "A").alias("added"), F.every(F.col("status") == "D").alias("deleted")
    )
    word = F.when(F.col("added"), "add").when(F.col("deleted"), "remove").otherwise("update")
    out = by.groupBy("repo", "sha").agg(F.count("*").alias("clusters"), F.sum("files").alias("files"), F.sort_array(F.collect_list(F.struct("concern", word.alias("verb")))).alias("plan"))
    many = F.when((F.col("clusters") > 1) & (F.col("files") > 5), F.least(F.lit(20), 5 * (F.col("clusters") - 1))).otherwise(0)
    return out.withColumn("deduction", many + F.when(F.col("files") > 20, 15).otherwise(0))


def split_verb(name: Column, verbs: Sequence[str] = VERBS) -> Column:
    """The first verb in order that leads the name with a capital after it, and the rest; null if none does."""
    form = rf"^({'|'.join(verbs)})([A-Z][\w$]*)\z"
    verb = F.regexp_extract(name, form, 1)
    return F.when(verb != "", F.struct(verb.alias("verb"), F.regexp_extract(name, form, 2).alias("suffix")))


def naming_drift(names: DataFrame, verb: str, suffix: str, *, least: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Suffixes with ``least`` or more different verbs."""
    out = names.groupBy(*keys, suffix).agg(F.count_distinct(verb).alias("n_verbs"), F.array_sort(F.collect_set(verb)).alias("verbs"))
    return out.where(F.col("n_verbs") >= least)


def growth(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Growth of each file since the baseline in percent, from (repo, path, lines); a new file counts from 1 line."""
    joined = now.join(baseline.withColumnRenamed("lines", "was"), ["repo", "path"], "left")
    return joined.withColumn("growth", 100.0 * (F.col("lines") - F.coalesce("was", F.lit(0))) / F.greatest(F.coalesce("was", F.lit(1)), F.lit(1)))


def bloat_score(grown: DataFrame, *, bombs: Column | None = None, padding: Column | None = None) -> DataFrame:
    """Score of each repository by its ratio of totals, files over 500 %, large files and padding."""
    ratio = F.when(F.sum("was") > 0, F.sum("lines") / F.sum("was")).otherwise(1.0)
    out = grown.groupBy("repo").agg(ratio.alias("ratio"), F.count_if(F.col("growth") > 500).alias("over"))
    cut = F.when(F.col("ratio") > 20, 40).when(F.col("ratio") > 10, 30).when(F.col("ratio") > 5, 20).otherwise(0) + F.least(F.lit(30), 5 * F.col("over"))
    for extra in (bombs, padding):
        if extra is not None:
            cut = cut + extra
    return out.withColumn("score", F.greatest(F.lit(0), 100 - cut).cast("double"))
