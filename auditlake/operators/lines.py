"""Lines of files, and order-dependent scans over them as window functions.

Windows are partitioned by file, so a partition is no larger than the largest file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """``line_no`` (from 1) and ``text`` of each line, beside the keys."""
    return files.select(*keys, F.posexplode(F.split(content, "\n")).alias("pos", "text")).select(
        *keys, (F.col("pos") + 1).cast("long").alias("line_no"), "text"
    )


def _in_file(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("line_no")


def with_parity(lines: DataFrame, keys: Sequence[str], toggle: Column, name: str = "inside") -> DataFrame:
    """True where an odd number of toggling lines stands before: inside a fence or a template literal."""
    before = _in_file(keys).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn(name, F.coalesce(F.sum(toggle.cast("int")).over(before), F.lit(0)) % 2 == 1)


def with_context(lines: DataFrame, keys: Sequence[str], hit: Column, reach: int, name: str = "near") -> DataFrame:
    """True where a line up to ``reach`` lines away fulfils the predicate."""
    return lines.withColumn(name, F.bool_or(hit).over(_in_file(keys).rowsBetween(-reach, reach)))


def with_section(lines: DataFrame, keys: Sequence[str], heading: Column, name: str = "section") -> DataFrame:
    """Running number of headings, the line itself included; 0 before the first."""
    upto = _in_file(keys).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(heading.cast("int")).over(upto).cast("long"))


def sections(lines: DataFrame, keys: Sequence[str], heading: Column) -> DataFrame:
    """One row for each section: number, title, lines, characters and estimated tokens (a quarter of the bytes)."""
    numbered = with_section(lines, keys, heading)
    title = F.min_by(F.when(heading, F.col("text")), F.when(heading, F.col("line_no")))
    size = F.sum(F.octet_length("text") + 1)
    return numbered.groupBy(*keys, "section").agg(
        F.coalesce(title, F.lit("(intro)")).alias("title"),
        F.count("*").alias("n_lines"),
        F.sum(F.length("text")).alias("n_chars"),
        F.ceil(size / 4).cast("long").alias("est_tokens"),
    )


def first_per(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    ranked = frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def repeats_after_first(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """All but the first row of each key: repeated names in one file."""
    ranked = frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") > 1).drop("_rank")
