"""Files of source trees as a table, hidden ones too (Spark's own readers pass over names that begin with ``.`` or ``_``)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.expressions import extension
from ..operators.lines import first_per

#: Directory and file names that are never read.
IGNORED = ["node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo", "vendor", "__pycache__", ".cache"]
SCHEMA = "repo string, path string, size long, mtime double, is_text boolean, content string"


@dataclass
class _Chunk(InputPartition):
    repo: str
    root: str
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [x for x in options.get("roots", options.get("path", ".")).split(",") if x]
        self.ignore = set(options.get("ignore", ",".join(IGNORED)).split(","))
        self.most_bytes = int(options.get("maxbytes", 0)) or float("inf")  # 0: whole files, whatever their size
        self.chunk = int(options.get("chunk", 500))
        self.depth = int(options.get("maxdepth", 0)) or float("inf")

    def partitions(self) -> list[_Chunk]:
        out = []
        for root in self.roots:
            repo, paths = os.path.basename(os.path.abspath(root)), []
            for top, dirs, names in os.walk(root):
                here = os.path.relpath(top, root)
                dirs[:] = sorted(d for d in dirs if d not in self.ignore and here.count(os.sep) < self.depth)
                paths += [os.path.normpath(os.path.join(here, n)) for n in sorted(names) if n not in self.ignore]
            out += [_Chunk(repo, root, paths[i : i + self.chunk]) for i in range(0, len(paths), self.chunk)]
        return out or [_Chunk("", "", [])]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        for path in partition.paths:
            whole = os.path.join(partition.root, path)
            try:
                stat = os.stat(whole)
                with open(whole, "rb") as f:
                    head = f.read(512)
                    text = b"\0" not in head
                    content = (head + f.read()).decode("utf-8", "replace") if text and stat.st_size <= self.most_bytes else None
            except OSError:
                continue
            yield partition.repo, path.replace(os.sep, "/"), stat.st_size, stat.st_mtime, text, content


class RepoFiles(DataSource):
    """``spark.read.format("repo_files").option("roots", "a,b").load()``: a partition for each ``chunk`` files."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)


def with_path_parts(files: DataFrame) -> DataFrame:
    """``base``, ``ext``, ``dir`` and ``depth`` of each path, and whether it is a test or an example."""
    path = F.col("path")
    return files.withColumns(
        {
            "base": F.substring_index(path, "/", -1),
            "ext": F.lower(extension(path)),
            "dir": F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(""),
            "depth": (F.size(F.split(path, "/")) - 1).cast("int"),
            "is_test": path.rlike(r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+\z"),
            "is_example": path.rlike(r"(^|/)(examples?|templates?|fixtures?|demos?)/"),
        }
    )


def priority(path: Column) -> Column:
    """0 for source directories, 2 for tests, 3 for examples and documents, else 1."""
    return (
        F.when(path.rlike(r"(^|/)(examples?|docs?)/"), 3).when(path.rlike(r"(^|/)(tests?|__tests__)/"), 2).when(path.rlike(r"^(src|lib|app)/"), 0).otherwise(1)
    )


def most_important(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files of each repository by priority and path."""
    return first_per(files.withColumn("_p", priority(F.col("path"))), ["repo"], ["_p", "path"], n).drop("_p")


def read_files(spark: SparkSession, *roots: str, **options: str) -> DataFrame:
    spark.dataSource.register(RepoFiles)
    reader = spark.read.format("repo_files").option("roots", ",".join(roots))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return with_path_parts(reader.load())
