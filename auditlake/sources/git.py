"""Version history and change sets as tables, from one ``git`` process for each repository or range."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOG_SCHEMA = "repo string, sha string, ord long, author_name string, author_email string, epoch long, subject string, is_merge boolean, path string, added long, removed long, status string"
DIFF_SCHEMA = "repo string, path string, hunk_no int, kind string, new_line_no int, text string, is_new boolean, is_deleted boolean, is_renamed boolean, is_binary boolean"
_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)")


def run_git(root: str, *args: str) -> str:
    """Output of a git command; empty where there is no repository or no such revision."""
    done = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], capture_output=True, check=False, timeout=600)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


@dataclass
class _Root(InputPartition):
    root: str


def parse_log(repo: str, text: str) -> Iterator[tuple]:
    """Rows of ``git log --numstat --summary`` with one header line for each commit."""
    head, order, seen, marks = None, -1, [], {}

    def rows() -> Iterator[tuple]:
        if head is None:
            return
        sha, name, mail, when, parents, subject = head
        fixed = (repo, sha, order, name, mail, int(when), subject, " " in parents)
        if not seen:
            yield (*fixed, None, None, None, None)
        for path, added, removed in seen:
            yield (*fixed, path, added, removed, marks.get(path, "M"))

    for line in text.split("\n"):
        if line.startswith("\x1e"):
            yield from rows()
            head, seen, marks, order = line[1:].split("\x1f"), [], {}, order + 1
        elif line.startswith(" create mode "):
            marks[line.split(" ", 4)[4]] = "A"
        elif line.startswith(" delete mode "):
            marks[line.split(" ", 4)[4]] = "D"
        elif line.count("\t") >= 2:
            added, removed, path = line.split("\t", 2)
            path = re.sub(r"\{[^{}]* => ([^{}]*)\}", r"\1", path).replace("//", "/")
            seen.append((path.split(" => ")[-1], int(added) if added.isdigit() else None, int(removed) if removed.isdigit() else None))
    yield from rows()


def parse_diff(repo: str, text: str) -> Iterator[tuple]:
    """Changed and context lines of a unified diff, with the flags of their file; a file without hunks is a row without a line."""
    files: list[tuple[dict, list]] = []
    hunk, at = 0, 0
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            path = line.rpartition(" b/")[2]
            files.append(({"path": path, "new": False, "deleted": False, "renamed": False, "binary": False}, []))
            hunk = 0
        elif not files:
            continue
        elif hunk == 0 and not line.startswith("@@"):
            flags = files[-1][0]
            flags["new"] |= line.startswith("new file mode")
            flags["deleted"] |= line.startswith("deleted file mode")
            flags["renamed"] |= line.startswith("rename to")
            flags["binary"] |= line.startswith("Binary files")
        elif line.startswith("@@"):
            hunk, at = hunk + 1, int(_HUNK.match(line)[1])
        elif line[:1] in ("+", "-", " "):
            files[-1][1].append((hunk, line[0], None if line[0] == "-" else at, line[1:]))
            at += line[0] != "-"
    for flags, rows in files:
        rest = (flags["new"], flags["deleted"], flags["renamed"], flags["binary"])
        for row in rows or [(None, None, None, None)]:
            yield (repo, flags["path"], *row, *rest)


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots, self.since, self.last = options.get("roots", ".").split(","), options.get("since"), options.get("last")

    def partitions(self) -> list[_Root]:
        return [_Root(r) for r in self.roots]

    def read(self, partition: _Root) -> Iterator[tuple]:
        args = ["log", "--numstat", "--summary", "--format=%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%P%x1f%s"]
        args += [f"--since={self.since}"] * bool(self.since) + [f"-n{self.last}"] * bool(self.last)
        yield from parse_log(os.path.basename(os.path.abspath(partition.root)), run_git(partition.root, *args))


class GitLog(DataSource):
    """A row for each file of each commit, the newest commit with ``ord`` 0; options roots, since, last."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema: object) -> _LogReader:
        return _LogReader(self.options)


#: What is compared, by policy; the first range that gives changes counts.
POLICIES = {
    "diff": [["HEAD"], ["--cached"], [], ["HEAD~1", "HEAD"]],
    "explain": [["HEAD~1"]],
    "verify": [["HEAD~1"], ["4b825dc642cb6eb9a060e54bf8d69288fbee4904", "HEAD"]],
}


class _DiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots, self.base, self.head = options.get("roots", ".").split(","), options.get("base"), options.get("head")
        self.policy = options.get("policy", "diff")

    def partitions(self) -> list[_Root]:
        return [_Root(r) for r in self.roots]

    def read(self, partition: _Root) -> Iterator[tuple]:
        ranges = [[x for x in (self.base, self.head) if x]] if self.base else POLICIES[self.policy]
        for own in ranges:
            if text := run_git(partition.root, "diff", "--no-color", "-M", *own):
                yield from parse_diff(os.path.basename(os.path.abspath(partition.root)), text)
                return


class GitDiff(DataSource):
    """Lines of a change set; options roots, and base and head or a policy."""

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return DIFF_SCHEMA

    def reader(self, schema: object) -> _DiffReader:
        return _DiffReader(self.options)


BLOB_SCHEMA = "repo string, ref string, path string, size long, content string"


def parse_blobs(repo: str, ref: str, names: list[tuple[str, str]], raw: bytes) -> Iterator[tuple]:
    """Contents from ``git cat-file --batch`` for (object, path) in the same order."""
    at = 0
    for _, path in names:
        end = raw.index(b"\n", at)
        size = int(raw[at:end].split()[-1])
        body = raw[end + 1 : end + 1 + size]
        at = end + 2 + size
        yield repo, ref, path, size, None if b"\0" in body[:512] else body.decode("utf-8", "replace")


class _BlobReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots, self.ref = options.get("roots", ".").split(","), options.get("ref", "HEAD")

    def partitions(self) -> list[_Root]:
        return [_Root(r) for r in self.roots]

    def read(self, partition: _Root) -> Iterator[tuple]:
        listed = [x.split("\t", 1) for x in run_git(partition.root, "ls-tree", "-r", self.ref).split("\n") if "\t" in x]
        names = [(a.split()[2], path) for a, path in listed if a.split()[1] == "blob"]
        done = subprocess.run(["git", "-C", partition.root, "cat-file", "--batch"], input="".join(f"{o}\n" for o, _ in names).encode(), capture_output=True, check=False, timeout=600)
        if done.returncode == 0:
            yield from parse_blobs(os.path.basename(os.path.abspath(partition.root)), self.ref, names, done.stdout)


class GitBlobs(DataSource):
    """All files of a revision, from two processes for each repository; options roots, ref."""

    @classmethod
    def name(cls) -> str:
        return "git_blobs"

    def schema(self) -> str:
        return BLOB_SCHEMA

    def reader(self, schema: object) -> _BlobReader:
        return _BlobReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], roots: tuple[str, ...], options: dict) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("roots", ",".join(roots))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def read_log(spark: SparkSession, *roots: str, **options: str) -> DataFrame:
    return _load(spark, GitLog, roots, options)


def read_diff(spark: SparkSession, *roots: str, **options: str) -> DataFrame:
    return _load(spark, GitDiff, roots, options)


def read_blobs(spark: SparkSession, *roots: str, **options: str) -> DataFrame:
    return _load(spark, GitBlobs, roots, options)


def commits(log: DataFrame) -> DataFrame:
    return log.select("repo", "sha", "ord", "author_name", "author_email", "epoch", "subject", "is_merge").distinct()


def commit_files(log: DataFrame) -> DataFrame:
    return log.where("path IS NOT NULL").select("repo", "sha", "path", "added", "removed", "status", "author_name")
