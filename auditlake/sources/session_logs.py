"""Session logs (JSON lines) as a table that keeps the order of lines."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


SCHEMA = "session string, path string, mtime double, seq long, value string"


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path", ".")

    def partitions(self) -> list[_File]:
        found = [os.path.join(top, n) for top, _, names in os.walk(self.root) for n in names if n.endswith(".jsonl")]
        return [_File(p) for p in sorted(found)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        name, mtime = os.path.basename(partition.path).removesuffix(".jsonl"), os.path.getmtime(partition.path)
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for seq, line in enumerate(f):
                if line.strip():
                    yield name, partition.path, mtime, seq, line.strip()


class SessionLogs(DataSource):
    """``session``, ``seq`` and raw ``value`` of each line of every ``.jsonl`` file below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SessionLogs)
    return spark.read.format("session_logs").option("path", path).load()


def latest(raw: DataFrame, n: int = 1) -> DataFrame:
    """Lines of the ``n`` sessions that changed last; of equal times the first path."""
    files = raw.groupBy("path").agg(F.max("mtime").alias("_m"))
    chosen = files.orderBy(F.desc("_m"), "path").limit(n).select("path")
    return raw.join(F.broadcast(chosen), "path", "left_semi")
