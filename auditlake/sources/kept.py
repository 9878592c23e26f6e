"""Tables of one job, written as Parquet in the folder that all machines share: they cut long plans short."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Kept:
    """Tables that go when the driver ends, or when :meth:`close` is called.

    They lie in ``spark.checkpoint.dir``; only a session on one machine may do without that setting.
    """

    def __init__(self, spark: SparkSession) -> None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            top = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        self.spark, self.root = spark, f"{top}/auditlake-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)

    def add(self, name: str, *frames: DataFrame) -> DataFrame:
        """The rows of all frames, which have the same columns, as one table."""
        path = f"{self.root}/{name}"
        for frame in frames:
            frame.write.mode("append").parquet(path)
        return self.spark.read.schema(frames[0].schema).parquet(path)

    def close(self) -> None:
        self._fs.delete(self._path, True)
