"""Shared helpers: tables in the shared folder, word hashes, winnowing, Bloom filters."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a session that runs on one machine, as tests do, gets a temporary folder where none is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows go to Python workers in batches of so many bytes while a table is written; both sides hold one or two of them.
_BATCH = 8 << 20


class Workspace:
    """Intermediate tables of one job, written as Parquet in the shared folder.

    A written table cuts the lineage: it survives the loss of any executor.
    The files go when :meth:`close` is called, or else when the driver ends.  An operator
    works in a :meth:`scope` of its caller's workspace and at its end keeps
    the tables only that its result reads.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self._tables = spark, []
        self.files: int | None = None  # at most so many a table, where an operator knows that its tables are small
        self.root = root or f"{shared_dir(spark)}/auditlake-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        if root is None:
            self._fs.mkdirs(self._path)
            self._fs.deleteOnExit(self._path)

    def scope(self) -> Workspace:
        """A workspace of its own inside this one."""
        return Workspace(self.spark, f"{self.root}/{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: a column whose values get a folder each, for :meth:`drop`."""
        path = f"{self.root}/{len(self._tables)}-{name}"
        conf, size = self.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        own = {size: f"{min(_BATCH, self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(size)))}b"}
        if by:  # an open file for each folder, no sorting of large rows
            own["spark.sql.maxConcurrentOutputFileWriters"] = "8"
        before = {k: conf.get(k) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            (df.coalesce(self.files) if self.files else df).write.parquet(path, compression="zstd", partitionBy=by)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((table, path))
        return table

    def _delete(self, path: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables written so far but these."""
        for table, path in self._tables:
            if not any(table is x for x in tables):
                self._delete(path)

    def drop(self, table: DataFrame, folder: str = "") -> None:
        """Delete a table, or one folder of it."""
        for own, path in self._tables:
            if own is table:
                self._delete(f"{path}/{folder}")

    def close(self) -> None:
        self._fs.delete(self._path, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 32-bit code for each word, spread over 64 bits."""
    return mix(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 128-bit hash of each word, as two numbers, where words are not compared themselves."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64)
    return np.ascontiguousarray(both.reshape(-1, 2).T)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive word codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power, have = codes, 0x9E3779B97F4A7C15, 1
    while have * 2 <= k:  # runs of twice the length
        m = len(codes) - 2 * have + 1
        out = out[:m] * np.uint64(power) + out[have : have + m]
        power, have = power * power % (1 << 64), have * 2
    if have < k:  # the rest overlaps what is there; both ends fix the run
        out = out[:n] * np.uint64(0xD6E8FEB86659FD93) + out[k - have : k - have + n]
    return mix(out)


_LOW = np.uint64((1 << 24) - 1)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` hashes the place of its least one, the rightmost of equals.

    The choice depends on the window's content alone, so equal windows choose alike.
    Places never fall from one window to the next.
    """
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    step = 1 << 23
    if n > step:
        return np.concatenate([i + winnow(hashes[i : min(i + step, n) + w - 1], w) for i in range(0, n, step)])
    least = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    have = 1
    while have * 2 <= w:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < w:
        least = np.minimum(least[:n], least[w - have : w - have + n])
    return (_LOW - (least & _LOW)).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the stretches of ``width`` from ``starts``."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + width, n), -1)
    return np.cumsum(depth[:n]) > 0


class Bloom:
    """Bit array with two probes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in (hashes & self.mask, mix(hashes) & self.mask):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def build(hashes: DataFrame, column: str, count: int, most_bits: int) -> Bloom:
        """Of a column of hashes; only the bit array, of at most ``most_bits`` bits, reaches the driver."""
        bits = min(most_bits, 1 << max(16, int(16 * count).bit_length()))

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mask = np.uint64(bits - 1)
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                place = np.concatenate((h & mask, mix(h) & mask))
                yield pa.record_batch([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array((place & np.uint64(63)).astype(np.int32))], ["word", "bit"])

        rows = hashes.select(column).mapInArrow(lean(parts), "word int, bit int")
        table = rows.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        return Bloom(words)


def pick(docs: DataFrame, carry: tuple[str, ...], text_col: str, *, once: bool = False) -> DataFrame:
    """The carried columns and the text as ``_text``; any other column is left behind.

    ``once``: a text that is carried itself is ``_text`` only, for :func:`carried` to give back.
    """
    alone = once and dict(docs.dtypes).get(text_col) == "string"
    return docs.select(*[F.col(f"`{c}`") for c in carry if not (alone and c == text_col)], F.col(f"`{text_col}`").cast("string").alias("_text"))


def carried(batch: pa.RecordBatch, carry: tuple[str, ...]) -> list[pa.Array]:
    """The carried columns of a batch."""
    return [batch.column(c if c in batch.schema.names else "_text") for c in carry]


def with_fields(df: DataFrame, carry: tuple[str, ...], more: str) -> StructType:
    """The schema of the carried columns, followed by further ones given as DDL."""
    own = [f for f in df.schema.fields if f.name in carry]
    if len(own) < len(carry) and "_text" in df.columns:  # the text is carried as ``_text``
        found = {f.name: f for f in own}
        own = [found.get(c) or StructField(c, StringType()) for c in carry]
    return StructType(own + StructType.fromDDL(more).fields)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(step: Step) -> Step:
    """The step for ``mapInArrow``; at its end, what its worker has freed goes back to the system.

    Workers outlive their tasks, several of them for each core, and an idle one would keep the memory of its peak.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None) if sys.platform == "linux" else None
        if hasattr(libc, "mallopt"):
            # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD, which else grow to 32 and 64 MB; lower ones cost page faults for each array.
            libc.mallopt(-3, 8 << 20)
            libc.mallopt(-1, 16 << 20)
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about ``most`` bytes of a text column, at least a row each."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
