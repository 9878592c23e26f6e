"""The same analyses over live event and session streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def timed(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp with a watermark (a time without a zone cannot carry one)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(stream: DataFrame, size: str, keys: list[str], *, slide: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; a window is emitted once, when the watermark has passed it."""
    out = stream.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *keys, "n", "total")


def user_sessions(stream: DataFrame, gap: str = "30 minutes", *, user: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Sessions that end with a gap in a user's events."""
    out = stream.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(user, F.col("w.start").alias("started"), "n", "total")


def distinct_events(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


class IterationCounter(StatefulProcessor):
    """For each session the number of its current iteration, and changes since the last test run.

    The state of a session is two numbers, whatever its length.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("iteration", "iter_no long, changes long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        tests, changes = self.state.get() if self.state.exists() else (0, 0)
        for frame in rows:
            for row in frame.sort_values("seq").itertuples(index=False):
                if row.action == "test":
                    tests, changes = tests + 1, 0
                elif row.action == "write":
                    changes += 1
        self.state.update((tests, changes))
        yield pd.DataFrame({"session": [key[0]], "iter_no": [max(1, tests)], "changes": [changes]})

    def close(self) -> None:
        pass


def live_iterations(calls: DataFrame) -> DataFrame:
    """A row for each session of a micro-batch, from calls (session, seq, action).  Needs the RocksDB state store."""
    return calls.groupBy("session").transformWithStateInPandas(
        statefulProcessor=IterationCounter(), outputStructType="session string, iter_no long, changes long", outputMode="Update", timeMode="None"
    )


def rerun_changed(plan: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the plan's rows of the repositories in a micro-batch replace those in a partitioned table."""

    def write(batch: DataFrame, _: int) -> None:
        rows = plan(batch)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)

    return write
