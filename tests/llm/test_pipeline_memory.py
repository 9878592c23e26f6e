"""What goes through Python workers is small, and they give memory back."""

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm.common import Workspace, lean

from .conftest import SCHEMA, prose
from .test_pipeline import save


@pytest.mark.parametrize("stage", ["toxicity", "substring_dedup", "benchmark_decontamination"])
def test_rows_hold_their_text_once(spark, tmp_path, monkeypatch, stage):
    rows = [(i, prose(i, 50), "en", "s", 9, 1, "x", "y") for i in range(8)]
    folder = save(spark, tmp_path, spark.createDataFrame(rows, SCHEMA), [(i, 1, i % 2) for i in range(8)], [(1, prose(3, 50))])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    frame = type(docs)
    through = frame.mapInArrow

    def noted(self, *args, **more):
        seen.append(self.schema.simpleString())
        return through(self, *args, **more)

    monkeypatch.setattr(frame, "mapInArrow", noted)
    left = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert "row:struct<" in seen[-1] and seen[-1].count("text:string") == 1
    assert left.dtypes == docs.dtypes


def test_written_tables_are_fed_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    workspace, before = Workspace(spark), spark.conf.get(size)
    wide = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 40_000).alias("text"))
    table = workspace.write(wide.mapInArrow(sizes, "n long"), "sizes")
    assert table.agg(F.sum("n")).first()[0] >= 40_000_000 and table.agg(F.max("n")).first()[0] < 16 << 20
    assert spark.conf.get(size) == before
    workspace.close()


def test_a_step_s_memory_goes_back():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    kept = []

    def step(batches):
        for batch in batches:
            held = [np.ones(60_000, np.uint8) for _ in range(4_000)]
            kept.append(np.ones(60_000, np.uint8))  # stands above them, so that the heap cannot shrink by itself
            del held
            yield batch

    before = resident()
    for _ in lean(step)(iter([pa.record_batch([pa.array([1])], ["n"])])):
        pass
    assert resident() - before < 40 << 20
