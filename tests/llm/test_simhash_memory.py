"""A dense group of near copies takes little memory and keeps its links."""

import tracemalloc

import numpy as np

from auditlake.llm.common import Workspace
from auditlake.llm.simhash import _link_groups, near_duplicates


def dense(n, flips, seed=1):
    rng = np.random.default_rng(seed)
    codes = np.zeros(4 * n, np.uint64)
    for _ in range(flips):
        codes ^= np.uint64(1) << rng.integers(0, 48, 4 * n).astype(np.uint64)
    codes = rng.permutation(np.unique(codes))[:n]
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return codes[np.argsort(rank)]


def test_dense_group_in_little_memory():
    codes = dense(8_000, 6)
    tracemalloc.start()
    found = _link_groups(np.zeros(len(codes), np.int64), codes, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20
    slow = np.arange(len(codes))
    while True:  # the least label among all neighbours, until nothing changes
        new = np.array([slow[np.bitwise_count(codes ^ c) <= 3].min() for c in codes])
        new = new[new]
        if np.array_equal(new, slow):
            break
        slow = new
    assert np.array_equal(found, slow)


def test_small_tables_are_few_files(spark, monkeypatch):
    """Hundreds of shuffle partitions make no hundreds of files and tasks of a few rows each."""
    seen = []
    write = Workspace.write

    def noted(self, df, name, by=None):
        table = write(self, df, name, by)
        seen.append((name, len(table.inputFiles())))
        return table

    monkeypatch.setattr(Workspace, "write", noted)
    monkeypatch.setattr("auditlake.llm.simhash._LEAST_FILES", 3)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 40 :])) for i in range(200)], "doc_id long, text string")
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = near_duplicates(docs, Workspace(spark)).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(got) == 200 and all(r["component_id"] <= r["doc_id"] % 40 for r in got)
    assert max(n for name, n in seen if name != "prints") <= 3
