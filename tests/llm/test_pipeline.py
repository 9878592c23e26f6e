"""The pipeline on small tables: every stage against brute force, odd rows, and runs side by side."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm.decontaminate import match_words

from .conftest import SCHEMA, prose
from .test_matching import roots, slow_fingerprint, slow_marks, slow_removal

LABELS, BENCHMARK = "doc_id long, quality int, toxic int", "item_id long, text string"


def save(spark, folder, docs, labels, benchmark):
    for name, frame in (("documents", docs), ("labels", spark.createDataFrame(labels, LABELS)), ("benchmark", spark.createDataFrame(benchmark, BENCHMARK))):
        frame.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    passage, secret = prose(900, 60), prose(901, 30)
    rows = []
    for i in range(120):
        words = f"{prose(i, 60)} {prose(i + 77, 20)}".split()
        if i % 6 == 0:
            words[::8] = ["vile", "scum"] * 5
        text = " ".join(words)
        text += f"\n{passage}" if i % 10 == 3 else ""
        text += f"\n{secret}" if i % 20 == 7 else ""
        rows.append((i, text, "en", "s", len(text), 1, "x", "y"))
    rows += [(200 + i, rows[i][1], "en", "s", 1, 1, "x", "y") for i in (1, 2, 3)] + [rows[5]]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    benchmark = [(1, " ".join(secret.split()[5:25])), (2, prose(950, 40)), (3, None)]
    return save(spark, tmp_path_factory.mktemp("tables"), spark.createDataFrame(rows, SCHEMA), labels, benchmark)


def rows_of(frame):
    return sorted((r.asDict() for r in frame.collect()), key=repr)


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, tables)
    assert clean.columns == docs.columns
    left = rows_of(clean)
    vile = {r["doc_id"] for r in docs.collect() if "vile" in r["text"]}
    assert not vile & {r["doc_id"] for r in left} and len(left) >= 0.9 * (docs.count() - len(vile))

    unique = rows_of(stages["simhash_near_dedup"](spark, clean, tables))
    prints = [slow_fingerprint(r["text"]) for r in left]
    links = [(a, b) for a in range(len(left)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = defaultdict(set)
    for i, root in enumerate(roots(len(left), links)):
        group[root].add(left[i]["doc_id"])
    assert sorted(r["doc_id"] for r in unique) == sorted(min(ids) for ids in group.values())

    kept = {r["doc_id"]: r for r in stages["substring_dedup"](spark, spark.createDataFrame(unique, docs.schema), tables).collect()}
    for r, (_, gone, words) in zip(unique, slow_removal([r["text"] for r in unique], 35), strict=True):
        own = kept[r["doc_id"]]
        assert own["text"] == r["text"] if not gone else " ".join(own["text"].split()) == words
        assert own["n_chars"] == (len(own["text"]) if gone else r["n_chars"])

    whole = [r.asDict() for r in kept.values()]
    items = {r["item_id"]: match_words((r["text"] or "").encode()) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    fair = stages["benchmark_decontamination"](spark, spark.createDataFrame(whole, docs.schema), tables)
    expected = {r["doc_id"] for r in whole if not slow_marks(match_words(r["text"].encode()), items)[0]}
    assert {r["doc_id"] for r in fair.collect()} == expected and 0 < len(expected) < len(whole)

    packed = stages["packing"](spark, fair, tables).collect()
    tokens = defaultdict(int)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == expected and all(tokens[r["doc_id"]] == r["doc_tokens"] for r in packed)


def test_runs_side_by_side(spark, tables):
    """A run's result can be read after another run, and both are equal."""
    first = corpus_pipeline.run(spark, tables)
    second = corpus_pipeline.run(spark, tables).select("doc_id", "start", "length", "ids_crc32")
    one = rows_of(first.select("doc_id", "start", "length", "ids_crc32"))
    assert one == rows_of(second) == rows_of(first.select("doc_id", "start", "length", "ids_crc32")) and one


def test_odd_rows_clashing_names_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    clash = odd_docs
    for name in ("_id", "_key", "_text", "row", "key", "id", "wanted", "fp", "k1", "_k1", "spans", "component_id", "n_removed", "predicted", "items", "part", "number", "_train", "known"):
        clash = clash.withColumn(name, F.lit("mine"))
    labels = [(i, 1, i % 2) for i in range(12)] + [(None, None, None), (5, None, 1)]
    for n, docs in enumerate((clash, no_docs)):
        for m, own in enumerate((labels, [])):
            folder = save(spark, tmp_path / f"{n}{m}", docs, own, [(1, "tie tie"), (None, None)] if own else [])
            current = spark.read.parquet(f"{folder}/documents.parquet")
            for _, stage in corpus_pipeline.STAGES[:-1]:
                after = stage(spark, current, folder)
                assert after.columns == current.columns
                current = after
            pieces = corpus_pipeline.STAGES[-1][1](spark, current, folder).collect()
            assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces[0].asDict() if pieces else pieces_columns(spark, folder))
            assert bool(pieces) == (n == 0)


def pieces_columns(spark, folder):
    return corpus_pipeline.run(spark, folder).columns


def test_words_are_the_contract_s():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb c") == ["a", "b", "c"]
