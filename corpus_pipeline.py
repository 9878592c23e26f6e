"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes the documents that the stage before it kept, all of them, as a table.  A stage
works in a workspace of its own.  :func:`run` closes it once the stage's result is written, and drops
a result once the next one is; what a stage called for itself leaves behind are the few tables its result reads,
until the driver ends.  Nothing is shared between runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Workspace
from auditlake.llm.decontaminate import mark_contamination
from auditlake.llm.packing import pack
from auditlake.llm.queries import table, tokenizer
from auditlake.llm.simhash import near_duplicates
from auditlake.llm.substring_dedup import remove_repeats
from auditlake.llm.toxicity import score_toxicity

#: SQL cannot express the first stage's trained model or the last one's packing.
ORACLE_SQL = None

Step = Callable[[SparkSession, DataFrame, str, Workspace], DataFrame]


def _whole(docs: DataFrame) -> DataFrame:
    """The row as one column, but for its text, beside what operators read, so that no names clash.

    Both columns go through an operator, which gets the text once.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), "doc_id", "text")


def _unfolded(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from rows of :func:`_whole`."""
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def _drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, workspace: Workspace) -> DataFrame:
    scored = score_toxicity(_whole(docs), table(spark, sf_dir, "labels"), workspace, carry=("row", "text"))
    return scored.where("predicted = 0").select(_unfolded(docs))


def _drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, workspace: Workspace) -> DataFrame:
    rows = _whole(docs).withColumn("key", F.xxhash64("text"))
    found = near_duplicates(rows, workspace, carry=("key",))
    alone = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    chosen = found.where("doc_id <=> component_id").groupBy("component_id", alone.alias("alone")).agg(F.min("key").alias("wanted"))
    chosen = workspace.write(chosen.select(F.col("component_id").alias("id"), "wanted"), "chosen")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("wanted"))
    return rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "key"]).select(_unfolded(docs))


def _drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, workspace: Workspace) -> DataFrame:
    cut = remove_repeats(_whole(docs), workspace, carry=("row", "text"))
    changed = {"text": F.col("clean_text"), "n_chars": F.coalesce(F.length("clean_text"), F.lit(0))}
    columns = [
        F.when(F.col("n_removed") > 0, changed[c].cast(kind)).otherwise(own).alias(c) if c in changed else own
        for own, (c, kind) in zip(_unfolded(docs), docs.dtypes, strict=True)
    ]
    return cut.select(columns)


def _drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, workspace: Workspace) -> DataFrame:
    marked = mark_contamination(_whole(docs), table(spark, sf_dir, "benchmark"), carry=("row", "text"))
    return marked.where(F.size("spans") == 0).select(_unfolded(docs))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str, workspace: Workspace) -> DataFrame:
    return pack(docs, workspace, **tokenizer())


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return _drop_toxic(spark, docs, sf_dir, Workspace(spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Repeated rows of it count as one.  A group without any id keeps one document for each fingerprint.
    """
    return _drop_near_duplicates(spark, docs, sf_dir, Workspace(spark))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; a document that loses nothing is unchanged.

    ``n_chars`` of a document that loses words is that of the text that is left, 0 if none is.
    """
    return _drop_repeats(spark, docs, sf_dir, Workspace(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return _drop_contaminated(spark, docs, sf_dir, Workspace(spark))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each with its sequence and offset.  A null text is an empty one."""
    return _pack(spark, docs, sf_dir, Workspace(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_documents),
]


_STEPS: list[Step] = [_drop_toxic, _drop_near_duplicates, _drop_repeats, _drop_contaminated, _pack]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  Each stage's result is a table in the shared folder until the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for (name, _), step in zip(STAGES[:-1], _STEPS[:-1], strict=True):
        kept, own = Workspace(spark), Workspace(spark)
        docs = kept.write(step(spark, docs, sf_dir, own), name)
        own.close()
        if before:
            before.close()
        before = kept
    packed = _STEPS[-1](spark, docs, sf_dir, Workspace(spark))  # reads its own tables only
    before.close()
    return packed
