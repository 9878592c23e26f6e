"""The operators of this package as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .decontaminate import mark_contamination
from .labelled import fold, is_held_out
from .language_id import identify_languages
from .licenses import families, scan_licenses
from .lm_scoring import score_texts
from .packing import pack
from .quality_mil import score_quality
from .quality_rules import apply_quality_rules
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark), parts=5, held_out=0)
    return scored.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), Workspace(spark), **tokenizer())
    return pieces.drop("ids")


def tokenizer() -> dict[str, str]:
    """Where the public tokenizer's files are."""
    import public_tokenizers

    path = public_tokenizers.path
    return {"tokenizer_path": path("byte_bpe_50k.json"), "ranks_path": path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents"), parts=3, held_out=1)
    return found.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2, Workspace(spark))
    return scored.select(
        "doc_id", is_held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents"), Workspace(spark))
    return scanned.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_license_paragraphs"),
        families(F.col("found")).alias("families"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["probability"])), F.lit(0.0)).alias("score"),
        F.exists("found", lambda x: x["confirmed"]).alias("confirmed"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark), parts=4, held_out=2)
    return scored.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_license_scan": op9_license_scan,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM item, unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM item),
hits AS (
  SELECT d.rid, d.i, d.n, win.item_id
  FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) d
  JOIN win ON win.n = d.n AND win.g = d.g),
hit AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS t(j) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
""",
    "op5_substring_dedup": r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS g FROM doc, unnest(range(1, len(w) - 33)) AS t(i)),
rec AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT rid, i + j AS p FROM rec, unnest(range(0, 35)) AS t(j)),
word AS (SELECT rid, p, w[p] AS x FROM doc, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (
  SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s
  FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (rid)
""",
}
