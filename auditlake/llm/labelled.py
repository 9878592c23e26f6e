"""Bounded labelled samples, calibration and hashed word counts for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")), F.lit(parts)).cast("int")


def is_held_out(id_col: str, parts: int, held_out: int) -> Column:
    """Whether a row is held out.  A row without an id is not, but nothing is learned from it either."""
    return F.coalesce(fold(id_col, parts) == held_out, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str,
    text_col: str,
    label_col: str,
    parts: int,
    held_out: int,
    per_class: int,
    longest: int = 200_000,
) -> tuple[DataFrame, dict[int, int]]:
    """``id``, ``_text`` and ``label`` (0 or 1) of about ``per_class`` training rows of each label, and how many
    training ids have each label.

    Held-out labels are nowhere looked at.  Rows are taken by a hash of their id, whole; rows with a text of over
    ``longest`` bytes are not taken.  Repeated rows are taken once.  Null ids, texts and labels are left out; of several
    labels of an id the greatest counts.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    own = own.where(fold("id", parts) != held_out).where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_class / max(n, 1)))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = own.where(place < share)  # about 2 * per_class rows
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    texts = texts.where(F.octet_length("_text") <= longest)
    return texts.join(F.broadcast(chosen), "id").select("id", "_text", "label").dropDuplicates(["id", "_text"]), sizes


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Classes are sampled apart: rows stand for their share of all training labels."""
    weights = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    return weights * len(y) / weights.sum()


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients, the constant last, of a logistic regression (Newton's method)."""
    x = np.column_stack((x, np.ones(len(x))))
    weights = np.ones(len(x)) if weights is None else weights
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + keep, x.T @ (weights * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
