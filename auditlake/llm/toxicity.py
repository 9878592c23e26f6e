"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary text, are trained on a bounded
sample of labelled documents.  Both use interpolated Kneser-Ney smoothing with discounts
estimated from counts of counts; their unigram levels back off to one table that both classes share.  There, as
on every level of this smoothing, a word counts by the contexts it continues: the classes it is seen in.  So a
rare expression says much the same under both.  A text's score
compares the two log-likelihoods, each divided by the number of words, and looks at the expression
of one word that tells the classes apart most: in a long text a few insults hardly move a mean.
A logistic regression makes it a probability.  Its inputs come from models that did not
count the row: pairs are counted once, apart for three folds, and each fold's counts are taken off in turn.

Words are hashed to ``1 << word_bits`` numbers and word pairs to ``1 << pair_bits``, which
bounds the broadcast model at any size of input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, carried, lean, mix, pick, sliced, texts_of, with_fields, word_codes
from .decontaminate import match_words
from .labelled import class_weights, labelled_sample, logistic, sigmoid

_FOLDS = 3
FEATURES = ["ratio", "most"]


def _codes(texts: list[bytes], word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, one after another, each text led by number 0; where the texts start."""
    words, starts, n = [], [], 0
    for text in texts:
        own = match_words(text)
        starts.append(n)
        n += len(own) + 1
        words.append(b"")
        words += own
    codes = (word_codes(words) >> np.uint64(64 - word_bits)).astype(np.int64)
    starts = np.array(starts, np.int64)
    codes[starts] = 0
    return codes, starts


def _pairs(first: np.ndarray, second: np.ndarray, pair_bits: int) -> np.ndarray:
    return (mix((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)) >> np.uint64(64 - pair_bits)).astype(np.int64)


def _discount(once: int, twice: int) -> float:
    """What absolute discounting takes off each count (Ney, Essen and Kneser, 1994)."""
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


@dataclass
class KneserNeyPair:
    """Both models in look-up tables; first axis: ordinary, toxic."""

    word_bits: int
    pair_bits: int
    unigram: np.ndarray  # (2, words): interpolated continuation probabilities
    weight: np.ndarray  # (2, words): what a context leaves for the unigram level
    pair: np.ndarray  # (2, pairs): discounted pair counts
    total: np.ndarray  # (2, words): times a word is a context

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text the ratio of both log-likelihoods a word, and that of the word that is most toxic."""
        out = np.zeros((len(texts), len(FEATURES)))
        codes, starts = _codes(texts, self.word_bits)
        if len(codes) < 2:
            return out
        v, w = codes[:-1], codes[1:]
        p = _pairs(v, w, self.pair_bits)
        words = np.maximum(np.diff(starts, append=len(codes)) - 1, 1)

        def spread(x: np.ndarray) -> np.ndarray:
            x = np.concatenate(([0], x.astype(np.float64)))
            x[starts] = 0
            return x

        toxic, ordinary = (
            np.add.reduceat(spread(np.log(self.pair[c, p] / self.total[c, v] + self.weight[c, v] * self.unigram[c, w])), starts) / words for c in (1, 0)
        )
        out[:, 0] = toxic - ordinary
        out[:, 1] = np.maximum.reduceat(spread(np.log(self.unigram[1, w]) - np.log(self.unigram[0, w])), starts)
        return out


class Counts:
    """Pair counts of both classes by fold, and the models that follow from all folds or from all but one."""

    def __init__(self, sample: DataFrame, workspace: Workspace, word_bits: int, pair_bits: int) -> None:
        self.bits, folds = (word_bits, pair_bits), range(_FOLDS)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "_text", 2 << 20):
                codes, starts = _codes(texts_of(batch.column("_text")), word_bits)
                sizes = np.diff(starts, append=len(codes))
                kind = np.repeat(batch.column("label").to_numpy() * _FOLDS + batch.column("fold").to_numpy(), sizes).astype(np.int64)
                at = np.flatnonzero(np.diff(np.repeat(np.arange(len(starts)), sizes), prepend=-1) == 0)
                key, n = np.unique((kind[at] << 60) | (codes[at - 1] << 30) | codes[at], return_counts=True)
                columns = [(key >> 60).astype(np.int32), (key >> 30 & (1 << 30) - 1).astype(np.int32), (key & (1 << 30) - 1).astype(np.int32), n]
                yield pa.record_batch([pa.array(x) for x in columns], ["kind", "v", "w", "n"])

        seen = sample.select("label", "fold", "_text").mapInArrow(lean(count), "kind int, v int, w int, n long")
        own = [F.sum(F.when(F.col("kind") % _FOLDS == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in folds]
        pairs = workspace.write(seen.groupBy(F.floor(F.col("kind") / _FOLDS).cast("int").alias("label"), "v", "w").agg(*own), "pairs")
        every = "+".join(f"n{k}" for k in folds)
        counts = [f"({every}-n{k})" for k in folds] + [f"({every})"]
        sums = [F.expr(f"sum({c})").alias(f"sum{i}") for i, c in enumerate(counts)]
        kinds = [F.expr(f"count_if({c} > 0)").alias(f"kinds{i}") for i, c in enumerate(counts)]
        few = [F.expr(f"count_if({c} = {m})").alias(f"few{m}_{i}") for i, c in enumerate(counts) for m in (1, 2)]

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = _pairs(batch.column("v").to_numpy(), batch.column("w").to_numpy(), pair_bits)
                yield pa.record_batch([batch.column("label"), pa.array(p.astype(np.int32)), *(batch.column(f"n{k}") for k in folds)], ["label", "p", *(f"n{k}" for k in folds)])

        # At most as many rows as the hashed tables have places.
        self.contexts = pairs.groupBy("label", "v").agg(*sums, *kinds).toArrow()
        self.continued = pairs.groupBy("label", "w").agg(*kinds).toArrow()
        self.few = {r["label"]: r for r in pairs.groupBy("label").agg(*few).collect()}
        table = pairs.mapInArrow(lean(hashed), "label int, p int, " + ", ".join(f"n{k} long" for k in folds)).groupBy("label", "p")
        self.table = table.agg(*[F.sum(f"n{k}").cast("int").alias(f"n{k}") for k in folds]).toArrow()

    def model(self, without: int = _FOLDS) -> KneserNeyPair:
        """Without one fold, or of all of them."""
        words, size = 1 << self.bits[0], 1 << self.bits[1]
        total, weight, cont = np.zeros((2, words)), np.ones((2, words)), np.zeros((2, words))
        cont[self.continued["label"].to_numpy(), self.continued["w"].to_numpy()] = self.continued[f"kinds{without}"].to_numpy()
        off = [_discount(self.few[c][f"few1_{without}"], self.few[c][f"few2_{without}"]) if c in self.few else 0.5 for c in (0, 1)]
        label, v = (self.contexts[c].to_numpy() for c in ("label", "v"))
        n = self.contexts[f"sum{without}"].to_numpy()
        some = n > 0
        total[label[some], v[some]] = n[some]
        weight[label[some], v[some]] = np.array(off)[label[some]] * self.contexts[f"kinds{without}"].to_numpy()[some] / n[some]
        pair, label = np.zeros((2, size), np.float32), self.table["label"].to_numpy()
        n = sum(self.table[f"n{k}"].to_numpy() for k in range(_FOLDS) if k != without).astype(np.float32)
        n -= np.array(off, np.float32)[label]
        pair[label, self.table["p"].to_numpy()] = np.maximum(n, 0, out=n)
        # Continuation counts of the shared level: a word's contexts there are the classes.  All unseen words together
        # have as much as half a count for each seen one.
        shared = (cont > 0).sum(axis=0) + 0.5 * cont.any(axis=0)
        shared += 0.5 * max(1, np.count_nonzero(shared)) / words
        shared /= shared.sum()
        unigram = np.empty((2, words))
        for c in (0, 1):
            take, every = _discount((cont[c] == 1).sum(), (cont[c] == 2).sum()), max(1, cont[c].sum())
            left = take * (cont[c] > 0).sum() / every if cont[c].any() else 1.0
            unigram[c] = np.maximum(cont[c] - take, 0) / every + left * shared
        return KneserNeyPair(*self.bits, *(x.astype(np.float32) for x in (unigram, weight)), pair, np.maximum(total, 1).astype(np.float32))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    workspace: Workspace,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    carry: tuple[str, ...] = ("doc_id",),
    parts: int = 5,
    held_out: int = 0,
    per_class: int = 6_000,
    word_bits: int = 20,
    pair_bits: int = 21,
    threshold: float = 0.5,
) -> DataFrame:
    """Score every whole text for toxicity.

    Returns the columns ``carry`` of ``docs``, then ``score`` (0 to 1, higher is more toxic) and
    ``predicted`` (1 from ``threshold`` on).  Labels are learned from rows whose
    crc32(id as text) modulo ``parts`` is not ``held_out``, from about ``per_class`` documents of each
    label (equal texts of one label once); id, language and source are no inputs.  Rows without an id are scored and
    not learned from.  Null, empty and wordless texts get the score of a
    text that speaks for neither model.  If the sample lacks one of the labels, every
    score is the share of toxic rows in it (0 if it has no rows).  Repeated rows score alike.
    """
    workspace, context = workspace.scope(), docs.sparkSession.sparkContext
    sample, sizes = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, parts=parts, held_out=held_out, per_class=per_class)
    sample = sample.dropDuplicates(["_text", "label"]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "_text"), F.lit(_FOLDS)).cast("int"))
    sample = workspace.write(sample, "sample")
    counts = Counts(sample, workspace, word_bits, pair_bits)

    def measured(without: int) -> pa.Table:
        """Of a fold's rows by the model that did not count them: at most about 2 * per_class rows of four numbers in all."""
        shared = context.broadcast(counts.model(without))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "_text", 2 << 20):
                found = shared.value.features(texts_of(batch.column("_text")))
                yield pa.record_batch([batch.column("label"), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], ["label", *FEATURES])

        rows = sample.where(F.col("fold") == without).select("label", "_text")
        found = rows.mapInArrow(lean(measure), "label int, " + ", ".join(f"{c} double" for c in FEATURES)).toArrow()
        shared.destroy()
        return found

    found = pa.concat_tables([measured(k) for k in range(_FOLDS)])
    shared = context.broadcast(counts.model())
    del counts
    workspace.close()
    x, y = np.column_stack([found[c].to_numpy() for c in FEATURES]), found["label"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    base, fit = float(y.mean()) if len(y) else 0.0, None
    if len(set(y.tolist())) == 2:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        fit = (mean, scale, logistic((x - mean) / scale, y, class_weights(y, sizes)))
    base_docs = pick(docs, carry, text_col, once=True)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", 2 << 20):
            if fit is None:
                p = np.full(len(batch), base)
            else:
                mean, scale, w = fit
                p = sigmoid((shared.value.features(texts_of(batch.column("_text"))) - mean) / scale @ w[:-1] + w[-1])
            columns = [*carried(batch, carry), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "score", "predicted"])

    return base_docs.mapInArrow(lean(score), with_fields(base_docs, carry, "score double, predicted int"))
