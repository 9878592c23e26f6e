"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are gathered.  Those of pairs are quantised on a
logarithmic scale and put into a Bloom filter: a count of level q is held as the q
entries (n-gram, 1) ... (n-gram, q).  A count is read back by probing levels until one is
missing; it is never too low, and a pair never counts
for more than its words.  Probabilities interpolate pair and word estimates; the
weights, one for each magnitude of the context's count, are learned by deleted interpolation.

The filter is never in one place.  Texts are read in slices of a few MB; a slice sends its
distinct n-grams, each once, as sorted blobs to the block of their hash.  A block adds up the
training counts of its blobs, fills its own part of the filter and answers each blob, and the answers
go back to the slice.  The number of blocks grows with the input and a part has
``_ENTRY_BITS`` bits for each entry, so the rate of errors is the same for any corpus and no task holds more
than a block or a slice.  Words come back with exact counts, which the base score needs too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix, sliced, texts_of, with_fields

_BASE = 1.5
_LEVELS = 64
_SEGMENTS = 64
_ENTRY_BITS = 10
_PROBES = 7
_MOST_BLOCKS = 1 << 20
_DISCOUNT = 0.75
_MAGNITUDES = 40
_BINS = 64
_COLUMNS = ["_train", "_slice", "_kind", "_block", "_keys", "_counts"]
#: No word has a space in it.
END, START = (np.uint64(xxhash.xxh64_intdigest(x, seed=7)) for x in (b" end", b" start"))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, of the token before each, and where the texts start.

    A text's tokens are its words, A-Z lower-cased, and an end.
    """
    parts = []  # hashed text by text: the words of a whole slice take ten times its bytes
    for text in texts:
        words = text.lower().split()
        words.append(b" end")
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words)))
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    sizes = [len(x) for x in parts]
    starts = np.cumsum([0, *sizes])[:-1].astype(np.int64)
    before = np.concatenate(([START], codes[:-1]))
    before[starts] = START
    return codes, before, starts


def pair_keys(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of each word with the one before it in its text."""
    before = np.concatenate(([START], words[:-1]))
    before[starts] = START
    return mix(before * _PAIR + words)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts, from 1."""
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(_BASE) + 1e-9), _LEVELS).astype(np.int64)


#: The count that stands for each level: the middle of its range.
COUNT_OF = np.concatenate(([0.0], np.maximum(1, (_BASE ** np.arange(_LEVELS) + _BASE ** np.arange(1, _LEVELS + 1) - 1) / 2)))


class LogBloom:
    """Bit array in segments; all probes of an n-gram go to the segment of its leading bits."""

    def __init__(self, segments: np.ndarray, probes: int) -> None:
        self.words, self.probes = segments, probes  # (segments: 64 or 1, 64-bit words)

    @staticmethod
    def places(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
        salt = np.uint64((level * 31 + probe + 1) * 0xA24BAED4963EE407 % (1 << 64))
        return mix(keys ^ salt) % np.uint64(bits)

    @staticmethod
    def fill(keys: np.ndarray, counts: np.ndarray, bits: int, probes: int) -> np.ndarray:
        """The bits of one segment."""
        words = np.zeros(bits // 64, np.uint64)
        levels = level_of(counts)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= level]
            for probe in range(probes):
                place = LogBloom.places(own, level, probe, bits)
                np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        return words

    @staticmethod
    def sized(keys: np.ndarray, counts: np.ndarray) -> LogBloom:
        """One segment with room for all its entries: an absent one reads as present in under 1 % of cases."""
        bits = 64 * max(1, -(-_ENTRY_BITS * int(level_of(counts).sum()) // 64))
        return LogBloom(LogBloom.fill(keys, counts, bits, _PROBES)[None], _PROBES)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram: the last of an unbroken row of members."""
        out = np.zeros(len(keys), np.int64)
        n, size = self.words.shape
        flat, alive = self.words.ravel(), np.arange(len(keys))
        for level in range(1, _LEVELS + 1):
            for probe in range(self.probes):
                own = keys[alive]
                place = self.places(own, level, probe, size * 64) + (own >> np.uint64(58)) % np.uint64(n) * np.uint64(size * 64)
                alive = alive[(flat[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            if not len(alive):
                break
            out[alive] = level
        return out


@dataclass
class Model:
    n: int
    v: int
    docs: int

    def estimates(self, count: np.ndarray, level: np.ndarray, starts: np.ndarray, seen: int = 0) -> tuple[np.ndarray, ...]:
        """Context's count, pair estimate and word estimate of each token; ``seen`` occurrences are left out."""
        count = count.astype(float)
        context = np.concatenate(([0.0], count[:-1]))
        context[starts] = self.docs
        pair = np.minimum(COUNT_OF[level], np.minimum(count, context))
        count, context, pair = (np.maximum(x - seen, 0) for x in (count, context, pair))
        by_pair = np.where(context > 0, pair / np.maximum(context, 1), 0)
        n, v = max(self.n, 1), self.v
        left = _DISCOUNT * v / n if v else 1.0
        by_word = np.maximum(count - _DISCOUNT, 0) / n + left / (v + 1)  # what is taken off goes to all words alike
        return context, by_pair, by_word

    @staticmethod
    def magnitude(context: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(np.log2(context + 1)), _MAGNITUDES - 1).astype(np.int64)


def log10(weights: np.ndarray, context: np.ndarray, by_pair: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    """Interpolated probabilities; ``weights`` are for each magnitude of the context's count."""
    weight = weights[Model.magnitude(context)]
    return np.log10(weight * by_pair + (1 - weight) * by_word)


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary for each run of values."""
    edges = np.concatenate(([0], np.cumsum(sizes) * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _planes(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the low, then the high halves of its numbers; the latter pack well."""
    out = np.empty(2 * len(at), np.uint16)
    low = np.arange(len(at)) + np.repeat(starts, sizes)
    out[low], out[low + np.repeat(sizes, sizes)] = at & 0xFFFF, at >> 16
    return out


def _gather(rows: DataFrame, blocks: int) -> DataFrame:
    """Texts in slices (kind 0: places of their words in the slice's distinct ones, 4 bytes each), and of each slice
    blobs of n-gram hashes and training counts by kind (1: words, 8 bytes each; 2: pairs, 4) and block."""
    names = [f.name for f in rows.schema.fields if f.name not in ("_train", "_text")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "_text", 8 << 20):
            codes, _, starts = tokens(texts_of(batch.column("_text")))
            sizes = np.diff(starts, append=len(codes))
            learned = np.repeat(batch.column("_train").to_numpy(zero_copy_only=False), sizes).astype(float)
            words, at = np.unique(mix(codes), return_inverse=True)
            pairs, where = np.unique(pair_keys(words[at], starts) & pair_mask(blocks), return_inverse=True)
            n = len(batch)
            fixed = [pa.array(np.full(n, number)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), batch.column("_train"), *fixed, _binaries(_planes(at, starts, sizes), 2 * sizes), pa.nulls(n, pa.binary())],
                [*names, *_COLUMNS],
            )
            for kind, keys, every in ((1, words, at), (2, pairs, where)):
                counts = np.bincount(every, learned, len(keys)).astype(np.uint32)
                block = (keys >> np.uint64(65 - blocks.bit_length())).astype(np.int32)
                edges = np.flatnonzero(np.diff(block, prepend=-1))
                own = np.diff(edges, append=len(keys))
                raw = _binaries(keys, own) if kind == 1 else _binaries((keys >> _spare(blocks)).astype(np.uint32), own)
                n = len(edges)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.nulls(n, batch.schema.field(c).type) for c in names),
                        pa.nulls(n, pa.bool_()),
                        pa.array(np.full(n, number)),
                        pa.array(np.full(n, kind, np.int32)),
                        pa.array(block[edges]),
                        raw,
                        _binaries(counts, own),
                    ],
                    [*names, *_COLUMNS],
                )
            number += 1

    return rows.mapInArrow(scan, with_fields(rows, tuple(names), "_train boolean, _slice long, _kind int, _block int, _keys binary, _counts binary"))


def _spare(blocks: int) -> np.uint64:
    return np.uint64(65 - blocks.bit_length() - 32)


def pair_mask(blocks: int) -> np.uint64:
    """Of a pair's hash the block and 32 bits are kept: the filter errs more often than that."""
    return ~((np.uint64(1) << _spare(blocks)) - np.uint64(1))


def _answers(blobs: DataFrame, blocks: int) -> DataFrame:
    """What each slice asked, by kind and block, in the order of its blob: words (with their hashes) get their
    counts, 8 bytes each, pairs their levels, a byte each.  ``_new`` sums up to the number of distinct training words."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        kind, block = int(frame["_kind"].iloc[0]), int(frame["_block"].iloc[0])
        raw, counts = b"".join(frame["_keys"]), np.frombuffer(b"".join(frame["_counts"]), np.uint32).astype(np.int64)
        if kind == 1:
            keys = np.frombuffer(raw, np.uint64)
        else:
            keys = (np.frombuffer(raw, np.uint32).astype(np.uint64) << _spare(blocks)) | (np.uint64(block) << np.uint64(65 - blocks.bit_length()))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        keys, total = keys[first], np.add.reduceat(counts[order], first)
        known = np.flatnonzero(total)
        told = total if kind == 1 else LogBloom.sized(keys[known], total[known]).levels(keys).astype(np.uint8)
        every = np.empty(len(order), told.dtype)
        every[order] = told[np.cumsum(new) - 1]
        edges = np.cumsum([0, *(len(x) // 4 for x in frame["_counts"])]).tolist()
        return pd.DataFrame(
            {
                "_slice": frame["_slice"],
                "_kind": kind,
                "_block": block,
                "_keys": frame["_keys"] if kind == 1 else None,
                "_counts": [every[a:e].tobytes() for a, e in zip(edges[:-1], edges[1:], strict=True)],
                "_new": [len(known) if kind == 1 else 0] + [0] * (len(frame) - 1),
            }
        )

    held = blobs.select("_slice", "_kind", "_block", "_keys", "_counts").where("_kind > 0")
    return held.groupBy("_kind", "_block").applyInPandas(answer, "_slice long, _kind int, _block int, _keys binary, _counts binary, _new long")


def _tell(blobs: DataFrame, answers: DataFrame, blocks: int) -> DataFrame:
    """Each text's token counts (``_counts``, 8 bytes each) and levels of pairs (``_keys``, a byte each)."""
    names = [c for c in blobs.columns if c not in _COLUMNS]

    def put(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        batch = whole.to_batches(max_chunksize=max(1, len(whole)))[0]
        kind = batch.column("_kind").to_numpy()
        edges = np.searchsorted(kind, [0, 1, 2, 3]).tolist()
        docs, words, pairs = (batch.slice(a, e - a) for a, e in zip(edges[:-1], edges[1:], strict=True))
        keys, counts = _numbers(words.column("_keys"), np.uint64), _numbers(words.column("_counts"), np.int64)
        sizes = np.array([len(x) // 4 for x in docs.column("_keys").to_pylist()], np.int64)
        starts = np.cumsum([0, *sizes])[:-1]
        low = np.arange(sizes.sum()) + np.repeat(starts, sizes)
        planes = _numbers(docs.column("_keys"), np.uint16).astype(np.int64)
        at = planes[low] | planes[low + np.repeat(sizes, sizes)] << 16
        asked = pair_keys(keys[at], starts) & pair_mask(blocks)
        _, where = np.unique(asked, return_inverse=True)
        levels = _numbers(pairs.column("_counts"), np.uint8)[where]
        columns = [*(docs.column(c) for c in names), docs.column("_train"), _binaries(counts[at], sizes), _binaries(levels, sizes)]
        return pa.RecordBatch.from_arrays(columns, [*names, "_train", "_counts", "_levels"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one slice
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column("_slice").to_numpy()
            edges = np.flatnonzero(np.diff(own, prepend=own[0] - 1)).tolist()
            for a, e in zip(edges, [*edges[1:], len(own)], strict=True):
                if held and held[0].column("_slice")[0].as_py() != own[a]:
                    yield put(held)
                    held = []
                held.append(batch.slice(a, e - a))
        if held:
            yield put(held)

    docs = blobs.where("_kind = 0")
    both = docs.unionByName(answers.drop("_new"), allowMissingColumns=True)
    dealt = both.repartition("_slice").sortWithinPartitions("_slice", "_kind", "_block")
    return dealt.mapInArrow(tell, with_fields(docs, tuple(names), "_train boolean, _counts binary, _levels binary"))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with counts, levels and where the texts start."""
    for batch in sliced(batches, "_levels", 1 << 20):
        levels = batch.column("_levels").to_pylist()
        starts = np.cumsum([0, *map(len, levels)])[:-1]
        yield batch, _numbers(batch.column("_counts"), np.int64), np.frombuffer(b"".join(levels), np.uint8), starts


def _fit_weights(train: DataFrame, model: Model) -> np.ndarray:
    """Weights of the pair estimates by deleted interpolation on all training texts.

    Each occurrence is judged by counts without itself.  Tasks report, for each magnitude
    of the context's count, how often the two estimates stand in which proportion.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, count, level, starts in _told(batches):
            context, by_pair, by_word = model.estimates(count, level, starts, seen=1)
            ratio = np.zeros(len(count), np.int64)
            has = by_pair > 0
            ratio[has] = np.clip(np.floor(2 * np.log2(by_pair[has] / by_word[has])) + 10, 1, _BINS - 1)
            key, n = np.unique(model.magnitude(context) * _BINS + ratio, return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])

    rows = train.select("_counts", "_levels").mapInArrow(compare, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((_MAGNITUDES, _BINS))
    for r in rows:
        table.ravel()[r["key"]] = r["n"]
    ratio = np.concatenate(([0.0], 2 ** ((np.arange(1, _BINS) - 9.5) / 2)))
    weights = np.full(_MAGNITUDES, 0.5)
    seen = table.sum(axis=1)
    for _ in range(60):
        part = weights[:, None] * ratio / (weights[:, None] * ratio + (1 - weights[:, None]))
        weights = np.where(seen > 0, (table * part).sum(axis=1) / np.maximum(seen, 1), 0.1)
        weights = np.clip(weights, 0, 0.99)
    weights[0] = 0  # unseen contexts say nothing
    return weights


def score_texts(
    docs: DataFrame,
    train: Column,
    workspace: Workspace,
    *,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    filter_bits: int = 1 << 30,
    pairs_per_block: int = 4_000_000,
) -> DataFrame:
    """Score whole texts by a model of those rows where ``train`` is true.

    Returns the columns ``carry`` of ``docs``, then ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens`` (long), ``base_score`` (add-one word model) and ``score`` (the model's log10
    probability).  A null text is an empty one: its only token is the end.  A row for which
    ``train`` is null (a null id) is scored and not learned from.  Without training rows the base
    score is that of a one-word vocabulary.  Repeated rows count as often as they come.
    All words have exact counts.  ``filter_bits`` bounds one block's part of the filter, never the whole.
    """
    rows = docs.withColumn("_train", train).select(*[F.col(f"`{c}`") for c in carry], F.coalesce("_train", F.lit(False)).alias("_train"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text")).alias("bytes")).first()["bytes"] or 0
    room = min(pairs_per_block, filter_bits // (2 * _ENTRY_BITS))
    blocks = _SEGMENTS
    while blocks < _MOST_BLOCKS and size / 6 > blocks * room:
        blocks *= 2
    workspace = workspace.scope()
    blobs = workspace.write(_gather(rows, blocks), "blobs", by="_kind")
    answers = workspace.write(_answers(blobs, blocks), "answers")
    for kind in (1, 2):  # answered
        workspace.drop(blobs, f"_kind={kind}")
    told = workspace.write(_tell(blobs, answers, blocks), "told")
    seen = blobs.where("_kind = 0 AND _train").agg(F.count("*").alias("docs"), F.sum(F.octet_length("_keys") / 4).cast("long").alias("n")).first()
    n, v = seen["n"] or 0, answers.agg(F.sum("_new").alias("v")).first()["v"] or 0
    model = Model(n, v, seen["docs"])
    workspace.keep(told)
    weights = _fit_weights(told.where("_train"), model)
    schema = with_fields(told, carry, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    whole = float(np.log10(n + v + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, count, level, starts in _told(batches):
            sizes = np.diff(starts, append=len(count))
            known, logs, own = (np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), np.log10(count + 1.0), log10(weights, *model.estimates(count, level, starts))))
            columns = [pa.array(sizes), pa.array(known), pa.array(np.full(len(batch), n)), pa.array(logs - sizes * whole), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in names), *columns], schema.names)

    names = [f.name for f in told.schema.fields if f.name in carry]
    scored = told.drop("_train").mapInArrow(score, schema)
    return scored.select(*[F.col(f"`{c}`") for c in carry], *schema.names[len(names) :])
