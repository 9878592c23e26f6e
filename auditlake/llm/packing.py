"""Packing of documents into sequences by non-negative least squares.

1. Documents are tokenized where they are read, closed by an end token and cut into pieces of
   the sequence length; what is left over is a shorter last piece.  Pieces are a
   written table with their token ids.  While a task writes, it numbers the short pieces
   of each length.
2. The histogram of short pieces (as many numbers as a sequence has tokens) goes to the driver.
   All combinations of up to ``depth`` of its lengths that fill a sequence exactly are
   enumerated; non-negative least squares finds how often to repeat each.  Repeats
   are rounded to what there is, the residue is solved again, and what is left then is packed
   greedily: longest pieces first, end to end, cut where a sequence is full.
   This works on counts: its cost depends on the sequence length, not on the input.
3. The plan says for each length which run of its pieces goes to which sequences.  A piece's number
   among all of its length is its number in its task plus the pieces of that
   length in earlier tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, lean, pick, sliced, with_fields

#: Sequences of full pieces are numbered from here, apart from those of the plan.
FULL_BASE = 1 << 40


def combinations(lengths: np.ndarray, total: int, depth: int = 3) -> np.ndarray:
    """All multisets of 2 to ``depth`` (at most 3) of the lengths with sum ``total``; a row each, padded with 0."""
    have = np.zeros(total + 1, bool)
    have[lengths] = True
    found = [np.empty((0, 3), np.int64)]
    if depth >= 2:
        a = lengths[lengths * 2 >= total]
        a = a[have[total - a]]
        found.append(np.column_stack((a, total - a, np.zeros_like(a))))
    if depth >= 3:
        for a in lengths[lengths * 3 >= total].tolist():
            b = lengths[(lengths <= a) & (lengths * 2 >= total - a) & (lengths < total - a)]
            b = b[have[total - a - b]]
            found.append(np.column_stack((np.full_like(b, a), b, total - a - b)))
    out = np.concatenate(found)
    return out[(out[:, 1] > 0)]


def non_negative_least_squares(parts: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 of the combinations that come nearest to the histogram (accelerated projected gradient)."""
    n, size = len(target), len(parts)
    flat = parts.ravel()

    def histogram(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, parts.shape[1]), n)
        out[0] = 0
        return out

    def gradient(r: np.ndarray) -> np.ndarray:
        return r[parts].sum(axis=1)

    v = np.ones(size)
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = gradient(histogram(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(size)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - gradient(histogram(y) - target) / (1.05 * bound))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan_packing(histogram: np.ndarray, total: int, depth: int = 3, solves: int = 4) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """Repeats and lengths of patterns that fill sequences exactly, and the histogram of what is left.

    ``histogram[n]`` is the number of pieces of length n, below ``total``.  What rounding
    and scarce lengths leave is solved again, up to ``solves`` times.
    """
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(solves):
        parts = combinations(np.flatnonzero(left), total, depth)
        if not len(parts):
            break
        x = np.rint(non_negative_least_squares(parts, left.astype(float))).astype(np.int64)
        gained = 0
        for i in np.argsort(-x, kind="stable")[: int((x > 0).sum())].tolist():
            lengths = tuple(n for n in parts[i].tolist() if n)
            use = Counter(lengths)
            repeats = min(int(x[i]), *(int(left[n]) // k for n, k in use.items()))
            if repeats > 0:
                for n, k in use.items():
                    left[n] -= repeats * k
                plan.append((repeats, lengths))
                gained += repeats
        if not gained:
            break
    return plan, left


class Slots:
    """For each length the places its pieces go to, in the order of their numbers.

    Patterns come first.  The residue is packed greedily, longest pieces first, end to end:
    a piece that does not fit is cut where its sequence is full.
    """

    def __init__(self, plan: list[tuple[int, tuple[int, ...]]], left: np.ndarray, total: int) -> None:
        held: list[list[tuple[int, int, int]]] = [[] for _ in range(total)]
        count, self.strip, self.total = [0] * total, 0, total
        for repeats, lengths in plan:
            offset = 0
            for n in lengths:
                held[n].append((count[n], self.strip, offset))
                count[n] += repeats
                offset += n
            self.strip += repeats
        self.at = [np.array(x, np.int64).reshape(-1, 3) for x in held]
        #: For each length the number of its first piece of the residue, and the tokens of the residue before it.
        self.first = np.array(count)
        tokens = left * np.arange(total)
        self.before = tokens.sum() - np.cumsum(tokens)

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, and how much of it fits there."""
        at = self.before[lengths] + (numbers - self.first[lengths]) * lengths
        sequence, offset = self.strip + at // self.total, at % self.total
        planned = np.flatnonzero(numbers < self.first[lengths])
        order = planned[np.argsort(lengths[planned], kind="stable")]
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, e in zip(edges, np.append(edges, len(order))[1:], strict=True):
            own = order[a:e]
            table = self.at[int(lengths[own[0]])]
            place = np.searchsorted(table[:, 0], numbers[own], side="right") - 1
            sequence[own] = table[place, 1] + numbers[own] - table[place, 0]
            offset[own] = table[place, 2]
        return sequence, offset, np.minimum(lengths, self.total - offset)


class Encoder:
    """Token ids by the tokenizer file; its rank file, if given, makes the same ids faster."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@cache
def encoder_for(tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    """One for each worker process."""
    return Encoder(tokenizer_path, ranks_path, pattern)


def cut_pieces(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    total: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """Pieces with ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``ids_crc32``, ``doc_tokens``.

    ``part`` and ``number`` count the pieces of a length in their task.
    """
    base = pick(docs, carry, text_col)
    schema = with_fields(base, carry, "start long, length long, ids binary, ids_crc32 long, doc_tokens long, part long, number long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_for(tokenizer_path, ranks_path, pattern), TaskContext.get().partitionId()
        seen = [0] * (total + 1)
        end = np.array([end_id], "<u4")
        for batch in sliced(batches, "_text"):
            rows, owner = [], []
            for at, text in enumerate(batch.column("_text").to_pylist()):
                ids = np.concatenate((encoder.ids(text or "").astype("<u4"), end))
                for start in range(0, len(ids), total):
                    raw = ids[start : start + total].tobytes()
                    n = len(raw) // 4
                    owner.append(at)
                    rows.append((start, n, raw, zlib.crc32(raw), len(ids), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["start", "length", "ids", "ids_crc32", "doc_tokens", "part", "number"]
            kept = batch.select(batch.schema.names[:-1]).take(pa.array(owner, pa.int64()))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *names])

    return base.mapInArrow(lean(scan), schema)


def pack(
    docs: DataFrame,
    workspace: Workspace,
    *,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    total: int = 1024,
    depth: int = 3,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of all documents, each with the sequence and the offset it is packed at.

    Returns the columns ``carry`` of ``docs``, then ``start`` (ids of its document before it), ``length``,
    ``ids`` (binary, little-endian unsigned 32-bit), ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.  A
    sequence's offsets run from 0 without a gap to ``total``; one sequence may hold less.  A null or empty text is the end
    id alone.  Repeated rows are packed as often as they come.  No rows make no pieces.
    """
    pieces = cut_pieces(
        docs, tokenizer_path=tokenizer_path, ranks_path=ranks_path, pattern=pattern, text_col=text_col, carry=carry, total=total, end_id=end_id
    )
    workspace = workspace.scope()
    pieces = workspace.write(pieces, "pieces")
    short = pieces.where(F.col("length") < total)
    parts = short.groupBy("part", "length").agg((F.max("number") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = workspace.write(parts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "parts")
    histogram = np.zeros(total, np.int64)
    for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most as many rows as a sequence has tokens
        histogram[row["length"]] = row["n"]
    slots = docs.sparkSession.sparkContext.broadcast(Slots(*plan_packing(histogram, total, depth), total))

    @F.pandas_udf("struct<sequence_id:long,offset:long,fits:long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset, fits = slots.value.find(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset, "fits": fits})

    names = [*carry, "start", "length", "ids", "ids_crc32", "doc_tokens"]
    full = pieces.where(F.col("length") == total).select(
        *names, (FULL_BASE * (F.col("part") + 1) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    placed = short.join(parts.select("part", "length", "earlier"), ["part", "length"])
    placed = placed.withColumn("_slot", place("length", F.col("number") + F.col("earlier"))).select(*names, "_slot.*")
    whole = "named_struct('skip', 0L, 'size', fits, 'sequence_id', sequence_id, 'offset', offset)"
    rest = "named_struct('skip', fits, 'size', length - fits, 'sequence_id', sequence_id + 1, 'offset', 0L)"
    halves = placed.withColumn("_h", F.explode(F.expr(f"if(fits < length, array({whole}, {rest}), array({whole}))")))
    uncut = F.col("_h.size") == F.col("length")
    halves = halves.withColumn(
        "_ids", F.when(uncut, F.col("ids")).otherwise(F.expr("substring(ids, cast(4 * _h.skip + 1 AS int), cast(4 * _h.size AS int))"))
    ).select(
        *carry,
        (F.col("start") + F.col("_h.skip")).alias("start"),
        F.col("_h.size").alias("length"),
        F.col("_ids").alias("ids"),
        F.when(uncut, F.col("ids_crc32")).otherwise(F.crc32("_ids")).alias("ids_crc32"),
        "doc_tokens",
        "_h.sequence_id",
        "_h.offset",
    )
    return full.unionByName(halves)
