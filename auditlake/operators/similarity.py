"""Exact and near duplicates of code and text, look-alike names, and vector patterns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_code(body: Column) -> Column:
    """Comments out, strings and numbers to one form, white space squeezed."""
    out = F.regexp_replace(body, r"/\*[\s\S]*?\*/", " ")
    out = F.regexp_replace(out, r"//[^\n]*", " ")
    out = F.regexp_replace(out, r"([\"'`])(?:\\.|(?!\1)[^\\])*\1", "\"S\"")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"\b\d+(\.\d+)?\b", "0"))


def exact_groups(frame: DataFrame, text: str, members: str, *, least: int = 2) -> DataFrame:
    """Groups of ``least`` or more rows with one text: ``digest``, ``n``, ``first``.

    Groups are counted with a partial aggregation: a text that a third of the rows share is a
    few numbers from each task.
    """
    digest = F.sha2(F.col(text), 256).alias("digest")
    return frame.groupBy(digest).agg(F.count("*").alias("n"), F.min(members).alias("first")).where(F.col("n") >= least)


_SLOTS = 20
_MOST_SHARED = 5
_GRAMS_A_PART = 12_000_000


class _Rare:
    """The rarest grams of a text, so many that texts within the distance cannot but share some.

    A text of ``n`` characters may take ``edits(n)`` edits.  An edit spoils one of several disjoint grams at most.  So of grams
    that hold ``edits(n) + c`` disjoint ones, ``c`` at least are found in any such other text, no further away than there are edits.
    All texts choose by one order, rarest first: the one that stops earlier has its remaining grams among the
    other's choice too.  Any order loses nothing; the counts only make chance meetings few.
    """

    def __init__(self, ratio: float, least: int) -> None:
        self.ratio, least = ratio, max(1, least)
        fits = [n // (self.edits(n) + 1) for n in range(least, least + math.ceil(1 / (1 - ratio)) + 1)]
        self.size = -(-3 * min(fits) // 4)  # 0: so many edits may spoil all grams
        self.counts = np.zeros(1 << _SLOTS, np.int64)

    def edits(self, n: int) -> int:
        return int((1 - self.ratio) * n / self.ratio + 1e-9)

    def shared(self, n: int) -> int:
        """How many grams texts of ``n`` characters share at least."""
        return max(1, min(_MOST_SHARED, n // self.size - self.edits(n))) if self.size else 1

    def grams(self, text: str) -> np.ndarray:
        """A hash of each run of ``size`` characters."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes) - self.size + 1 if self.size else 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(self.size if n > 0 else 0):
            out = (out ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out

    @staticmethod
    def slots(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _disjoint(self, places: np.ndarray) -> int:
        n, end = 0, -1
        for at in places.tolist():
            if at >= end:
                n, end = n + 1, at + self.size
        return n

    def choose(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the grams chosen."""
        grams, n = self.grams(text), len(text)
        order = np.lexsort((grams, self.counts[self.slots(grams)]))
        want = self.edits(n) + self.shared(n)
        low, high = min(want, len(order)), len(order)
        while low < high:
            mid = (low + high) // 2
            if self._disjoint(np.sort(order[:mid])) >= want:
                high = mid
            else:
                low = mid + 1
        while 0 < low < len(order) and grams[order[low]] == grams[order[low - 1]]:
            low += 1  # all places of the last one
        return grams[order[:low]], order[:low]


def _count_grams(texts: DataFrame, rare: _Rare) -> int:
    """Count the grams of column ``t`` by slot of their hash into ``rare``; all in all so many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SLOTS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(rare.slots(np.concatenate([rare.grams(t) for t in batch.column(0).to_pylist()])), minlength=len(total))
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(total[own])], ["slot", "n"])

    rows = texts.select("t").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << _SLOTS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    rare.counts = counts
    return int(counts.sum())


def _choices(texts: DataFrame, rare: _Rare, bits: int) -> DataFrame:
    """The chosen grams of slices of texts (``id``, ``s``, ``t``) as a row of packed numbers for each part of all hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1 << 14):
                batch = whole.slice(at, 1 << 14)
                found = [rare.choose(t) for t in batch.column("t").to_pylist()]
                sizes = [len(g) for g, _ in found]
                if not sum(sizes):
                    continue
                ids, sides = (batch.column(c).to_numpy().view(np.uint64) for c in ("id", "s"))
                lengths = np.array([len(t) for t in batch.column("t").to_pylist()], np.uint32)
                who = np.repeat(np.arange(len(batch)), sizes)
                grams = (np.concatenate([g for g, _ in found]) ^ sides[who]) * np.uint64(0xC4CEB9FE1A85EC53)
                places = np.minimum(np.concatenate([p for _, p in found]), 0xFFFF).astype(np.uint16)  # never further apart than they are
                part = (grams >> np.uint64(64 - bits)).astype(np.int64)
                order = np.lexsort((who, part))
                part, who, places = part[order], who[order], places[order]
                short = (grams[order] >> np.uint64(32 - bits)).astype(np.uint32)
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                out: list[list] = [[], [], [], [], [], []]
                for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    here, rank = np.unique(who[a:e], return_inverse=True)
                    row = (short[a:e], places[a:e], rank.astype(np.uint16), ids[here], lengths[here])
                    for column, value in zip(out, (int(part[a]), *(x.tobytes() for x in row)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["part", "grams", "places", "who", "ids", "lengths"])

    return texts.mapInArrow(scan, "part int, grams binary, places binary, who binary, ids binary, lengths binary")


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b, n, need = a[order], b[order], n[order], need[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n, need[first]


def _meetings(choices: DataFrame, rare: _Rare) -> DataFrame:
    """Pairs of ids ``a``, ``b`` with the grams ``n`` that they share in one part, and the number ``need`` of all parts."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        gram, place, who = (np.frombuffer(b"".join(frame[c]), t) for c, t in (("grams", np.uint32), ("places", np.uint16), ("who", np.uint16)))
        ids, lengths = (np.frombuffer(b"".join(frame[c]), t) for c, t in (("ids", np.int64), ("lengths", np.uint32)))
        before = np.cumsum([0, *(len(x) // 8 for x in frame["ids"])])[:-1]
        who = who + np.repeat(before, [len(x) // 2 for x in frame["who"]])
        order = np.lexsort((lengths[who], gram))
        gram = gram[order]
        same = np.append(gram[1:] == gram[:-1], False)
        again = same | np.append(False, same[:-1])
        gram, who, place = gram[again], who[order][again], place[order][again].astype(np.int64)
        size = lengths[who].astype(np.int64)
        need = np.array([rare.shared(int(x)) for x in np.arange(int(size.max(initial=0)) + 1)], np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        held, near, step = 0, np.arange(len(gram)), 0
        while len(near):  # each with the next, the next but one, ... of its gram, in order of length
            step += 1
            near = near[near + step < len(gram)]
            near = near[gram[near] == gram[near + step]]
            near = near[size[near] >= rare.ratio * size[near + step] - 1e-6]
            i, j = near, near + step
            close = (np.abs(place[i] - place[j]) <= (1 - rare.ratio) * size[j] + 1e-6) & (ids[who[i]] != ids[who[j]])
            i, j = i[close], j[close]
            x, y = ids[who[i]], ids[who[j]]
            done.append((np.minimum(x, y), np.maximum(x, y), np.ones(len(i), np.int64), np.minimum(need[size[i]], need[size[j]])))
            held += len(i)
            if held > 4_000_000:
                done = [_summed(*(np.concatenate(c) for c in zip(*done, strict=True)))]
                held = len(done[0][0]) // 2  # at least as many again until the next time
        out = _summed(*(np.concatenate(c) for c in zip(*done, strict=True))) if done else [np.empty(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("a", "b", "n", "need"), out, strict=True)))

    return choices.groupBy("part").applyInPandas(meet, "a long, b long, n long, need long")


def near_pairs(frame: DataFrame, key: str, text: str, *, ratio: float = 0.92, least: int = 65, most: int | None = None, block: Sequence[str] = ()) -> DataFrame:
    """Pairs (``a`` before ``b``) of different texts with similarity over ``ratio``: 1 less distance by the longer length.

    Copies of a text are one, named by their least key.  Texts meet on several of their rarest grams at about the same
    places (see ``_Rare``); no pair is lost.  Only packed hashes and places of these are shuffled, then
    the texts of pairs that met often enough.  A first job, run at once, counts grams.
    """
    size = F.length(text)
    base = frame.where(size >= least)
    if most:
        base = base.where(size <= most)
    rare = _Rare(ratio, least)
    grams = _count_grams(base.select(F.col(text).alias("t")), rare)
    bits = max(4, (grams // _GRAMS_A_PART).bit_length())
    base = base.groupBy(*block, F.col(text).alias("t")).agg(F.min(key).alias("k"))
    base = base.withColumn("id", F.xxhash64(*block, "t"))
    side = F.xxhash64(*block) if block else F.lit(0).cast("long")
    met = _meetings(_choices(base.select("id", side.alias("s"), "t"), rare, bits), rare)
    met = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select(F.col("a").alias("id"), F.col("b").alias("id2"))
    met = met.join(base, "id").join(base.select(*block, F.col("id").alias("id2"), F.col("k").alias("k2"), F.col("t").alias("t2")), [*block, "id2"])
    met = met.withColumn("n2", F.greatest(F.length("t"), F.length("t2")))
    far = F.expr(f"levenshtein(t, t2, cast(floor({1 - ratio}D * n2) AS int))")
    met = met.withColumn("d", far).where("d >= 0 AND k <> k2").withColumn("similarity", 1 - F.col("d") / F.col("n2"))
    return met.where(F.col("similarity") > ratio).select(*block, F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), F.col("d").cast("long").alias("distance"), "similarity")


def clone_windows(files: DataFrame, keys: Sequence[str], lines: Column, size: int, *, useful: Column | None = None, least_chars: int = 0) -> DataFrame:
    """Each file's windows of ``size`` lines as ``h`` (md5) and ``start`` (from 1), made in the row, without a shuffle."""
    frame = files.select(*keys, lines.alias("_l"))
    if useful is not None:
        frame = frame.where(useful)
    chunks = F.transform(F.sequence(F.lit(1), F.size("_l") - (size - 1)), lambda i: F.struct(i.alias("start"), F.array_join(F.slice("_l", i, size), "\n").alias("chunk")))
    frame = frame.where(F.size("_l") >= size).select(*keys, F.explode(chunks).alias("w"))
    return frame.where(F.length("w.chunk") >= least_chars).select(*keys, F.col("w.start").cast("long").alias("start"), F.md5("w.chunk").alias("h"))


def clone_groups(windows: DataFrame, path: str, *, least_files: int = 2) -> DataFrame:
    """Window contents found in several files, with the number of files and the earliest place of all."""
    firsts = windows.groupBy("h", path).agg(F.min("start").alias("start"))
    return firsts.groupBy("h").agg(F.count("*").alias("n_files"), F.min(F.struct(F.col(path), "start")).alias("_f")).where(F.col("n_files") >= least_files).select(
        "h", "n_files", F.col(f"_f.{path}").alias("first_file"), F.col("_f.start").alias("first_start")
    )


def greedy_cover(groups: pd.DataFrame, size: int) -> pd.DataFrame:
    """Groups in order of files (most first), start and hash, less those whose place is half covered already.

    For ``applyInPandas`` on the clone groups of one repository: each choice changes what is covered.
    """
    taken: dict = {}
    keep = []
    for row in groups.sort_values(["n_files", "first_start", "h"], ascending=[False, True, True]).itertuples(index=False):
        own = taken.setdefault(row.first_file, set())
        span = range(row.first_start, row.first_start + size)
        free = sum(x not in own for x in span)
        keep.append(free * 2 > size)
        if keep[-1]:
            own.update(span)
    ordered = groups.sort_values(["n_files", "first_start", "h"], ascending=[False, True, True])
    return ordered[pd.Series(keep, index=ordered.index)]


def look_alikes(names: DataFrame, column: str, known: Sequence[str], *, most: int = 2, least_length: int = 4) -> DataFrame:
    """Names at distance 1 to ``most`` of a known one; the first known name in its order wins.

    The known names are a literal of the plan, so each name is judged in its row.
    """
    close = F.array_compact(
        F.array(*[F.when((F.levenshtein(F.col(column), F.lit(k), most) >= 1), F.struct(F.lit(k).alias("known"), F.levenshtein(F.col(column), F.lit(k), most).cast("long").alias("distance"))) for k in known])
    )
    out = names.where(~F.col(column).isin(*known) & (F.length(column) >= least_length)).withColumn("_c", F.get(close, F.lit(0)))
    return out.where("_c IS NOT NULL").select(*names.columns, "_c.known", "_c.distance")
