"""Benchmark decontamination by winnowing.

A match is a run of ``window`` words that a document shares with a benchmark
item.  Both sides keep the least k-gram hash of every sliding window of
``window - gram + 1`` k-grams.  As the choice depends on the window's content
alone, every shared run of ``window`` words leaves a shared fingerprint.
Document fingerprints are joined with the item fingerprints, and each hit is
extended to the runs around it, which are compared word by word.

A benchmark of up to ``index_bytes`` is one index that is broadcast, and the documents are streamed
past it in a narrow map: nothing of the corpus is shuffled.  A larger one stays a table of windows: documents send
the windows around fingerprints that a Bloom filter of bounded size knows, and these are joined with
the benchmark's by hash and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, carried, covered, gram_hashes, lean, pick, runs, sliced, texts_of, winnow, with_fields, word_codes

# Lower-cases A-Z; every other ASCII character but digits and a-z separates words.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def match_words(text: bytes) -> list[bytes]:
    """Words of digits, letters and all non-ASCII characters; A-Z are lower-cased."""
    return text.translate(_TABLE).split()


class BenchmarkIndex:
    """Fingerprints and exact windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        self.names: list[str | None] = []
        self.exact: dict[bytes, list[int]] = {}
        found: dict[int, list[np.ndarray]] = {}
        for name, text in items:
            words = match_words(text)
            if not words:
                continue
            at, n = len(self.names), len(words)
            self.names.append(name)
            size = min(n, window)
            for i in range(n - size + 1):
                own = self.exact.setdefault(b" ".join(words[i : i + size]), [])
                if not own or own[-1] != at:
                    own.append(at)
            # An item shorter than a window is one window: its only fingerprint is its own hash.
            hashes = gram_hashes(word_codes(words), gram if size == window else size)
            if size == window:
                hashes = hashes[np.unique(winnow(hashes, window - gram + 1))]
            found.setdefault(size, []).append(hashes)
        self.prints = {size: np.unique(np.concatenate(x)) for size, x in found.items()}
        self.filters = {}
        for size, x in self.prints.items():
            self.filters[size] = np.zeros(1 << 20, bool)
            self.filters[size][x >> np.uint64(44)] = True

    def _known(self, size: int, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.filters[size][hashes >> np.uint64(44)])
        x = self.prints[size]
        place = np.minimum(np.searchsorted(x, hashes[at]), len(x) - 1)
        return at[x[place] == hashes[at]]

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items that occur."""
        n, items = len(words), set()
        hit = np.zeros(n, bool)
        codes = word_codes(words)
        for size in self.prints:
            if n < size:
                continue
            if size == self.window:
                hashes = gram_hashes(codes, self.gram)
                chosen = np.unique(winnow(hashes, size - self.gram + 1))
                places = chosen[self._known(size, hashes[chosen])]
                reach = size - self.gram  # a hit may stand anywhere in its window
                near = covered(np.maximum(places - reach, 0), reach + 1, n)
                starts = np.flatnonzero(near[: n - size + 1])
            else:
                starts = self._known(size, gram_hashes(codes, size))
            true = []
            for s in starts.tolist():
                own = self.exact.get(b" ".join(words[s : s + size]))
                if own:
                    true.append(s)
                    items.update(own)
            if true:
                hit |= covered(np.array(true), size, n)
        return hit, items


_SPANS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _windows(words: list[bytes], window: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of an item: its window's size, and each window's start, hash and fingerprint."""
    size = min(len(words), window)
    if size:
        codes = word_codes(words)
        own = gram_hashes(codes, size)
        if size == window:
            hashes = gram_hashes(codes, gram)
            yield size, np.arange(len(own)), own, hashes[winnow(hashes, window - gram + 1)]
        else:
            yield size, np.arange(len(own)), own, own


def _joined(keyed: DataFrame, items: DataFrame, window: int, gram: int, bloom_bits: int, salts: int) -> DataFrame:
    """``_k1``, ``_k2`` of texts that share windows with items, with ``found`` (start and end words) and ``names``."""
    context = keyed.sparkSession.sparkContext

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            rows = []
            for name, text in zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), strict=True):
                words = match_words(text)
                for size, at, own, prints in _windows(words, window, gram):
                    rows += [(name, size, h, p, b" ".join(words[i : i + size])) for i, h, p in zip(at.tolist(), own.view(np.int64).tolist(), prints.view(np.int64).tolist(), strict=True)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["id", "size", "own", "print", "words"])

    known = items.mapInArrow(lean(of_items), "id string, size int, own long, print long, words binary").distinct()
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most `window` of them
    prints = known.select("print").distinct()
    shared = context.broadcast(Bloom.build(prints, "print", prints.count(), bloom_bits))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", 2 << 20):
            rows = []
            for k1, k2, text in zip(batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), texts_of(batch.column("_text")), strict=True):
                words = match_words(text)
                codes = word_codes(words)
                for size in sizes:
                    if len(words) < size:
                        continue
                    own = gram_hashes(codes, size)
                    if size == window:
                        hashes = gram_hashes(codes, gram)
                        near = shared.value.has(hashes[winnow(hashes, window - gram + 1)])
                    else:
                        near = shared.value.has(own)
                    rows += [(k1, k2, i, size, h, b" ".join(words[i : i + size])) for i, h in zip(np.flatnonzero(near).tolist(), own[near].view(np.int64).tolist(), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["_k1", "_k2", "start", "size", "own", "words"])

    seen = keyed.mapInArrow(lean(of_texts), "_k1 long, _k2 long, start int, size int, own long, words binary").distinct()
    # A window that many texts share is dealt over several tasks.
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("_k1"), F.lit(salts)).cast("int"))
    known = known.select("id", "size", "own", "words").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = seen.join(known, ["own", "size", "words", "salt"])
    return hits.groupBy("_k1", "_k2").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("found"), F.sort_array(F.collect_set("id")).alias("names")
    )


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    window: int = 10,
    gram: int = 5,
    index_bytes: int = 8 << 20,
    bloom_bits: int = 1 << 28,
    salts: int = 16,
) -> DataFrame:
    """Find what documents share with benchmark items.

    Returns the columns ``carry`` of ``docs``, then ``n_words`` (long), ``spans``
    (array of start and end word, end exclusive, disjoint and in order) and ``items``
    (sorted distinct ids, as text, of the items with a window in the document).

    A null or wordless text has no words, spans or items.  A null item text is no
    window; an item with a null id marks words but is not listed.  Repeated items
    count once.  An empty benchmark marks nothing.  Only the named columns are read, so
    further columns of either table cannot clash.  ``index_bytes`` bounds what is collected and
    broadcast; results are the same on either side of it.
    """
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("text")
    ).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    base = pick(docs, carry, text_col, once=True)
    schema = with_fields(base, carry, _SPANS)
    index = None
    if total <= index_bytes:
        held = [(r["id"], r["text"].encode()) for r in items.collect()]
        index = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(held, window, gram))
    else:
        keys = {"_k1": F.xxhash64("_text"), "_k2": F.xxhash64(F.lit("second"), "_text")}
        keyed = base.select("_text").withColumns(keys).where("_text IS NOT NULL")
        found = _joined(keyed, items, window, gram, bloom_bits, salts)
        own = [F.col(f"`{c}`") for c in base.columns]
        base = base.withColumns(keys).join(found, ["_k1", "_k2"], "left").select(*own, F.col("found").alias("_found"), F.col("names").alias("_names"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", 2 << 20):
            n_words, spans, names = [], [], []
            texts = texts_of(batch.column("_text"))
            joined = zip(*(batch.column(c).to_pylist() for c in ("_found", "_names")), strict=True) if index is None else None
            for text in texts:
                words = match_words(text)
                if joined is None:
                    hit, items = index.value.match(words)
                    own = {index.value.names[i] for i in items} - {None}
                else:
                    found, own = next(joined)
                    hit = np.zeros(len(words), bool)
                    for s in found or ():
                        hit[s["start"] : s["end"]] = True
                n_words.append(len(words))
                spans.append([{"start": a, "end": e} for a, e in zip(*(x.tolist() for x in runs(hit)), strict=True)])
                names.append(sorted(own or ()))
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
            columns = [pa.array(x, k) for x, k in zip((n_words, spans, names), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*carried(batch, carry), *columns], [*carry, "n_words", "spans", "items"])

    return base.mapInArrow(lean(scan), schema)
