"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has a bit set where over half of the text's shingle hashes have it.
Texts are linked whose fingerprints differ in at most ``max_distance`` (3) bits.

1. Fingerprints are made where the text is read; from then on rows are a few numbers.
   Equal fingerprints become one.
2. *Dealing.*  Two fingerprints that differ in 3 bits agree in one of four 16-bit blocks.
   Each is dealt once by each block, rotated so that the block leads.  Groups
   of over ``group_rows`` rows are dealt again by a quarter of the bits that are left, and so on:
   this bounds a group at any size of input, and loses no pair.
3. *Index.*  In a group the rotated fingerprints stand in the order of their Gray rank,
   so neighbours differ in few bits.  Runs of neighbours become nodes that hold
   the pattern of the bits that all below them share, and a mask of these bits; nodes
   become nodes again.  A pair of nodes differs at least where the patterns do under
   both masks: beyond ``max_distance`` all pairs below are pruned at once.  If even all bits
   that are not shared cannot exceed it, all below are linked at once.
4. A group reports a spanning forest of its links, never all its pairs.
5. Components are found over distinct fingerprints and joined back by fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, pick, sliced, texts_of, with_fields
from .components import connected_components

_FAN = 8
_LEAF = 16
_BLOCK = 1 << 13
_PAIRS = 2_048  # node pairs that are opened at once: 64 times as many below them
_ROWS = 50_000
_LEAST_FILES = 12


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text, as a signed number.

    A-Z are lower-cased; words are what stands between spaces (U+0020, U+0009 to U+000D);
    shingles, repeats included, are joined by one space.  A text of fewer words is
    one shingle; one without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The columns ``carry`` and ``fp``, the fingerprint as a signed number.  A null text is one without words."""
    base = pick(docs, carry, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", 2 << 20):
            fp = pa.array([simhash(t, shingle) for t in texts_of(batch.column("_text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], [*batch.schema.names[:-1], "fp"])

    return base.mapInArrow(lean(scan), with_fields(base, carry, "fp long"))


def gray_rank(x: Column) -> Column:
    """Place of a bit pattern in the binary reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def _rotated(x: Column, fixed: int, by: int) -> Column:
    """The bits below the ``fixed`` leading ones rotated left by ``by``."""
    if not by:
        return x
    rest = 64 - fixed
    low = x if not fixed else x.bitwiseAND(F.lit((1 << rest) - 1))
    moved = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, rest - by))
    if not fixed:
        return moved
    return x.bitwiseAND(F.lit(-(1 << rest))).bitwiseOR(moved.bitwiseAND(F.lit((1 << rest) - 1)))


class _Links:
    """Components of the rows at hand."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order."""

    def __init__(self, codes: np.ndarray) -> None:
        both, any_ = [codes], [codes]
        while len(both[-1]) > _FAN:
            at = np.arange(0, len(both[-1]), _FAN)
            both.append(np.bitwise_and.reduceat(both[-1], at))
            any_.append(np.bitwise_or.reduceat(any_[-1], at))
        self.patterns = both
        self.masks = [~(b ^ a) for b, a in zip(both, any_, strict=True)]

    def link(self, limit: int, links: _Links, base: int) -> None:
        """Link all codes that differ in at most ``limit`` bits."""
        top, fan = len(self.patterns) - 1, np.arange(_FAN)
        i, j = np.triu_indices(len(self.patterns[top]))
        todo = [(top, i, j)]
        while todo:
            level, i, j = todo.pop()
            if len(i) > _PAIRS:
                todo += [(level, i[_PAIRS:], j[_PAIRS:]), (level, i[:_PAIRS], j[:_PAIRS])]
                continue
            p, m = self.patterns[level], self.masks[level]
            shared = m[i] & m[j]
            differ = p[i] ^ p[j]
            near = np.bitwise_count(differ & shared) <= limit
            i, j, shared, differ = i[near], j[near], shared[near], differ[near]
            if not level:
                links.add(base + i, base + j)
                continue
            sure = np.bitwise_count(~shared | differ) <= limit
            if sure.any():
                width, n = _FAN**level, len(self.patterns[0])
                for a, b in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
                    for x in (a, b):
                        own = np.arange(x * width, min(n, (x + 1) * width))
                        links.add(base + own, np.full(len(own), base + a * width))
                i, j = i[~sure], j[~sure]
            n = len(self.patterns[level - 1])
            x = np.broadcast_to((i[:, None] * _FAN + fan)[:, :, None], (len(i), _FAN, _FAN)).ravel()
            y = np.broadcast_to((j[:, None] * _FAN + fan)[:, None, :], (len(i), _FAN, _FAN)).ravel()
            ok = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
            if ok.any():
                todo.append((level - 1, x[ok], y[ok]))


def _link_groups(group: np.ndarray, codes: np.ndarray, limit: int) -> np.ndarray:
    """The first row of each row's component; rows stand in the order of group and Gray rank."""
    n = len(codes)
    links = _Links(n)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(starts, append=n)
    for size in range(2, _LEAF + 1):  # groups that are one leaf, all of a size at once
        at = starts[sizes == size]
        if len(at):
            i, j = np.triu_indices(size, 1)
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            near = np.bitwise_count(codes[i] ^ codes[j]) <= limit
            links.add(i[near], j[near])
    for a, size in zip(starts[sizes > _LEAF].tolist(), sizes[sizes > _LEAF].tolist(), strict=True):
        GrayIndex(codes[a : a + size]).link(limit, links, a)
    return links.label


def near_links(codes: DataFrame, workspace: Workspace, *, max_distance: int = 3, group_rows: int = 16_384) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct fingerprints ``fp`` within ``max_distance`` bits."""
    deals = max_distance + 1
    rows, fixed, turn = codes.select("fp", F.col("fp").alias("r"), F.lit(0).cast("long").alias("g")), 0, 0
    ready = None
    while True:
        width = (64 - fixed) // deals
        dealt = [
            rows.select("fp", _rotated(F.col("r"), fixed, b * width).alias("r"), "g", F.lit(b).alias("b")) for b in range(deals)
        ]
        rows = dealt[0]
        for x in dealt[1:]:
            rows = rows.unionByName(x)
        lead = F.shiftrightunsigned("r", 64 - fixed - width)
        rows = workspace.write(rows.select("fp", "r", F.xxhash64("g", "b", lead).alias("g")), f"dealt-{turn}")
        fixed, turn = fixed + width, turn + 1
        sizes = rows.groupBy("g").count()
        hot = workspace.write(sizes.where(F.col("count") > group_rows).select("g"), f"hot-{turn}")
        done = hot.isEmpty() or (64 - fixed) < 2 * deals
        here = rows if done else rows.join(hot, "g", "left_anti")
        ready = here if ready is None else ready.unionByName(here)
        if done:
            break
        rows = rows.join(hot, "g", "left_semi").select("fp", "r", "g")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(part: pa.Table) -> pa.RecordBatch:
            g, r, fp = (part.column(c).to_numpy() for c in ("g", "r", "fp"))
            first = _link_groups(g, r.view(np.uint64), max_distance)
            own = np.flatnonzero(first != np.arange(len(first)))
            return pa.record_batch([pa.array(fp[own]), pa.array(fp[first[own]])], ["u", "v"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= _ROWS:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
                if cut:
                    yield result(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size -= cut
        if size:
            yield result(pa.Table.from_batches(held))

    grouped = ready.repartition("g").withColumn("rank", gray_rank(F.col("r"))).sortWithinPartitions("g", "rank")
    return grouped.mapInArrow(lean(scan), "u long, v long")


def near_duplicates(
    docs: DataFrame,
    workspace: Workspace,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    carry: tuple[str, ...] = (),
    max_distance: int = 3,
    shingle: int = 3,
    group_rows: int = 16_384,
) -> DataFrame:
    """Each document's id (as ``doc_id``), fingerprint and component.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hexadecimal digits), ``component_id`` and the columns ``carry``.  The component is the
    smallest id among all documents that links lead to, itself included.  One row for each
    input row, repeated rows too.  Null, empty and wordless texts have fingerprint zero and are
    linked like any other.  A row with a null id is linked, but gives no component its
    id; a component without ids has a null one.  Only the named columns are read.
    """
    workspace = workspace.scope()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`") for c in carry])
    prints = workspace.write(fingerprints(rows, carry=("doc_id", *carry), shingle=shingle), "prints")
    workspace.files = max(_LEAST_FILES, prints.count() // _ROWS)  # rows are a few numbers from here on
    codes = workspace.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "codes")
    links = near_links(codes, workspace, max_distance=max_distance, group_rows=group_rows)
    roots = workspace.write(connected_components(links, workspace), "roots")
    placed = codes.join(roots, F.col("fp") == F.col("node"), "left")
    placed = workspace.write(placed.select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    least = workspace.write(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = workspace.write(placed.join(least, "root").select("fp", "component_id"), "named")
    workspace.keep(prints, named)
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *[F.col(f"`{c}`") for c in carry]
    )
