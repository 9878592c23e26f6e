"""Removal of repeated passages with sharded phrase automata.

A window of ``window`` words is *recurring* if its word sequence starts at two
places or more of the corpus.  Every word that a recurring window covers goes.

1. *Anchors.*  Each window has one anchor: its least ``gram``-word hash (winnowing).
   Equal windows have equal anchors, so a recurring window has an anchor that was
   chosen at two places at least.  Anchors are counted over the whole corpus.
2. *Regions.*  All documents are read, and windows whose anchor recurs are candidates.  Runs of
   them are cut out, with their words, and dealt to shards by anchor.  A Bloom filter of at most
   ``bloom_bits`` bits tells candidates apart where the text is read.  It may only let
   through too much: a full filter costs shuffle, never results.
3. *Confirmation.*  Candidate windows are counted by two numbers, made of 128-bit hashes of their words: one
   hash of the whole window, and a *mark* of half another one and half the anchor's; those found twice or more are recurring.
4. *Automata.*  Each shard compiles the anchor phrases of its confirmed windows, as text, into an
   Aho-Corasick automaton and streams all its regions through it.  An occurrence names its phrase,
   and only with that can the windows around it be looked up: the shard's table of confirmed
   windows is kept by phrase.  Shards have a bounded number of phrases; one with many regions (a
   passage that a third of the documents share, or a text with a million copies) is
   dealt row by row over several tasks, each with the same automaton.
5. Spans are gathered by text and joined to the documents.

Texts are known by two 64-bit hashes, so copies of a text share their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Workspace, carried, covered, gram_hashes, lean, mix, pick, runs, sliced, texts_of, winnow, with_fields, word_hashes

#: Words of an anchor phrase.
GRAM = 8
_SLICE = 2 << 20
_TAG = np.uint64((1 << 32) - 1)
_IN_WORD = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])

_SPAN = "k1 long, k2 long, begin int, until int"


def _with_key(df: DataFrame, lead: str = "") -> DataFrame:
    return df.withColumns({f"{lead}k1": F.xxhash64("_text"), f"{lead}k2": F.xxhash64(F.lit("second"), "_text")})


def _anchors(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor place and anchor hash."""
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(codes, gram)
    places = winnow(hashes, window - gram + 1)
    return places, hashes[places]


class Regions:
    """Words of many regions one after another, with an empty place after each region.

    ``line`` is their text: a space before each place, and a line end at each empty one.
    """

    def __init__(self, texts: pa.Array, window: int) -> None:
        held = texts.to_pylist()
        self.line = b" " + b" \n ".join(held) + b" \n"
        self.words = self.line.split(b" ")[1:]
        self.codes = word_hashes(self.words)
        sizes = np.fromiter((x.count(b" ") for x in held), np.int64, len(held)) + 1
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.own = [gram_hashes(c, window) for c in self.codes]
        inside = np.zeros(len(self.words) + 1, np.int32)  # places where a window of the region starts
        inside[self.starts] += 1
        inside[self.starts + sizes - window + 1] -= 1
        self.valid = np.cumsum(inside)[: len(self.own[0])] > 0

    def region_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


class PhraseAutomaton:
    """One shard: an automaton over the phrases of its recurring windows, and these windows by phrase.

    ``own`` has a row for each recurring window: its hash and its mark, whose low half is the tag of its
    phrase.  ``phrases`` are tags with the anchors' words; those without a recurring window are left out.
    """

    def __init__(self, own: np.ndarray, phrases: list[tuple[int, bytes]], window: int) -> None:
        self.window, known = window, set((own[:, 1] & _TAG).tolist())
        self.key, self.mark = own[np.argsort(own[:, 0], kind="stable")].T
        self.automaton, tags, sizes = ahocorasick.Automaton(), [], []
        for tag, words in phrases:
            if tag in known:
                self.automaton.add_word(f" {words.decode('latin-1')} ", len(tags))
                tags.append(tag)
                sizes.append(len(words) + 2)
        self.automaton.make_automaton()
        self.tags, self.sizes = np.array(tags, np.uint64), np.array(sizes, np.int64)

    def locate(self, regions: Regions) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in the regions' array, of what recurring windows cover."""
        n = len(regions.words)
        hits = np.array(list(self.automaton.iter(regions.line.decode("latin-1"))) if self.sizes.size else [], np.int64).reshape(-1, 2)
        spaces = np.flatnonzero(np.frombuffer(regions.line, np.uint8) == 0x20)
        places = np.searchsorted(spaces, hits[:, 0] + 1 - self.sizes[hits[:, 1]])
        at = places[:, None] - np.arange(self.window - GRAM + 1)  # windows around each occurrence
        row, offset = np.nonzero((at >= 0) & (at < len(regions.valid)))
        at = at[row, offset]
        ok = regions.valid[at]
        at, row = at[ok], row[ok]
        key, mark = regions.own[0][at], (regions.own[1][at] & ~_TAG) | self.tags[hits[row, 1]]
        found, place = np.zeros(len(at), bool), np.searchsorted(self.key, key)
        while len(at):  # rows of equal keys follow each other
            here = place < len(self.key)
            here[here] = self.key[place[here]] == key[here]
            if not here.any():
                break
            found[here] |= self.mark[place[here]] == mark[here]
            place = np.where(here, place + 1, len(self.key))
        return runs(covered(np.unique(at[found]), self.window, n))


def find_repeats(
    docs: DataFrame,
    workspace: Workspace,
    *,
    text_col: str = "text",
    window: int = 35,
    bloom_bits: int = 1 << 28,
    phrases_per_shard: int = 8_192,
    regions_per_task: int = 131_072,
) -> DataFrame:
    """Disjoint spans of recurring windows (end exclusive), each once, by text key ``k1``, ``k2``."""
    spark, gram, workspace = docs.sparkSession, GRAM, workspace.scope()
    keyed = _with_key(pick(docs, (), text_col)).where("_text is not null")

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", _SLICE):
            found = []
            for text in texts_of(batch.column("_text")):
                places, hashes = _anchors(word_hashes(text.split())[0], window, gram)
                if len(places):
                    found.append(hashes[np.flatnonzero(np.diff(places, prepend=-1))])
            if found:
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(counts)], ["anchor", "n"])

    anchors = keyed.select("_text").mapInArrow(lean(count_anchors), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    anchors = workspace.write(anchors.where("n > 1").select("anchor"), "anchors")
    n_anchors = anchors.count()
    bloom = spark.sparkContext.broadcast(Bloom.build(anchors, "anchor", n_anchors, bloom_bits))
    shards = min(1 << 31, 1 << (-(-n_anchors // phrases_per_shard) - 1).bit_length()) if n_anchors else 1

    def cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for batch in sliced(batches, "_text", _SLICE):
            rows: list[tuple] = []
            keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)
            for (k1, k2), text in zip(keys, texts_of(batch.column("_text")), strict=True):
                words = text.split()
                _, hashes = _anchors(word_hashes(words)[0], window, gram)
                ok = known.has(hashes)
                if not ok.any():
                    continue
                shard = np.where(ok, (hashes & np.uint64(shards - 1)).astype(np.int64), -1)
                edges = np.flatnonzero(np.diff(shard, prepend=-2))
                ends = np.append(edges[1:], len(shard))
                for a, e, s in zip(edges.tolist(), ends.tolist(), shard[edges].tolist(), strict=True):
                    if s >= 0:
                        rows.append((s, k1, k2, a, b" ".join(words[a : e + window - 1])))
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.record_batch(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["shard", "k1", "k2", "begin", "words"],
                )

    regions = keyed.mapInArrow(lean(cut_regions), "shard int, k1 long, k2 long, begin int, words binary")
    regions = workspace.write(regions, "regions")

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows with their anchors, and the words of each anchor."""
        for batch in sliced(batches, "words", _SLICE // 2):
            found = Regions(batch.column("words"), window)
            places, hashes = _anchors(found.codes[0], window, gram)
            at = np.flatnonzero(found.valid)
            tags = hashes & _TAG
            own, mark = found.own[0][at], (found.own[1][at] & ~_TAG) | tags[at]
            order = np.argsort(own, kind="stable")
            own, mark = own[order], mark[order]
            first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])))
            counts = np.diff(first, append=len(own))
            _, once = np.unique(hashes[at], return_index=True)
            phrases = [b" ".join(found.words[p : p + gram]) for p in places[at[once]].tolist()]
            n, m = len(first), len(phrases)
            none = [pa.nulls(k, t) for k, t in ((m, pa.int64()), (n, pa.binary()))]
            yield pa.record_batch(
                [
                    pa.concat_arrays([pa.array(own[first].view(np.int64)), none[0]]),
                    pa.array(np.concatenate((mark[first], tags[at[once]])).view(np.int64)),
                    pa.concat_arrays([none[1], pa.array(phrases, pa.binary())]),
                    pa.array(np.concatenate((counts, np.zeros(m, np.int64)))),
                ],
                ["own", "mark", "phrase", "n"],
            )

    found = regions.select("words").mapInArrow(lean(evidence), "own long, mark long, phrase binary, n long")
    found = found.groupBy("own", "mark", "phrase").agg(F.sum("n").alias("n")).where("n > 1 OR phrase IS NOT NULL").drop("n")
    found = found.withColumn("shard", F.col("mark").bitwiseAND(F.lit(shards - 1)).cast("int"))

    # As many tasks for a shard as its regions need; a row for each shard, and shards have a least size.
    tasks = regions.groupBy("shard").agg(F.ceil(F.count("*") / regions_per_task).cast("int").alias("tasks"))
    tasks = workspace.write(tasks, "tasks")
    empty = {c: F.lit(None).cast(t) for c, t in (("own", "long"), ("mark", "long"), ("phrase", "binary"), ("k1", "long"), ("k2", "long"), ("begin", "int"), ("words", "binary"))}
    columns = ["shard", "salt", "kind", *empty]
    rules = (
        found.withColumn("kind", F.when(F.col("phrase").isNull(), 0).otherwise(1))
        .join(tasks, "shard")
        .withColumn("salt", F.explode(F.expr("sequence(0, tasks - 1)")))
        .withColumns({c: empty[c] for c in ("k1", "k2", "begin", "words")})
    )
    # Each row is dealt for itself: copies of a text go to all tasks of their shard.
    stream = (
        regions.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
        .join(tasks, "shard")
        .withColumn("salt", F.pmod("salt", "tasks").cast("int"))
        .withColumns({"kind": F.lit(2)} | {c: empty[c] for c in ("own", "mark", "phrase")})
    )
    dealt = rules.select(columns).unionByName(stream.select(columns)).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held, automaton = None, [], [], None
        for whole in batches:
            if not len(whole):
                continue
            keys = [whole.column(c).to_numpy() for c in ("shard", "salt", "kind")]
            change = np.flatnonzero(np.any([np.diff(x, prepend=x[0] - 1) for x in keys], axis=0)).tolist()
            for a, e in zip(change, [*change[1:], len(whole)], strict=True):
                here, kind = (keys[0][a], keys[1][a]), keys[2][a]
                if here != at:
                    at, own, held, automaton = here, [], [], None
                if kind < 2:
                    part = whole.slice(a, e - a)
                    if kind == 0:
                        own.append(np.column_stack([part.column(c).to_numpy().view(np.uint64) for c in ("own", "mark")]))
                    else:
                        held += zip(part.column("mark").to_numpy().tolist(), part.column("phrase").to_pylist(), strict=True)
                elif own and held:
                    if automaton is None:
                        automaton = PhraseAutomaton(np.concatenate(own), held, window)
                    for part in sliced([whole.slice(a, e - a)], "words", _SLICE // 2):
                        yield located(automaton, part)

    def located(automaton: PhraseAutomaton, part: pa.RecordBatch) -> pa.RecordBatch:
        found = Regions(part.column("words"), window)
        begin, until = automaton.locate(found)
        r = found.region_of(begin)
        first = part.column("begin").to_numpy()[r] - found.starts[r]
        keys = [pa.array(part.column(k).to_numpy()[r]) for k in ("k1", "k2")]
        return pa.record_batch([*keys, *(pa.array((first + x).astype(np.int32)) for x in (begin, until))], ["k1", "k2", "begin", "until"])

    spans = workspace.write(dealt.mapInArrow(lean(scan), _SPAN).distinct(), "spans")
    workspace.keep(spans)
    return spans


def remove_repeats(
    docs: DataFrame,
    workspace: Workspace,
    *,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    window: int = 35,
    **options: int,
) -> DataFrame:
    """Take every word under a recurring window out of every text.

    Returns the columns ``carry`` of ``docs``, then ``n_words``, ``n_removed`` (long),
    ``kept`` (the kept words, joined by one space) and ``clean_text``: the text without the
    removed words.  There what stands between kept words is unchanged, and one line
    end takes the place of a removed stretch; a text that loses nothing is unchanged.

    Words are what stands between spaces (U+0020, U+0009 to U+000D).  Windows are judged on
    the input, not on what is left.  Null has no words and stays null in ``clean_text``; texts of under
    ``window`` words lose nothing; repeated rows are repeated texts and lose what is
    long enough in each of them.  Only the named columns are read.
    """
    workspace, steps = workspace.scope(), workspace.scope()
    spans = find_repeats(docs, steps, text_col=text_col, window=window, **options)
    gathered = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("begin", "until"))).alias("spans"))
    gathered = workspace.write(gathered, "gathered")
    steps.close()
    gathered = gathered.withColumnsRenamed({c: f"_{c}" for c in gathered.columns})
    base = pick(docs, carry, text_col, once=True)
    names = [*[F.col(f"`{c}`") for c in base.columns], F.col("_spans")]
    base = _with_key(base, "_")
    # Only texts whose key is in the filter are dealt out by key; a full filter costs shuffle, never results.
    known = docs.sparkSession.sparkContext.broadcast(Bloom.build(gathered, "_k1", gathered.count(), options.get("bloom_bits", 1 << 28)))

    @F.pandas_udf("boolean")
    def listed(k1: pd.Series) -> pd.Series:
        return pd.Series(known.value.has(k1.to_numpy().view(np.uint64)))

    base = base.withColumn("_listed", listed("_k1"))
    cut_ones = base.where("_listed").join(gathered, ["_k1", "_k2"], "left").select(names)
    joined = base.where("NOT _listed").withColumn("_spans", F.lit(None).cast(dict(gathered.dtypes)["_spans"])).select(names).unionByName(cut_ones)
    schema = with_fields(base, carry, "n_words long, n_removed long, kept string, clean_text string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", _SLICE):
            out = []
            for raw, spans in zip(batch.column("_text").cast(pa.large_binary()).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                words = (raw or b"").split()
                if not spans:
                    out.append((len(words), 0, b" ".join(words), raw))
                    continue
                gone = np.zeros(len(words), bool)
                for s in spans:
                    gone[s["begin"] : s["until"]] = True
                first, last = runs(_IN_WORD[np.frombuffer(raw, np.uint8)])
                a, e = runs(~gone)
                pieces = [raw[x:y] for x, y in zip(first[a].tolist(), last[e - 1].tolist(), strict=True)]
                kept = b" ".join(b" ".join(pieces).split())
                out.append((len(words), int(gone.sum()), kept, b"\n".join(pieces)))
            n_words, n_removed, kept, clean = zip(*out, strict=True) if out else ((),) * 4
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            columns += [pa.array(x, pa.binary()).cast(pa.string()) for x in (kept, clean)]
            yield pa.RecordBatch.from_arrays([*carried(batch, carry), *columns], [*carry, "n_words", "n_removed", "kept", "clean_text"])

    return joined.mapInArrow(lean(cut), schema)
