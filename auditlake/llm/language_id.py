"""Language identification with a linear-chain conditional random field.

Every word of a text gets a distribution over languages from the forward-backward algorithm;
a text's language is the one with the largest mean probability.  A word's evidence comes from
its affixes, all its letter trigrams and the word itself (a learned lexicon), hashed to
``1 << bits`` weights for each language.  Combining marks belong to their word.  Runs of over 32 letters, as scripts
without spaces have, are labelled in units of 16.  The weights of languages following each other are learned
from training sequences that switch language as mixed texts do.

Forward-backward runs over whole texts: blocks of words are first reduced to transfer matrices,
all at once; messages then pass from block to block; and within all blocks at once again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sliced, with_fields
from .labelled import fold

_BLOCK = 32
_CACHE = 1 << 19
_UNIT = 16
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Weights that a model has at most, over all languages.
_MOST_WEIGHTS = 1 << 26


def words_of(text: str | None) -> list[str]:
    """Runs of letters with their marks, lower-cased; very long ones in units."""
    found = _WORD.findall(text.lower()) if text else []
    if any(len(w) > 2 * _UNIT for w in found):
        found = [u for w in found for u in ([w] if len(w) <= 2 * _UNIT else [w[i : i + _UNIT] for i in range(0, len(w), _UNIT)])]
    return found


def word_features(word: str, bits: int) -> list[int]:
    """Hashed affixes, letter trigrams and the word itself."""
    marked = f"^{word}$"
    names = [f"p{word[:n]}" for n in range(1, 5)] + [f"s{word[-n:]}" for n in range(1, 5)]
    names += [marked[i : i + 3] for i in range(len(marked) - 2)]
    names.append(f"w{word}")
    mask = (1 << bits) - 1
    return [zlib.crc32(x.encode()) & mask for x in names]


class Features:
    """Features of many words, one after another."""

    def __init__(self, words: list[str], bits: int) -> None:
        own = [word_features(w, bits) for w in words]
        self.sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.starts = np.cumsum(np.concatenate(([0], self.sizes)))[:-1]
        self.flat = np.fromiter((f for x in own for f in x), np.int64, int(self.sizes.sum()))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the words at these numbers, where each word's start, and how many it has."""
        sizes = self.sizes[words]
        starts = np.cumsum(np.concatenate(([0], sizes)))[:-1]
        return self.flat[np.repeat(self.starts[words] - starts, sizes) + np.arange(sizes.sum())], starts, sizes


@dataclass
class Field:
    """Weights of the random field."""

    languages: list[str]
    bits: int
    emit: np.ndarray  # (features, languages)
    move: np.ndarray  # (languages, languages), from and to
    cache: dict = field(default_factory=dict)
    rows: list = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "rows": []}

    def scores(self, words: list[str]) -> np.ndarray:
        """Summed weights of each word."""
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
            self.rows.clear()
        new = [w for w in dict.fromkeys(words) if w not in cache]
        base = sum(map(len, self.rows))
        for i in range(0, len(new), 16_384):
            own = Features(new[i : i + 16_384], self.bits)
            self.rows.append(np.add.reduceat(self.emit[own.flat], own.starts, axis=0))
        cache.update(zip(new, range(base, base + len(new)), strict=True))
        table = self.rows[0] if len(self.rows) == 1 else np.concatenate(self.rows) if self.rows else np.zeros((0, len(self.languages)))
        self.rows[:] = [table]
        return table[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each word's distribution, for texts of the given numbers of words, one after another."""
        n, k = scores.shape
        if not n:
            return scores
        if k > 16:  # a block's transfer matrix would be large
            return self._word_by_word(scores, sizes)
        blocks = -(-sizes // _BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)))[:-1]
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        text = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(n) - starts[text]
        at = (first[text] + within // _BLOCK, within % _BLOCK)
        m = int(blocks.sum())
        held, live = np.ones((_BLOCK, m, k)), np.zeros((_BLOCK, m, 1), bool)
        held[at[1], at[0]] = np.exp(scores - scores.max(axis=1, keepdims=True))
        live[at[1], at[0]] = True
        move = np.exp(self.move - self.move.max())
        through = np.broadcast_to(np.eye(k), (m, k, k)).copy()
        for t in range(_BLOCK):
            new = (through @ move) * held[t][:, None, :]
            new /= new.max(axis=(1, 2), keepdims=True)
            through = np.where(live[t][:, None, :], new, through)
        left, right = np.full((m, k), 1 / k), np.ones((m, k))
        order = np.argsort(-blocks, kind="stable")
        deep = int(blocks.max(initial=0))
        count = np.searchsorted(-blocks[order], -np.arange(deep), side="left")  # texts with more than i blocks
        for i in range(1, deep):
            own = first[order[: count[i]]] + i
            new = np.einsum("bi,bij->bj", left[own - 1], through[own - 1])
            left[own] = new / new.sum(axis=1, keepdims=True)
        for i in range(deep - 1, 0, -1):
            own = first[order[: count[i]]] + i
            new = np.einsum("bij,bj->bi", through[own], right[own])
            right[own - 1] = new / new.sum(axis=1, keepdims=True)
        ahead = np.empty((_BLOCK, m, k))
        for t in range(_BLOCK):
            new = (left @ move) * held[t]
            new /= new.sum(axis=1, keepdims=True)
            left = np.where(live[t], new, left)
            ahead[t] = left
        for t in range(_BLOCK - 1, -1, -1):
            ahead[t] *= right
            new = (held[t] * right) @ move.T
            new /= new.sum(axis=1, keepdims=True)
            right = np.where(live[t], new, right)
        out = ahead[at[1], at[0]]
        return out / out.sum(axis=1, keepdims=True)


    def _word_by_word(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same, one word of all texts after another: for many languages."""
        held = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(self.move - self.move.max())
        starts = np.cumsum(np.concatenate(([0], sizes)))[:-1]
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max())), side="left")  # texts with more than t words
        ahead = held.astype(float)
        for t in range(len(live)):
            at = starts[: live[t]] + t
            ahead[at] *= ahead[at - 1] @ move if t else move.mean(axis=0)
            ahead[at] /= ahead[at].sum(axis=1, keepdims=True)
        back = np.ones(ahead.shape)
        for t in range(len(live) - 1, 0, -1):
            at = starts[: live[t]] + t
            new = (held[at] * back[at]) @ move.T
            back[at - 1] = new / new.sum(axis=1, keepdims=True)
        out = ahead * back
        return out / out.sum(axis=1, keepdims=True)


def train_field(texts: list[tuple[str, list[str]]], languages: list[str], *, bits: int = 18, rounds: int = 4, piece: int = 40, seed: int = 7) -> Field:
    """Maximum likelihood by AdaGrad.  Texts are cut into pieces; sequences join up to three, often of several languages."""
    rng, k = np.random.default_rng(seed), len(languages)
    index = {x: i for i, x in enumerate(languages)}
    model = Field(languages, bits, np.zeros((1 << bits, k), np.float32), np.zeros((k, k)))
    vocabulary: dict[str, int] = {}
    coded = []
    for lang, words in texts:
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        coded += [(numbers[i : i + piece], index[lang]) for i in range(0, len(numbers), piece)]
    features = Features(list(vocabulary), bits)
    square, square_move, rate = np.full((1 << bits, k), 1e-6, np.float32), np.full((k, k), 1e-6), 0.25
    for _ in range(rounds):
        order, at = rng.permutation(len(coded)), 0
        while at < len(order):
            batch, sizes, truth = [], [], []
            while len(sizes) < 128 and at < len(order):
                own = order[at : at + int(rng.integers(1, 4))]
                at += len(own)
                batch += [coded[i][0] for i in own]
                truth += [np.full(len(coded[i][0]), coded[i][1]) for i in own]
                sizes.append(sum(len(coded[i][0]) for i in own))
            gold, sizes = np.concatenate(truth), np.array(sizes)
            flat, starts, counts = features.of(np.concatenate(batch))
            p = model.marginals(np.add.reduceat(model.emit[flat], starts, axis=0), sizes)
            error = p.copy()
            error[np.arange(len(gold)), gold] -= 1
            by = np.argsort(flat, kind="stable")
            edges = np.flatnonzero(np.diff(flat[by], prepend=-1))
            grad = np.add.reduceat(np.repeat(error, counts, axis=0)[by], edges, axis=0) / len(gold)
            seen = flat[by][edges]
            # Expected and true moves; the pair marginals follow from neighbouring ones and the move weights.
            inner = np.ones(len(gold), bool)
            inner[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = False
            b = np.flatnonzero(inner)
            move = np.zeros((k, k))
            for part in np.array_split(b, max(1, len(b) * k * k >> 24)):
                joint = p[part - 1][:, :, None] * np.exp(model.move)[None] * p[part][:, None, :]
                for _ in range(6):  # fit both margins
                    joint *= (p[part - 1] / np.maximum(joint.sum(axis=2), 1e-300))[:, :, None]
                    joint *= (p[part] / np.maximum(joint.sum(axis=1), 1e-300))[:, None, :]
                move += joint.sum(axis=0)
            np.add.at(move, (gold[b - 1], gold[b]), -1)
            move /= len(gold)
            square[seen] += grad * grad
            square_move += move * move
            model.emit[seen] -= rate * grad / np.sqrt(square[seen])
            model.move -= rate * move / np.sqrt(square_move)
    return model


def identify_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    carry: tuple[str, ...] = ("doc_id",),
    parts: int = 3,
    held_out: int = 1,
    per_language: int = 400,
    longest: int = 50_000,
    bits: int = 18,
) -> DataFrame:
    """The language of every whole text and of its parts.

    Returns the columns ``carry`` of ``docs``, then ``lang_pred``, ``score`` (the mean probability of
    that language over all words) and ``segments``: runs of words of one language, as first word,
    end (exclusive) and language.  Words are runs of letters.  A text that is null or has no letter
    is ``und`` with score 0.  Every label is learned, from about ``per_language`` whole texts of each (repeated rows
    once, none of over ``longest`` bytes), of rows whose crc32(id as text) modulo ``parts`` is not
    ``held_out``; id, label and source are no inputs of a prediction.  Rows without an id are predicted and not learned
    from.  With many languages ``bits`` is lowered until the model has 2^26 weights.  Without labels all
    texts are ``und``.  Repeated rows are predicted alike.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    train = named.where("lang IS NOT NULL AND _text IS NOT NULL").where(fold("id", parts) != held_out)
    sizes = train.groupBy("lang").count()
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # the classes
    bits = min(bits, max(8, (_MOST_WEIGHTS // max(1, len(languages))).bit_length() - 1))
    place = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = train.where(F.octet_length("_text") <= longest).join(F.broadcast(sizes), "lang").where(place < per_language / F.col("count"))
    # About per_language texts of bounded length of each language.
    rows = drawn.dropDuplicates(["id", "_text", "lang"]).select("lang", "_text").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["_text"]))
    base = pick(docs, carry, text_col)
    model = train_field([(r["lang"], words_of(r["_text"])) for r in rows], languages, bits=bits) if languages else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = (4 << 20) // max(1, len(languages) // 4)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("until", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", most):
            own = [words_of(t) for t in batch.column("_text").to_pylist()]
            model = shared.value
            sizes = np.array([len(w) for w in own])
            some = np.flatnonzero(sizes) if model else np.empty(0, np.int64)
            names, score = np.full(len(own), "und", object), np.zeros(len(own))
            parts_of = pa.array([[]] * len(own), kind)
            if len(some):
                every = [w for x in own for w in x]
                p = model.marginals(model.scores(every), sizes[some])
                starts = np.concatenate(([0], np.cumsum(sizes[some])))[:-1]
                mean = np.add.reduceat(p, starts, axis=0) / sizes[some][:, None]
                best = mean.argmax(axis=1)
                known = np.array(model.languages, object)
                names[some], score[some] = known[best], np.clip(mean[np.arange(len(best)), best], 0, 1)
                word = p.argmax(axis=1)
                edge = np.append(True, word[1:] != word[:-1])
                edge[starts] = True
                at = np.flatnonzero(edge)
                offset = np.repeat(starts, sizes[some])[at]
                until = np.append(at[1:], len(word)) - offset
                runs = pa.StructArray.from_arrays([pa.array((at - offset).astype(np.int32)), pa.array(until.astype(np.int32)), pa.array(known[word[at]], pa.string())], ["begin", "until", "lang"])
                count = np.zeros(len(own), np.int64)
                count[some] = np.diff(np.searchsorted(at, np.append(starts, len(word))))
                parts_of = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), runs)
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score), parts_of.cast(kind)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", "segments"])

    return base.mapInArrow(label, with_fields(base, carry, "lang_pred string, score double, segments array<struct<begin:int,until:int,lang:string>>"))
