"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``passage_words`` words.  Each passage is encoded: shares of
kinds of characters, word lengths, repetition within the passage and of what stood before it,
and hashed word endings, through a learned layer.  Gated attention, learned with the
layer from document labels alone, weighs the passages; the weighted mean of
their codes gives the score (Ilse, Tomczak and Welling, 2018).

All of a passage's numbers come from array operations over the bytes of many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix, pick, sliced, texts_of, with_fields
from .labelled import class_weights, labelled_sample, sigmoid

_ENDINGS = 32
_KINDS = 9


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SPACE = _table(b" \t\n\x0b\x0c\r")
_CLASSES = [
    _table(bytes(range(65, 91))),
    _table(b"0123456789"),
    _table(b"#*$%&<>"),
    _table(b"|"),
    _table(b"!?"),
    _table(b".,;:"),
    _table(b"@/\\_=+()[]{}\"'~^`-"),
    np.arange(256) >= 0x80,
]
N_FEATURES = _KINDS + 7 + _ENDINGS


def passages(texts: list[bytes], passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of all texts, in order, and how many passages each text has (at least one)."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_end = np.cumsum(sizes)
    inside = ~_SPACE[joined]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(text_end, first, side="right")
    words = np.bincount(owner, minlength=len(texts))
    count = np.maximum(1, -(-words // passage_words))
    base = np.concatenate(([0], np.cumsum(count)))[:-1]
    total = int(count.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(first):
        return out, count
    within = np.arange(len(first)) - np.concatenate(([0], np.cumsum(words)))[:-1][owner]
    bag = base[owner] + within // passage_words
    n = np.bincount(bag, minlength=total).astype(float)
    some = np.maximum(n, 1)
    length = (last - first).astype(float)
    chars = np.bincount(bag, length, total)
    for i, kind in enumerate(_CLASSES):
        seen = np.concatenate(([0], np.cumsum(kind[joined])))
        out[:, i] = np.bincount(bag, seen[last] - seen[first], total) / np.maximum(chars, 1)
    line = np.concatenate(([0], np.cumsum(joined == 10)))
    gap = np.concatenate((line[first][1:] - line[last][:-1], [0]))  # line ends after each word
    out[:, 8] = np.bincount(bag, np.minimum(gap, 3), total) / some
    out[:, 9] = chars / some / 10
    out[:, 10] = np.sqrt(np.maximum(np.bincount(bag, length**2, total) / some - (chars / some) ** 2, 0)) / 10
    out[:, 11] = np.bincount(bag, length <= 3, total) / some
    # A word is known here by its length, its first and its last bytes.
    code = (length.astype(np.uint64) << np.uint64(48)) ^ _bytes_at(joined, first, 5) ^ (_bytes_at(joined, np.maximum(last - 4, first), 4) << np.uint64(20))
    code = mix(code)
    out[:, 12] = np.bincount(bag, _repeated(bag, code), total) / some
    three = code.copy()
    three[:-2] = mix(code[:-2] * np.uint64(3) + code[1:-1] * np.uint64(5) + code[2:] * np.uint64(7))
    out[:, 13] = np.bincount(bag, _repeated(owner, three), total) / some  # three words that stood before in the text
    out[:, 14] = n / passage_words
    out[:, 15] = np.log1p(words)[np.repeat(np.arange(len(texts)), count)] / 10
    ending = mix(_bytes_at(joined, np.maximum(last - 2, first), 2)) % np.uint64(_ENDINGS)
    out[:, _KINDS + 7 :] = np.bincount(bag * _ENDINGS + ending.astype(np.int64), minlength=total * _ENDINGS).reshape(total, _ENDINGS) / some[:, None]
    return out, count


def _bytes_at(joined: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | joined[np.minimum(at + i, len(joined) - 1)].astype(np.uint64)
    return out


def _repeated(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which codes stood before in their group; groups come in order."""
    key = mix(code ^ mix(group.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


@dataclass
class AttentionModel:
    """Encoder, gated attention and output weights."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Score of each bag of passages ``x``, and each passage's attention."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["encode"] + p["encode0"])
        v, u = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        logit = (v * u) @ p["a"]
        starts = np.concatenate(([0], np.cumsum(count)))[:-1]
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), count))
        a = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(h * a[:, None], starts)
        return sigmoid(z @ p["out"] + p["out0"][0]), a, x, h, v, u, z

    @staticmethod
    def train(x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray, *, width: int = 24, rounds: int = 40, seed: int = 5) -> AttentionModel:
        """Adam on the cross entropy of document labels."""
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        draw = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        p = {"encode": draw(d, width), "encode0": np.zeros(width), "v": draw(width, width), "u": draw(width, width), "a": draw(width) / 4, "out": draw(width), "out0": np.zeros(1)}
        model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-3, p)
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        starts = np.concatenate(([0], np.cumsum(count)))
        step = 0
        for turn in range(rounds):
            for bags in np.array_split(rng.permutation(len(count)), max(1, len(count) // 64)):
                rows = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in bags])
                n = count[bags]
                s, a, xs, h, v, u, z = model.forward(x[rows], n)
                ds = (s - y[bags]) * weight[bags] / len(bags)
                bag = np.repeat(np.arange(len(bags)), n)
                dz = ds[:, None] * p["out"]
                da = (h * dz[bag]).sum(axis=1)
                dl = a * (da - np.add.reduceat(a * da, np.concatenate(([0], np.cumsum(n)))[:-1])[bag])
                dv, du = dl[:, None] * p["a"] * u * (1 - v * v), dl[:, None] * p["a"] * v * u * (1 - u)
                dh = (a[:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
                grads = {"encode": xs.T @ dh, "encode0": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "a": (v * u).T @ dl, "out": z.T @ ds, "out0": np.array([ds.sum()])}
                step += 1
                rate = 0.01 * 0.5 ** (turn / 12)
                for k, g in grads.items():
                    g = g + 1e-4 * p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    workspace: Workspace,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    carry: tuple[str, ...] = ("doc_id",),
    parts: int = 4,
    held_out: int = 2,
    per_class: int = 3_000,
    passage_words: int = 64,
    threshold: float = 0.7,
) -> DataFrame:
    """Score every whole text for quality.

    Returns the columns ``carry`` of ``docs``, then ``score`` (0 to 1, higher is better), ``predicted`` (1 from
    ``threshold`` on), ``n_passages`` and ``attention``, the weight of each passage.  Labels are learned
    from about ``per_class`` whole documents of each, of rows whose crc32(id as text) modulo ``parts`` is
    not ``held_out``; all their passages are trained on.  Id, language and source are no inputs.  Rows without an id are
    scored and not learned from.  A null, empty or wordless text is one passage without words.  If the
    sample lacks one of the labels, every score is the share of good rows in it (0.5 without rows).
    Repeated rows score alike.
    """
    sample, sizes = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, parts=parts, held_out=held_out, per_class=per_class)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            x, count = passages(texts_of(batch.column("_text")), passage_words)
            edges = np.cumsum(np.concatenate(([0], count))).tolist()
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([x[a:e].tobytes() for a, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["id", "label", "x"])

    kind = dict(sample.dtypes)["id"]
    # At most about 2 * per_class rows of bounded texts, as short vectors.
    rows = sample.mapInArrow(encode, f"id {kind}, label int, x binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (str(r["id"]), r["x"]))
    y = np.array([r["label"] for r in rows], float)
    model, base = None, float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) == 2:
        bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
        model = AttentionModel.train(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), y, class_weights(y, sizes))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base_docs = pick(docs, carry, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            x, count = passages(texts_of(batch.column("_text")), passage_words)
            if shared.value is None:
                s, a = np.full(len(count), base), 1 / np.repeat(count, count)
            else:
                s, a, *_ = shared.value.forward(x, count)
            weights = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(a.astype(np.float32)))
            columns = [*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(count.astype(np.int64)), weights]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "score", "predicted", "n_passages", "attention"])

    return base_docs.mapInArrow(score, with_fields(base_docs, carry, "score double, predicted int, n_passages long, attention array<float>"))
