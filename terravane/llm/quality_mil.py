"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages (``PASSAGE`` words each).  A passage is encoded as
the mean of hashed embeddings of its words (the word, its ends, length and shape)
plus its rates of repetition, squashed by tanh.  A word of more than ``LONG``
characters counts as pieces of ``PIECE``, and what is written in a script without
spaces as pieces of two characters, so passages cover every character.  Gated attention ``w . (tanh(V h) * sigmoid(U h))``
weighs the passages, and a logistic unit scores the weighted representation.
All of it is learned from document labels by Adam in numpy.

Passages of one text are summed as they come, so a text of any length is scored
whole in bounded memory.

Defined results: a null text or one without words is scored by the bias alone;
with no labelled row every score is 0.5; repeated rows get equal scores; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, ship

BITS, DIM, GATE = 14, 16, 8
PASSAGE = 64
#: A longer word is cut; the first and last three characters of a piece are all of it.
LONG, PIECE = 24, 6
#: Thai to Tibetan, Myanmar, Khmer, kana, ideographs.
_unspaced = "\u0e01-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{_unspaced}]")
PARTS = re.compile(f"[{_unspaced}]{{1,2}}|[^{_unspaced}]+")
#: Labelled rows used for training, about this many for each label.
SAMPLE_PER_LABEL = 1500
_MUL = np.uint64(0x9E3779B97F4A7C15)
_shape = np.arange(128, dtype=np.uint64) + np.uint64(10)
_shape[48:58], _shape[65:91], _shape[97:123] = 3, 2, 1
FEATURES = 5


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features, a row for each word: shape, end, beginning, the word itself, its length."""
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    last = first + size - 1
    place = np.arange(len(cp)) - np.repeat(first, size)
    shape = np.where(cp < 128, _shape[np.minimum(cp, 127).astype(np.int64)], cp + np.uint64(10))
    turn = (place == 0) | (shape != np.roll(shape, 1))
    run = np.cumsum(turn) - np.repeat(np.cumsum(turn)[first] - 1, size) - 1
    salted = lambda x, k: mix(x * _MUL + k.astype(np.uint64))
    runs = np.add.reduceat(np.where(turn & (run < 6), salted(shape, run), np.uint64(0)), first)
    lower = np.where((cp >= 65) & (cp < 91), cp + np.uint64(32), cp)
    whole = np.add.reduceat(salted(lower, place), first)
    end, begin = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for k in range(3):
        has = (size > k).astype(np.uint64)
        end = mix(end + has * cp[np.maximum(last - k, first)] * _MUL)
        begin = mix(begin + has * cp[np.minimum(first + k, last)] * _MUL)
    out = np.stack([runs, end, begin, whole, np.minimum(size, 12).astype(np.uint64)], 1)
    return (mix(out + np.arange(FEATURES, dtype=np.uint64) * _MUL) >> np.uint64(64 - BITS)).astype(np.int64)


def words_of(text: str) -> list[str]:
    """The words of a text, long and unspaced ones in pieces."""
    words = text.split()
    if not text.isascii() and UNSPACED.search(text):
        words = [p for w in words for p in PARTS.findall(w)]
    if max(map(len, words), default=0) > LONG:
        words = [p for w in words for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]
    return words


def passages(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, word numbers, first word of each passage, first passage of each text."""
    split = [words_of(t) if t else [] for t in texts]
    n = np.array([len(s) for s in split], np.int64)
    codes, words = pd.factorize(np.array([w for s in split for w in s], dtype=object)) if n.sum() else (np.zeros(0, np.int64), [])
    per = -(-n // PASSAGE)
    bag = np.concatenate([[0], np.cumsum(per)])
    begin = np.concatenate([[0], np.cumsum(n)])
    inside = np.arange(bag[-1]) - np.repeat(bag[:-1], per)
    start = np.append(np.repeat(begin[:-1], per) + inside * PASSAGE, n.sum())
    return list(words), codes, start, bag


def repetition(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each passage: shares of words seen before in it, equal to the one before, equal to the second before."""
    size = np.diff(start)
    owner = np.repeat(np.arange(len(size)), size)
    distinct = np.bincount(np.unique(owner * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1), minlength=len(size))
    cols = [1 - distinct / size]
    for k in (1, 2):
        same = (codes[k:] == codes[:-k]) & (owner[k:] == owner[:-k])
        cols.append(np.bincount(owner[k:][same], minlength=len(size)) / size)
    return np.stack(cols, 1)


@dataclass
class Params:
    emb: np.ndarray
    rep: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _segments(values: np.ndarray, bag: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[bag[1:]] - total[bag[:-1]]


def attend(p: Params, h: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document logits from passage encodings, with what the gradient needs."""
    t, g = np.tanh(h @ p.v), _sigmoid(h @ p.u)
    e = np.exp(np.clip((t * g) @ p.w, -20, 20))
    total = np.maximum(_segments(e, bag), 1e-12)
    doc = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
    a = e / total[doc]
    z = _segments(a[:, None] * h, bag)
    return z @ p.out + p.bias[0], z, a, doc, t, g


class QualityModel:
    def __init__(self, params: Params, scale: tuple[float, float] = (1.0, 0.0)):
        self.p, self.scale = params, scale

    def restore_prior(self, share: float, sampled: float) -> None:
        """Shifts the scores from the share of label 1 in the sample to that in the labels."""
        odds = lambda q: np.log(max(q, 1e-3) / max(1 - q, 1e-3))
        self.scale = (self.scale[0], self.scale[1] + odds(share) - odds(sampled))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words, codes, start, bag = passages(texts)
        h = np.zeros((0, DIM))
        if words:
            h = np.tanh(np.add.reduceat(self.p.emb[word_features(words)].mean(1)[codes], start[:-1]) / np.diff(start)[:, None] + repetition(codes, start) @ self.p.rep)
        logit = attend(self.p, h, bag)[0]
        return _sigmoid(self.scale[0] * logit + self.scale[1])


def fit(texts: list[str | None], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 11) -> QualityModel:
    """Adam on the logistic loss of the documents; a fifth of the rows calibrates the scale."""
    rng = np.random.default_rng(seed)
    p = Params(rng.normal(0, 0.3, (1 << BITS, DIM)), rng.normal(0, 0.3, (3, DIM)), rng.normal(0, 0.3, (DIM, GATE)), rng.normal(0, 0.3, (DIM, GATE)), rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, DIM), np.zeros(1))
    y = np.array(labels, float)
    if not len(y):
        p.out[:] = 0
        return QualityModel(p)
    words, codes, start, bag = passages(texts)
    reps = repetition(codes, start) if words else np.zeros((0, 3))
    feats = word_features(words) if words else np.zeros((0, FEATURES), np.int64)
    some = np.flatnonzero(np.diff(bag) > 0)
    shuffled = rng.permutation(some)
    check, learn = shuffled[: len(shuffled) // 5], shuffled[len(shuffled) // 5 :]
    p.bias[0] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in vars(p).items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            inst = np.concatenate([np.arange(bag[i], bag[i + 1]) for i in rows])
            mine = np.concatenate([[0], np.cumsum(bag[rows + 1] - bag[rows])])
            size = start[inst + 1] - start[inst]
            tok = np.concatenate([codes[start[i] : start[i + 1]] for i in inst])
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            used, tok = np.unique(tok, return_inverse=True)
            f = feats[used]
            h = np.tanh(np.add.reduceat(p.emb[f].mean(1)[tok], at) / size[:, None] + reps[inst] @ p.rep)
            logit, z, a, doc, t, g = attend(p, h, mine)
            d = (_sigmoid(logit) - y[rows]) / len(rows)
            dz = d[:, None] * p.out
            da = (dz[doc] * h).sum(1)
            ds = a * (da - _segments(a * da, mine)[doc])
            dt, dg = ds[:, None] * p.w * g * (1 - t * t), ds[:, None] * p.w * t * g * (1 - g)
            dh = a[:, None] * dz[doc] + dt @ p.v.T + dg @ p.u.T
            dx = dh * (1 - h * h)
            dr = reps[inst].T @ dx
            dx /= size[:, None]
            word_grad = np.stack([np.bincount(tok, np.repeat(dx[:, k], size), len(used)) for k in range(DIM)], 1)
            de = np.stack([np.bincount(f.ravel(), np.repeat(word_grad[:, k] / f.shape[1], f.shape[1]), 1 << BITS) for k in range(DIM)], 1)
            grads = {"emb": de, "rep": dr, "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ ds, "out": z.T @ d, "bias": np.array([d.sum()])}
            step += 1
            for k, gr in grads.items():
                m, s = moment[k]
                m += 0.1 * (gr - m)
                s += 0.01 * (gr * gr - s)
                getattr(p, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    model = QualityModel(p)
    if len(check) > 20:
        raw = model.scores([texts[i] for i in check])
        logit = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / (1 - np.clip(raw, 1e-6, 1 - 1e-6)))
        loss = lambda s: -np.log(np.clip(np.where(y[check] > 0.5, q := _sigmoid(s * logit), 1 - q), 1e-9, 1)).mean()
        model.scale = (float(min(np.geomspace(0.2, 5, 40), key=loss)), 0.0)
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.p, model.scale))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([plain.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = QualityModel(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mine.scores(part.column(1).to_pylist()))], names=schema.names)

    return plain.mapInArrow(run, schema)
