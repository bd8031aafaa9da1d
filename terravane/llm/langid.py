"""Language identification by averaged hashed subword embeddings.

Every word (a run of letters) is read as its hashed character n-grams and itself;
their embeddings are averaged over the whole text and fed to a linear softmax.
Training is plain stochastic gradient descent in numpy on a bounded sample of
labelled rows; a held-back part of it calibrates the temperature and, per
language, the score below which a prediction is rejected.

Because everything up to the softmax is linear, a trained model is one table of
``2 ** BITS`` rows with a logit per language, and scoring adds table rows.

Defined results: repeated rows get equal results and are learned from once; a
text that is null or has no letter is ``und`` with score 0;
ties go to the first language in code-point order; with no labelled row every
text is ``und``; an empty table gives no rows.
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

from .common import ship

BITS, DIM = 15, 16
GRAMS = (2, 3, 4)
#: Labelled rows used for training, at most about this many a language (sample by hash of id and text).
SAMPLE_PER_LANGUAGE = 600
#: Languages learned at most; it bounds the sample, and more are refused.
LANGUAGES = 1000
WORD = re.compile(r"[^\W\d_]+")
#: Gradient steps at least; a small sample is gone through more often.
STEPS = 600
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words: flat indices and the start of each word's."""
    raw = "".join(f"<{w}>" for w in words)
    cp = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(words)), size)
    feats, owners = [], []
    for n in GRAMS:
        h = np.full(max(len(cp) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h ^ cp[k : k + len(h)]) * _MUL
            h ^= h >> np.uint64(29)
        ok = owner[: len(h)] == owner[n - 1 :][: len(h)]
        feats.append((h >> np.uint64(64 - BITS))[ok])
        owners.append(owner[: len(h)][ok])
    whole = np.zeros(len(words), np.uint64)
    total = np.zeros(len(cp) + 1, np.uint64)
    place = np.arange(len(cp), dtype=np.uint64) - np.repeat(first[:-1], size).astype(np.uint64)
    np.cumsum((cp + np.uint64(7)) * (place * np.uint64(2) + np.uint64(1)) * _MUL, out=total[1:], dtype=np.uint64)
    whole = (total[first[1:]] - total[first[:-1]]) * _MUL
    feats.append(whole >> np.uint64(64 - BITS))
    owners.append(np.arange(len(words)))
    flat, own = np.concatenate(feats).astype(np.int64), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return flat[order], np.searchsorted(own[order], np.arange(len(words)))


def bags(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the word number of every occurrence, and the first of each text."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    first = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    codes, words = pd.factorize(np.array([w for f in found for w in f], dtype=object)) if first[-1] else (np.zeros(0, np.int64), [])
    return list(words), codes, first


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # 2 ** BITS x languages: logits a feature
    bias: np.ndarray
    temperature: float
    reject: np.ndarray  # least accepted score by language

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Mean feature logits of each text; NaN rows where there is no word."""
        words, codes, first = bags(texts)
        out = np.full((len(texts), len(self.languages)), np.nan)
        if words:
            flat, start = word_features(words)
            per_word = np.add.reduceat(self.table[flat], start)
            count = np.diff(np.append(start, len(flat)))
            total = np.zeros((len(codes) + 1, per_word.shape[1]))
            np.cumsum(per_word[codes], axis=0, out=total[1:])
            n = np.concatenate([[0], np.cumsum(count[codes])])
            some = first[1:] > first[:-1]
            out[some] = ((total[first[1:]] - total[first[:-1]]) / np.maximum(n[first[1:]] - n[first[:-1]], 1)[:, None])[some]
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1 for und), calibrated score and whether the prediction is rejected."""
        z = self.logits(texts)
        none = np.isnan(z[:, 0]) if z.shape[1] else np.ones(len(texts), bool)
        p = _softmax(np.where(none[:, None], 0, z) / self.temperature) if z.shape[1] else np.zeros((len(texts), 1))
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        for i in np.flatnonzero(none):  # letters that the word pattern misses still get the likeliest language
            if not (z.shape[1] and texts[i] and any(ch.isalpha() for ch in texts[i])):
                best[i], score[i] = -1, 0.0
        return best, score, (best < 0) | (score < np.append(self.reject, 2)[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 4.0, batch: int = 16, seed: int = 7, precision: float = 0.99) -> LanguageModel:
    """Stochastic gradient descent on four fifths of the rows, calibration on the rest."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, np.zeros(0))
    y = np.array([langs.index(x) for x in labels])
    words, codes, first = bags(texts)
    keep = np.flatnonzero(first[1:] > first[:-1])
    flat, start = word_features(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    end = np.append(start[1:], len(flat))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))

    def features(i: int) -> tuple[np.ndarray, np.ndarray]:
        used, times = np.unique(codes[first[i] : first[i + 1]], return_counts=True)
        at = np.concatenate([np.arange(start[u], end[u]) for u in used])
        names, inverse = np.unique(flat[at], return_inverse=True)
        return names, np.bincount(inverse, np.repeat(times, end[used] - start[used]))

    held = {i: features(i) for i in keep}
    shuffled = rng.permutation(keep)
    check, learn = shuffled[: len(shuffled) // 5], shuffled[len(shuffled) // 5 :]
    each = max(1, -(-len(learn) // batch))
    epochs = max(epochs, -(-STEPS // each))
    steps = epochs * each
    step = 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            f = [held[i] for i in rows]
            weight = [w / w.sum() for _, w in f]
            x = np.stack([w @ emb[k] for (k, _), w in zip(f, weight, strict=True)])
            g = _softmax(x @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            lr = rate * (1 - step / steps) / len(rows)
            gx = g @ out.T
            out -= lr * 0.25 * (x.T @ g)
            bias -= lr * 0.05 * g.sum(0)
            for (k, _), w, gi in zip(f, weight, gx, strict=True):
                emb[k] -= lr * 8 * w[:, None] * gi  # a text names a feature once
            step += 1
    model = LanguageModel(langs, emb @ out, bias, 1.0, np.zeros(len(langs)))
    if len(check):
        z, t = model.logits([texts[i] for i in check]), y[check]
        loss = lambda s: -np.log(np.maximum(_softmax(z / s)[np.arange(len(t)), t], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = _softmax(z / model.temperature)
        best, score = p.argmax(1), p.max(1)
        for k in range(len(langs)):  # least score from which the predictions are right often enough
            mine = np.flatnonzero(best == k)
            mine = mine[np.argsort(-score[mine])]
            right = np.cumsum(t[mine] == k) / np.arange(1, len(mine) + 1)
            good = np.flatnonzero(right >= precision)
            model.reject[k] = score[mine[good[-1]]] if len(good) else 1.0
    return model


def draw(rows: DataFrame, counts: dict, per_label: int, *key: str) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by hash of the key columns."""
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_label / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30) < share)


def sample_labelled(rows: DataFrame, per_label: int, most_labels: int) -> pd.DataFrame:
    """About ``per_label`` rows of (text, label) for each label, chosen by hash of the row, on the driver; a repeated row counts once."""
    counts = rows.groupBy("label").count()
    few = counts.limit(most_labels + 1).collect()
    if len(few) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    got = draw(rows, {r[0]: r[1] for r in few}, per_label, "key", "text").select("key", "text", "label").distinct().toArrow().to_pandas()
    return got.sort_values(["label", "key", "text"], kind="stable").reset_index(drop=True)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([plain.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                best, score, rejected = shared.value.predict(part.column(1).to_pylist())
                names = np.array([*shared.value.languages, "und"], dtype=object)[best]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return plain.mapInArrow(run, schema)
