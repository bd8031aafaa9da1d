"""Quality rules: word statistics and a perplexity band per language.

The language model is a modified Kneser-Ney model over characters.  Spark counts
the n-grams of the whole corpus (every task first counts its own), derives the
continuation counts of the lower orders from the distinct ones, and the model
ends up as sorted arrays of 64-bit n-gram hashes with their discounted counts
and context weights.  N-grams are counted as whole code points, packed in two
longs, and keep an entry each: the model, which is broadcast, has 12 bytes for
every distinct n-gram and 16 for every distinct context of the corpus.

A document's perplexity is compared with its language's: the band reaches
``reach`` interquartile ranges beyond the quartiles of log-perplexity on either
side, over the language's documents that pass the base rules.  Quartiles are
within a ten-thousandth of the ranks (exact ones would hold a language's
documents in one task), so a band may move in its last digits with the
partitioning.

Defined results: a null text has no words and fails the base rules; a null
language has a band of its own; a text without characters has no perplexity;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, hold, mix, ship, slices, span_hashes, spans_equal, stash, text_buffers, word_bounds

ORDER = 5
CODE_BITS = 21
CODES = 0x110000
#: An n-gram's last characters go into ``lo``, those before them into ``hi``.
LOW = 3
#: Entries a bucket of the index over a sorted array has on average, at most.
BUCKET = 2
SYMBOLS = b"#*$%&|<>"
SCAN_BYTES = 1 << 19
#: Distinct n-grams that a counting task holds; it sends them on beyond half of that.
HELD_KEYS = 2_000_000
BAND_LANGUAGES = 20_000
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and which sorted entries equal the one before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys):
        s = keys[order]
        same[1:] = s[1:] == s[:-1]
    return order, same


def _alike(buf: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], row: np.ndarray, order: np.ndarray, same: np.ndarray) -> bool:
    """Whether everything that hashes like the entry before it also has its bytes, span by span, and its row."""
    b = np.flatnonzero(same)
    a, b = order[b - 1], order[b]
    if not (row[a] == row[b]).all():
        return False
    for starts, ends in parts:
        size = ends[a] - starts[a]
        if not ((size == ends[b] - starts[b]).all() and spans_equal(buf, starts[a], starts[b], size).all()):
            return False
    return True


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics of each row; ``off`` starts at 0 and covers ``buf``."""
    rows = len(off) - 1
    starts, ends, row = word_bounds(buf, off)
    solid = np.zeros(len(buf) + 1, np.int32)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    solid = np.cumsum(solid[:-1]).astype(bool)
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": _per_row(solid & ((buf & 0xC0) != 0x80), off),
        "n_symbols": _per_row(_symbol[buf], off),
    }
    newline = np.flatnonzero(buf == 10)
    ls = np.concatenate([off[:-1], newline + 1])
    lrow = np.concatenate([np.arange(rows), np.searchsorted(off, newline, "right") - 1])
    le = np.minimum(np.append(newline, len(buf))[np.searchsorted(newline, ls)], off[lrow + 1])
    words_before = np.searchsorted(starts, np.stack([ls, le]))
    keep = words_before[1] > words_before[0]
    ls, le, lrow = ls[keep], le[keep], lrow[keep]
    order, same = _repeats(mix(span_hashes(buf, ls, le) ^ mix(lrow.astype(np.uint64))))
    if _alike(buf, [(ls, le)], lrow, order, same):
        out["n_dup_lines"] = np.bincount(lrow[order][same], minlength=rows)
    else:
        out["n_dup_lines"] = np.zeros(rows, np.int64)
        for (r, _), n in Counter((r, buf[a:e].tobytes()) for a, e, r in zip(ls, le, lrow.tolist(), strict=True)).items():
            out["n_dup_lines"][r] += n - 1
    wh = span_hashes(buf, starts, ends)
    n = len(wh) - 2
    covered = np.zeros(len(wh), bool)
    if n > 0:
        inside = np.flatnonzero(row[:n] == row[2:])
        tri = mix(wh[inside] + mix(wh[inside + 1] + mix(wh[inside + 2] + row[inside].astype(np.uint64))))
        order, same = _repeats(tri)
        both = same.copy()
        both[:-1] |= same[1:]
        at = inside[order[both]]
        if not _alike(buf, [(starts[inside + k], ends[inside + k]) for k in range(3)], row[inside], order, same):
            words = [buf[a:e].tobytes() for a, e in zip(starts, ends, strict=True)]
            found = Counter((row[i], *words[i : i + 3]) for i in inside.tolist())
            at = np.array([i for i in inside.tolist() if found[row[i], *words[i : i + 3]] > 1], np.int64)
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    return out


def gram_keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram ending at each character, as rows (hi, lo), and its text's row; zeros stand before a text."""
    raw = buf.tobytes().decode("utf-8", "replace")
    code = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    coff = heads[off]
    code[(code == 32) | ((code >= 9) & (code <= 13))] = 32
    code[code == 0] = 1
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(coff))
    wide = np.zeros(len(code) + (ORDER - 1) * rows, np.int64)
    at = np.arange(len(code)) + (ORDER - 1) * (row + 1)
    wide[at] = code
    key = np.zeros((2, len(wide)), np.int64)
    for k in range(ORDER):
        key[int(k < LOW), k:] |= wide[: len(wide) - k] << (CODE_BITS * (k % LOW))
    return key[:, at].T, row


def last(hi, lo, n: int):
    """(hi, lo) of the last n characters; numpy arrays and Columns alike."""
    zero = F.lit(0).cast("long") if isinstance(hi, Column) else np.zeros_like(lo)
    ones = lambda x, k: x.bitwiseAND(F.lit((1 << CODE_BITS * k) - 1)) if isinstance(x, Column) else x & ((1 << CODE_BITS * k) - 1)
    return (ones(hi, n - LOW), lo) if n > LOW else (zero, ones(lo, n))


def context(hi, lo):
    """(hi, lo) of all but the last character; numpy arrays and Columns alike."""
    if isinstance(hi, Column):
        moved = F.shiftleft(hi.bitwiseAND(F.lit((1 << CODE_BITS) - 1)), CODE_BITS * (LOW - 1))
        return F.shiftright(hi, CODE_BITS), F.shiftright(lo, CODE_BITS).bitwiseOR(moved)
    return hi >> CODE_BITS, lo >> CODE_BITS | (hi & ((1 << CODE_BITS) - 1)) << (CODE_BITS * (LOW - 1))


def gram_hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts n-grams by hash, which sorted ones are the first of their kind, and where those stand."""
    h = gram_hash(hi, lo)
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return order, new, np.flatnonzero(new)


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(hi, lo, c) over every text of the one string column."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngrams")
        held: list[tuple[np.ndarray, ...]] = []

        def counted(hi: np.ndarray, lo: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
            order, _, at = distinct(hi, lo)
            if c is None:
                return hi[order[at]], lo[order[at]], np.diff(np.append(at, len(order)))
            return hi[order[at]], lo[order[at]], np.add.reduceat(c[order], at) if len(at) else c

        def merged() -> tuple[np.ndarray, ...]:
            return counted(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def sent() -> Iterator[pa.RecordBatch]:
            cols = merged()
            held.clear()
            for i in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in cols], names=["hi", "lo", "c"])

        for batch in batches:
            buf, off, _ = text_buffers(batch.column(0))
            for i, j in slices(off, SCAN_BYTES):
                a, b = off[i], off[j]
                key, _ = gram_keys(buf[a:b], off[i : j + 1] - a)
                held.append(counted(key[:, 0], key[:, 1]))
                if sum(len(k) for k, _, _ in held) > HELD_KEYS:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_KEYS // 2:
                        yield from sent()
        if held:
            yield from sent()

    return texts.mapInArrow(count, "hi long, lo long, c long").groupBy("hi", "lo").agg(F.sum("c").alias("c"))


def _discounts(n: dict[int, int]) -> list[float]:
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [i - (i + 1) * y * b / a if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [0.0, *(min(max(x, 0.05), 0.95 * i) for i, x in enumerate(d, 1))]


def _sorted_arrays(table: DataFrame) -> list[np.ndarray]:
    """Hashes of the n-grams (hi, lo) of a table, sorted, and its other columns; goes by Arrow, without row objects."""
    hi, lo, *cols = (c.to_numpy() for c in table.toArrow().columns)
    h = gram_hash(hi, lo)
    order = np.argsort(h)
    return [h[order], *(c[order] for c in cols)]


def train(texts: DataFrame) -> dict[str, np.ndarray]:
    """Sorted hash arrays: gram{n}/num{n} and ctx{n}/inv{n}/gam{n} for n = 1..ORDER."""
    level = stash(count_ngrams(texts), "ngrams")
    model: dict[str, np.ndarray] = {}
    hi, lo = F.col("hi"), F.col("lo")
    for n in range(ORDER, 0, -1):
        few = {r[0]: r[1] for r in level.where("c <= 4").groupBy("c").count().collect()}
        d = _discounts(few)
        cut = F.when(F.col("c") == 1, d[1]).when(F.col("c") == 2, d[2]).otherwise(d[3])
        grams = level.select("hi", "lo", (F.col("c") - cut).cast("float").alias("num"))
        own = [x.alias(k) for x, k in zip(context(hi, lo), ("hi", "lo"), strict=True)]
        ctxs = level.select(*own, "c", cut.alias("cut")).groupBy("hi", "lo").agg(F.sum("c").cast("double").alias("total"), F.sum("cut").alias("left"))
        model[f"gram{n}"], model[f"num{n}"] = _sorted_arrays(grams)
        model[f"ctx{n}"], model[f"inv{n}"], model[f"gam{n}"] = _sorted_arrays(ctxs.select("hi", "lo", (1 / F.col("total")).cast("float"), (F.col("left") / F.col("total")).cast("float")))
        if n > 1:
            shorter = [x.alias(k) for x, k in zip(last(hi, lo, n - 1), ("hi", "lo"), strict=True)]
            level = level.select(*shorter).groupBy("hi", "lo").agg(F.count("*").alias("c"))
            if n == ORDER:
                level = stash(level, "ngrams")
    return model


class Index:
    """Places of hashes in a sorted array, by the bucket of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, (len(keys) // BUCKET).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.uint32 if len(keys) < 1 << 32 else np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or the number of keys where there is none."""
        n = len(self.keys)
        out = np.full(len(h), n, np.int64)
        if not n:
            return out
        at = self.first[(h >> self.shift).astype(np.int64)].astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[np.minimum(at, n - 1)]
            hit = (key == h) & (at < n)
            out[todo[hit]] = at[hit]
            more = (key < h) & (at < n)
            todo, h, at = todo[more], h[more], at[more] + 1
        return out


class Scorer:
    """Log-probabilities of characters; indexes the sorted arrays once."""

    def __init__(self, model: dict[str, np.ndarray]):
        add = lambda x, v: np.append(x, np.float32(v)).astype(np.float32)
        self.gram = {n: Index(model[f"gram{n}"]) for n in range(1, ORDER + 1)}
        self.ctx = {n: Index(model[f"ctx{n}"]) for n in range(1, ORDER + 1)}
        # the last entry is that of what was never seen
        self.num = {n: add(model[f"num{n}"], 0) for n in range(1, ORDER + 1)}
        self.inv = {n: add(model[f"inv{n}"], 0) for n in range(1, ORDER + 1)}
        self.gam = {n: add(model[f"gam{n}"], 1) for n in range(1, ORDER + 1)}

    def logp(self, key: np.ndarray) -> np.ndarray:
        """Of each ORDER-gram (hi, lo); repeated ones are looked up once."""
        order, new, at = distinct(key[:, 0], key[:, 1])
        hi, lo = key[order[at], 0], key[order[at], 1]
        p = np.full(len(at), 1 / CODES, np.float32)
        for n in range(1, ORDER + 1):
            gram = last(hi, lo, n)
            ctx = self.ctx[n].find(gram_hash(*context(*gram)))
            p = self.num[n][self.gram[n].find(gram_hash(*gram))] * self.inv[n][ctx] + self.gam[n][ctx] * p
        out = np.empty(len(key), np.float32)
        out[order] = np.log(np.maximum(p, 1e-30))[np.cumsum(new) - 1]
        return out


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with the base counts, n_chars and the mean log-perplexity of each text."""
    ship(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    carry = docs.columns if carry is None else carry
    # the text travels once, whether it is carried or only read
    sent = carry if text_col in carry else [*carry, text_col]
    at, names = sent.index(text_col), [f"__tv_{i}" for i in range(len(sent))]
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(sent, names, strict=True)))
    fields = [*(f"__tv_q_{f}" for f in BASE_FIELDS), "__tv_q_chars"]
    schema = T.StructType([*inner.schema.fields[: len(carry)], *(T.StructField(f, T.LongType()) for f in fields), T.StructField("__tv_q_log_ppl", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality_rules", _scorers.clear)
        scorer = None
        for batch in batches:
            if scorer is None:
                scorer = _scorers.get(name)
                if scorer is None:
                    _scorers.clear()
                    scorer = _scorers[name] = Scorer(shared.value)
                    vars(shared).pop("_value", None)  # expanded now; read from its file again if need be
                    give_back()
            buf, off, _ = text_buffers(batch.column(at))
            got: dict[str, list[np.ndarray]] = {f: [] for f in (*BASE_FIELDS, "chars", "sum")}
            for i, j in slices(off, SCAN_BYTES):
                a, b = off[i], off[j]
                part, poff = buf[a:b], off[i : j + 1] - a
                for f, v in base_counts(part, poff).items():
                    got[f].append(v)
                key, row = gram_keys(part, poff)
                got["chars"].append(np.bincount(row, minlength=j - i))
                step = SCAN_BYTES  # one long text is scored piece by piece
                total = np.zeros(j - i)
                for k in range(0, len(key), step):
                    total += np.bincount(row[k : k + step], scorer.logp(key[k : k + step]), j - i)
                got["sum"].append(total)
            cols = {f: np.concatenate(v) if v else np.zeros(0, np.int64) for f, v in got.items()}
            chars = cols["chars"]
            ppl = -cols["sum"] / np.maximum(chars, 1)
            new = [pa.array(cols[f].astype(np.int64)) for f in (*BASE_FIELDS, "chars")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *new, pa.array(ppl, mask=chars == 0)], names=schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(carry, names, strict=False)), *fields, "__tv_q_log_ppl")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, reach: float = 2.0, narrowest: float = 0.05) -> DataFrame:
    """The carried columns with a struct ``__tv_rules``: base counts, base_failed, log_ppl, kept.

    ``narrowest`` is the least interquartile range assumed, for languages of a few documents.
    """
    carry = docs.columns if carry is None else carry
    held = docs.withColumn("__tv_q_lang", F.coalesce(F.concat(F.lit("s"), F.col(f"`{lang_col}`")), F.lit("z")))
    scored = stash(score(held, train(docs.select(F.col(f"`{text_col}`").alias("text"))), text_col, [*carry, "__tv_q_lang"]), "rules")
    failed = (F.col("__tv_q_n_words") < 50) | (F.col("__tv_q_n_repeat_words") * 100 > F.col("__tv_q_n_words") * 50)
    q = F.percentile_approx("__tv_q_log_ppl", [0.25, 0.75], 10000)
    bands = scored.where(~failed).groupBy("__tv_q_lang").agg(q.alias("q"))
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(narrowest)) * reach
    bands = stash(bands.select("__tv_q_lang", (F.col("q")[0] - wide).alias("__tv_q_low"), (F.col("q")[1] + wide).alias("__tv_q_high")), "bands")
    if bands.limit(BAND_LANGUAGES + 1).count() <= BAND_LANGUAGES:
        bands = F.broadcast(bands)
    inside = F.coalesce(F.col("__tv_q_log_ppl").between(F.col("__tv_q_low"), F.col("__tv_q_high")), F.lit(True))
    rules = F.struct(*(F.col(f"__tv_q_{f}").alias(f) for f in BASE_FIELDS), failed.alias("base_failed"), F.col("__tv_q_log_ppl").alias("log_ppl"), (~failed & inside).alias("kept"))
    return scored.join(bands, "__tv_q_lang", "left").select(*(F.col(f"`{c}`") for c in carry), rules.alias("__tv_rules"))
