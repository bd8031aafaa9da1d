"""MinHash near-dedup with HyperMinHash registers.

Texts are lower-cased (A-Z) and read as sets of word shingles.  A register keeps,
for the least hash of its bucket, the count of leading zeros and the mantissa
bits after them (6 + 10 bits); empty buckets borrow from a bucket drawn by a
fixed random order, so bands keep their collision probability on short texts.

1. Texts of equal word sequences (by a 128-bit cryptographic digest) form a class;
   one representative stands for it.
2. Bands of registers make buckets.  Each bucket hands its members to its least
   and greatest one, never all pairs; pairs pass a 128-bit sketch of the
   registers, the collision-corrected Jaccard estimate, and last the exact test
   on the full shingle sets of the texts, where shingles that hash alike count as
   common only if their bytes are equal.
3. Only where a bucket still holds several components are the members outside
   its first component compared with the rest, register by register in tiles.

With ``BANDS`` bands of ``ROWS`` registers a pair at similarity 0.75 meets in no
band with probability 2e-5.

Defined results: a null or blank text has no shingles and links with nothing; a
text of fewer words than a shingle is one shingle; rows that share an id are one
node; a row without an id links with nothing, has no component and is kept; ids
must be whole numbers; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, discard, hold, lower_ascii, mix, partitions, ship, slices, space_mask, span_hashes, spans_equal, stash, text_buffers, whole_number_id, word_bounds
from .components import connected_components

SHINGLE = 5
ROWS, BANDS = 5, 40
REGISTERS = 512
MANTISSA = 10
#: Differing sketch bits (of 128) up to which a pair is estimated: 0.75 differs in 16 +- 3.7.
SKETCH_BITS = 36
#: Standard errors by which an estimate may fall short of the threshold.
ESTIMATE_SLACK = 4.0
MEMBERS = 256
#: Bits of the bitmap that keeps texts without a bucket mate from the shuffle: half a megabyte, sent to every task.
SIEVE = 1 << 22
#: Copies of a hub's sketch, dealt out with its partners.
HUB_SALTS = 16
TILE = 512
#: Sets up to this size are compared exactly inside a bucket and signed with replicas.
SHORT, REPLICAS = 342, 16
#: Sets from this size fill the sketch's registers themselves.
SKETCHED = 1000


def words_in(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the start, end and row of each word; ``off`` starts at 0 and covers ``buf``."""
    buf = lower_ascii(buf)
    return buf, *word_bounds(buf, off)


def shingles(words: tuple[np.ndarray, ...], rows: int, width: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingle hashes of each row, and the word that each one first starts with."""
    buf, starts, ends, row = words
    wh = span_hashes(buf, starts, ends)
    n = len(wh) - width + 1
    sh = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        sh = mix(sh + wh[k : k + len(sh)])
    per = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for i in range(rows):
        a, b = per[i], per[i + 1]
        if b - a >= width:
            h, at = np.unique(sh[a : b - width + 1], return_index=True)
            out.append((h, at + a))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in wh[a:b]:
                h = mix(h + w)
            out.append((h, np.array([a])))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; ``off`` starts at 0 and covers ``buf``."""
    return [h for h, _ in shingles(words_in(buf, off), len(off) - 1, width)]


def digests(words: tuple[np.ndarray, ...], off: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each row's words, joined by one space, as two longs."""
    buf, _, ends, _ = words
    space = space_mask(buf)
    keep = ~space
    keep[ends[ends < len(buf)]] = True
    joined = np.where(space, np.uint8(32), buf)[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    each = [hashlib.blake2b(joined[a:b].tobytes().rstrip(b" "), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.frombuffer(b"".join(each), np.int64).reshape(-1, 2)


class Shingled:
    """A text's shingles with the bytes of its words, for the exact test."""

    def __init__(self, words: tuple[np.ndarray, ...], hashes: np.ndarray, first: np.ndarray, row: int):
        buf, starts, ends, rows = words
        a, b = np.searchsorted(rows, [row, row + 1])
        self.hashes, self.first, self.count = hashes, first - a, int(b - a)
        low, high = (starts[a], ends[b - 1]) if b > a else (0, 0)
        self.buf, self.starts, self.ends = buf[low:high].copy(), starts[a:b] - low, ends[a:b] - low

    def common(self, other: Shingled) -> int:
        """Shingles that both hold, byte for byte."""
        if not len(self.hashes) or not len(other.hashes) or min(self.count, other.count) < SHINGLE and self.count != other.count:
            return 0
        at = np.minimum(np.searchsorted(self.hashes, other.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == other.hashes)
        i, j = self.first[at[hit]], other.first[hit]
        same = np.ones(len(hit), bool)
        for k in range(min(SHINGLE, self.count)):
            size = self.ends[i + k] - self.starts[i + k]
            same &= (size == other.ends[j + k] - other.starts[j + k]) & spans_equal(self.buf, self.starts[i + k], other.starts[j + k], size, other.buf)
        return int(same.sum())


_donors = (mix(np.arange(REGISTERS * 64, dtype=np.uint64) + np.uint64(77)) % np.uint64(REGISTERS)).astype(np.int64).reshape(64, REGISTERS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16) of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, row * REGISTERS + bucket, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(1))
    least = least.reshape(-1, REGISTERS)
    full = least != np.iinfo(np.uint64).max
    out, done = least.copy(), full.copy()
    r, c = np.nonzero(~done)
    for order in _donors:
        if not len(r):
            break
        ok = full[r, order[c]]
        out[r[ok], c[ok]] = least[r[ok], order[c[ok]]]
        done[r[ok], c[ok]] = True
        r, c = r[~ok], c[~ok]
    for r in np.flatnonzero(~done.all(1)):  # a handful of shingles: the next full bucket around the circle
        have = np.flatnonzero(full[r])
        miss = np.flatnonzero(~done[r])
        out[r, miss] = least[r, have[np.searchsorted(have, miss) % len(have)]]
    zeros = 63 - np.minimum(np.floor(np.log2(out.astype(np.float64) + 1)).astype(np.int64), 63)
    zeros = np.minimum(zeros, 63)
    shift = 63 - zeros - MANTISSA
    up, down = np.maximum(-shift, 0).astype(np.uint64), np.maximum(shift, 0).astype(np.uint64)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (((out >> down) << up) & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for registers that agree by chance.

    Two unrelated registers agree with probability sum over leading-zero counts z
    of (2^-(z+1))^2 for the count times 2^-MANTISSA for the mantissa, i.e. about
    a third of 2^-MANTISSA.
    """
    chance = 2.0**-MANTISSA / 3
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def band_hashes(regs: np.ndarray, tag: int) -> np.ndarray:
    wide = regs[:, : BANDS * ROWS].astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    h = np.tile(np.arange(tag, tag + BANDS, dtype=np.uint64) + np.uint64(1), (len(regs), 1))
    for r in range(ROWS):
        h = mix(h + wide[:, :, r])
    return h


def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bands (2 * BANDS a row, 0 where there is none) and registers (0 for short texts) of each set.

    Short sets are entered ``REPLICAS`` times under different hashes, or a few
    shingles would decide all registers.  Sets of sizes that can be similar to
    both kinds get the bands of both.
    """
    n = np.array([len(s) for s in sets])
    bands, regs = np.zeros((len(sets), 2 * BANDS), np.uint64), np.zeros((len(sets), REGISTERS), np.uint16)
    if len(few := np.flatnonzero((n > 0) & (n <= SHORT))):
        twist = mix(np.arange(REPLICAS, dtype=np.uint64) + np.uint64(1))[:, None]
        bands[few, :BANDS] = band_hashes(registers([mix(sets[i][None, :] ^ twist).ravel() for i in few]), 0)
    if len(many := np.flatnonzero(n > 0.75 * SHORT)):
        regs[many] = registers([sets[i] for i in many])
        bands[many, BANDS:] = band_hashes(regs[many], BANDS)
    return bands, regs


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, bands, s1, s2): set size, digest of the words, band hashes, sketch of long texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash")
        for batch in batches:
            ids = batch.column(0)
            buf, off, _ = text_buffers(batch.column(1))
            for i, j in slices(off):
                words = words_in(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                sets = [h for h, _ in shingles(words, j - i)]
                n = np.array([len(s) for s in sets], np.int64)
                k = digests(words, off[i : j + 1] - off[i])
                bands, regs = sign(sets)
                bits = (mix(regs[:, :128].astype(np.uint64) + (np.arange(128, dtype=np.uint64) << np.uint64(16))) >> np.uint64(7)).astype(np.uint8) & 1
                sketch = np.packbits(bits, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * 2 * BANDS, 2 * BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
                cols = [ids.slice(i, j - i), pa.array(n), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), lists, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "k1", "k2", "bands", "s1", "s2"])

    plain = docs.select(whole_number_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>, s1 long, s2 long")


def _signed(texts: DataFrame) -> DataFrame:
    """(id, text) with n, bands, registers of all but short texts and the set of all but long ones, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = text_buffers(batch.column(1))
            size, band, reg, own = [], [], [], []
            for i, j in slices(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                bands, regs = sign(sets)
                size += [len(s) for s in sets]
                band += [x.tobytes() for x in bands]
                reg += [x.tobytes() if len(s) > 0.75 * SHORT else b"" for x, s in zip(regs, sets, strict=True)]
                own += [s.tobytes() if len(s) <= SHORT else b"" for s in sets]
            yield append_columns(batch, n=pa.array(size, pa.int64()), band=pa.array(band, pa.binary()), reg=pa.array(reg, pa.binary()), own=pa.array(own, pa.binary()))

    return texts.mapInArrow(run, "id long, text string, n long, band binary, reg binary, own binary").where("n > 0")


def _sieved(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts but most of those whose id is not among the members: by a bitmap of ids' hashes, of ``SIEVE`` bits whatever their number."""
    at = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    bits = members.select(at.alias("at")).select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    placed = texts.withColumn("at", at).withColumn("word", F.floor(F.col("at") / 64))
    met = placed.join(F.broadcast(words), "word").where("shiftright(bits, cast(at % 64 as int)) & 1 = 1")
    return met.select(*texts.columns)


def _least_estimate(percent: int, n: np.ndarray | int) -> np.ndarray:
    """The threshold less the slack; a set of n fills about REGISTERS * (1 - exp(-n / REGISTERS)) registers itself."""
    t, full = percent / 100, REGISTERS * (1 - np.exp(-np.asarray(n) / REGISTERS))
    return t - ESTIMATE_SLACK * (t * (1 - t) / full) ** 0.5


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) with a ``salt`` that deals out the partners of a hub ``a``, and (a, salt) once each.

    No task holds more than about ``MEMBERS`` partners of one ``a``.
    """
    hubs = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")).where("salts > 1"), "minhash-hubs")
    dealt = pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    return dealt, dealt.select("a", "salt").distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) but those whose estimate misses the threshold by more than the slack; short texts all pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, rb = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = np.ones(len(ra), bool)
            if len(at := np.array([i for i, (x, y) in enumerate(zip(ra, rb, strict=True)) if x and y], np.int64)):
                x, y = (np.frombuffer(b"".join(r[i] for i in at), np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
                keep[at] = estimate(x, y) >= _least_estimate(percent, b.column(4).to_numpy()[at])
            yield b.select([0, 1]).filter(pa.array(keep))

    end = lambda e: nodes.select(F.col("id").alias(e), F.col("reg").alias(f"r{e}"), F.col("n").alias(f"n{e}"))
    dealt, heads = _dealt(pairs)
    both = dealt.join(end("b"), "b").join(heads.join(end("a"), "a"), ["a", "salt"])
    return both.select("a", "b", "ra", "rb", F.least("na", "nb").alias("n")).mapInArrow(run, "a long, b long")


def _strays(inside: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and pass the estimate.

    ``inside`` has (h, j, lead, id, c): bucket, band, the bucket's first component,
    member and its component.  Members outside the first component meet all of
    other components.  A bucket is dealt out as tiles of at most ``TILE`` members
    by ``TILE`` strays; registers are compared inside a tile, and a pair is
    reported in the first band that it shares only.  Two short texts are compared
    exactly right there, and a tile reports one such link for two components.
    """
    spark = inside.sparkSession
    sizes = inside.groupBy("h").agg(F.ceil(F.count("*") / TILE).alias("ms"), F.ceil(F.sum((F.col("c") != F.col("lead")).cast("int")) / TILE).alias("ss"))
    sized = inside.join(sizes, "h")
    spread = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    members = sized.select("h", "j", own("ms").alias("x"), F.explode(spread("ss")).alias("y"), F.lit(1).alias("role"), "lead", "id", "c")
    strays = sized.where("c <> lead").select("h", "j", F.explode(spread("ms")).alias("x"), own("ss").alias("y"), F.lit(0).alias("role"), "lead", "id", "c")
    work = members.unionByName(strays).join(nodes.select("id", "n", "band", "reg", "own"), "id").select("h", "j", "x", "y", "role", "lead", "id", "c", "n", "band", "reg", "own")
    work = work.repartition(partitions(spark), "h", "x", "y").sortWithinPartitions("h", "x", "y", "role")

    def compared(rows: list[tuple]) -> np.ndarray:
        j, role, lead, ids, c, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 4, 5, 6, 7, 8))
        bands = np.frombuffer(b"".join(r[9] for r in rows), np.uint64).reshape(len(rows), -1)
        regs = np.zeros((len(rows), REGISTERS), np.uint16)
        for i in np.flatnonzero(n > 0.75 * SHORT):
            regs[i] = np.frombuffer(rows[i][10], np.uint16)
        sets = [np.frombuffer(r[11], np.uint64) for r in rows]
        found, joined = [], set()
        m = np.flatnonzero(role == 1)
        for s in np.flatnonzero(role == 0):
            o = m[(c[m] != c[s]) & ((c[m] == lead[s]) | (ids[m] < ids[s])) & (100 * np.minimum(n[m], n[s]) >= percent * np.maximum(n[m], n[s]))]
            if len(o):
                o = o[((bands[o] == bands[s]) & (bands[o] != 0)).argmax(1) == j[s]]
            exact = o[n[o] <= SHORT] if n[s] <= SHORT else o[:0]
            if len(exact):
                every = np.concatenate([sets[i] for i in exact])
                at = np.searchsorted(sets[s], every)
                hit = sets[s][np.minimum(at, len(sets[s]) - 1)] == every
                common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n[exact])[:-1]]))
                exact = exact[100 * common >= percent * (n[exact] + n[s] - common)]
            rough = o[n[o] > SHORT] if n[s] <= SHORT else o
            if len(rough):
                rough = rough[estimate(regs[rough], regs[s]) >= _least_estimate(percent, np.minimum(n[rough], n[s]))]
            # a link between two components is as good as all of theirs
            witness = [k for k in exact.tolist() if (pair := (min(c[s], c[k]), max(c[s], c[k]))) not in joined and not joined.add(pair)]
            found += [(min(ids[s], i), max(ids[s], i)) for i in (*ids[witness], *ids[rough])]
        return np.array(found, np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            made = compared(rows) if rows else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], names=["a", "b"])

        for part in (b.slice(i, TILE) for b in batches for i in range(0, b.num_rows, TILE)):
            for r in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (key := (r[0], r[2], r[3])) != now:
                    yield done()
                    now, rows = key, []
                rows.append(r)
        yield done()

    return work.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold 100 * intersection >= percent * union on full sets.

    ``a`` is shipped once for every ``MEMBERS`` of its partners, each ``b`` once a
    pair; a task streams through them and holds the sets of one ``a`` at a time.
    """
    spark = pairs.sparkSession
    dealt, heads = _dealt(pairs)
    heads = heads.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"))
    members = dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"))
    work = heads.unionByName(members).join(nodes.select("id", "text"), "id").select("a", "salt", "role", "id", "text")
    work = work.repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads_now = None, []
        for batch in batches:
            a, role, ids = (batch.column(i).to_numpy() for i in (0, 2, 3))
            buf, off, _ = text_buffers(batch.column(4))
            out = []
            for i, j in slices(off):
                words = words_in(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                for x, (h, first) in enumerate(shingles(words, j - i), i):
                    if a[x] != now:
                        now, heads_now = a[x], []
                    s = Shingled(words, h, first, x - i)
                    if role[x] == 0:
                        heads_now.append(s)
                    elif any((c := s.common(o)) and 100 * c >= percent * (len(h) + len(o.hashes) - c) for o in heads_now):
                        out.append((a[x], ids[x]))
            made = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    sig = stash(signatures(docs, id_col, text_col), "minhash")
    linked = sig.where("n > 0 and id is not null")
    # classes that share an id are one node; their rows stay apart here and meet in the graph
    reps = stash(linked.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2")), "minhash-sets")
    member = reps.select("id", F.posexplode("bands").alias("j", "h")).where("h <> 0")
    ends = stash(member.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "minhash-buckets")
    star = stash(member.join(ends, "h").select("h", "j", "id", "lo", "hi"), "minhash-members")
    # a hub is always ``a``: its partners can be dealt out
    pairs = star.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
    pairs = pairs.unionByName(star.where("id <> lo and id <> hi").select(F.col("hi").alias("a"), F.col("id").alias("b"))).distinct()
    sketch = lambda end: reps.select(F.col("id").alias(end), F.struct("n", "s1", "s2").alias(f"s{end}"))
    pairs, every = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS))), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HUB_SALTS - 1).cast("long")))
    apart = F.bit_count(F.col("sa.s1").bitwiseXOR(F.col("sb.s1"))) + F.bit_count(F.col("sa.s2").bitwiseXOR(F.col("sb.s2")))
    low, high = F.least("sa.n", "sb.n"), F.greatest("sa.n", "sb.n")
    fits = (low * 100 >= high * percent) & ((low < SKETCHED) | (apart <= SKETCH_BITS))
    pairs = pairs.join(sketch("b"), "b").join(sketch("a").withColumn("salt", every), ["a", "salt"]).where(fits).select("a", "b")

    texts = docs.select(whole_number_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    members = stash(star.select("id").distinct(), "minhash-ids")
    nodes = stash(_signed(_sieved(texts, members).join(members, "id", "left_semi")), "minhash-nodes")
    fitting = stash(pairs, "minhash-fitting")
    tested = stash(_estimated(fitting, nodes, percent), "minhash-pairs")
    links = stash(_verified(tested, nodes, percent), "minhash-links")
    discard(ends, members, fitting)
    parts = stash(connected_components(links), "minhash-components")
    named = lambda t: t.select(F.col("node").alias("id"), F.col("component").alias("c"))

    labelled = star.join(named(parts), "id", "left").select("h", "j", "id", F.coalesce("c", "id").alias("c"))
    mixed = stash(labelled.groupBy("h").agg(F.min("c").alias("lead"), F.max("c").alias("top")).where("lead < top").select("h", "lead"), "minhash-mixed")
    mixed_members = stash(labelled.join(mixed, "h"), "minhash-mixed-members")
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stash(_strays(mixed_members, nodes, percent).join(known, ["a", "b"], "left_anti"), "minhash-more-pairs")
    discard(star, tested, mixed, mixed_members)
    if more.limit(1).count():
        again = stash(_verified(more, nodes, percent), "minhash-more-links")
        old, parts = parts, stash(connected_components(links.unionByName(again)), "minhash-components")
        discard(again, old)
    discard(more, links, nodes)
    first = named(parts)

    words = reps.select("k1", "k2", "id").join(first, "id", "left").select("k1", "k2", F.coalesce("c", "id").alias("component_id"))
    light = sig.select("id", "n", "k1", "k2")
    single = light.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return light.where("n > 0 and id is not null").join(words, ["k1", "k2"]).select("id", "n", "component_id").unionByName(single).withColumnRenamed("n", "n_shingles")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` less those whose component has a smaller id."""
    found = near_duplicates(docs, id_col, text_col, percent)
    gone = stash(found.where("id <> component_id").select(F.col("id").alias("__tv_id")).distinct(), "minhash-gone")
    return docs.join(gone, docs[id_col] == gone["__tv_id"], "left_anti")
