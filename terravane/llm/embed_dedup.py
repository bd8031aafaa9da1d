"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors u, v have cosine >= t exactly if |u - v|^2 <= 2 (1 - t).  After a
random rotation the dimensions are dealt into blocks of ``BLOCK``; in at least
one block of k of d dimensions the squared distance is at most 2 (1 - t) k / d.
Each block is therefore range-joined under its share of the budget, and the
union of the candidates is verified by the exact cosine.

A block's range join is dealt out by cells two radii wide along the block's
first dimension: every vector is at home in one cell and probes the cells that
its ball meets, so a pair meets once a block (the smaller id at home).  Cells are
cut into tiles of bounded size by hash; inside a tile, median splits discard
what lies out of range.  A pair counts in the first block that admits it, so
tiles emit numbers of links and a spanning forest, never the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing; vectors of different length do not link; equal
vectors are joined before the search; rows that share an id are vectors of their
own; a row without an id links with nothing, has no component and is kept; ids
must be whole numbers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cluster import ship
from .common import partitions, stash, whole_number_id
from .components import connected_components

BLOCK = 16
#: Rows of one kind in a tile at most.
TILE = 32_768
_SLACK = 1e-9


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_000 + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, d)) for i in range(0, d, BLOCK)]


def unpacked(raw: list[bytes], d: int) -> np.ndarray:
    width = len(raw[0]) // d
    return np.frombuffer(b"".join(raw), f"<f{width}").reshape(-1, d).astype(np.float64)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """A vector whose squared length is a normal number: very large or small ones are moved by a power of two."""
    with np.errstate(over="ignore", under="ignore"):
        if 1e-60 < float(x @ x) < 1e60:
            return x
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, d, raw): the components of usable vectors as bytes, of the width they have; d is 0 for the others."""
    ship(vectors.sparkSession)
    wide = np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, raw = [], []
            for v in batch.column(1):
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
                size.append(len(x) if ok else 0)
                raw.append(scaled(x).astype(wide).tobytes() if ok else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], names=["id", "d", "raw"])

    return vectors.select(whole_number_id(vectors, id_col).alias("id"), F.col(f"`{vec_col}`").alias("v")).mapInArrow(run, "id long, d int, raw binary")


def _placed(classes: DataFrame, threshold: float) -> DataFrame:
    """A row for each block: home 0 in its cell, 1 in every cell that the ball meets."""
    budget = 2 * (1 - threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in np.unique(batch.column(1).to_numpy()):
                part = batch.filter(pa.array(batch.column(1).to_numpy() == d))
                x = _unit(unpacked(part.column(2).to_pylist(), d)) @ rotation(d)
                for b, s in enumerate(blocks(d)):
                    r = np.sqrt(budget * (s.stop - s.start) / d) * (1 + 1e-6) + 1e-9
                    first = x[:, s.start] / (2 * r)
                    home = np.floor(first).astype(np.int64)
                    low, high = np.floor(first - 0.5).astype(np.int64), np.floor(first + 0.5).astype(np.int64)
                    for role, cell, rows in ((0, home, np.arange(len(x))), (1, low, np.arange(len(x))), (1, high, np.flatnonzero(high > low))):
                        n = len(rows)
                        cols = [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cell[rows].astype(np.int32)), pa.array(np.full(n, role, np.int32))]
                        kept = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*cols, kept.column(0), kept.column(3), kept.column(2)], names=["d", "b", "cell", "role", "id", "n", "raw"])

    return classes.select("id", "d", "raw", "n").mapInArrow(run, "d int, b int, cell int, role int, id long, n long, raw binary")


def in_range(home: np.ndarray, probe: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, probe) whose points lie within r, with a little float32 slack."""
    stack = [(np.arange(len(home)), np.arange(len(probe)), 0)]
    limit, k = np.float32(r * r + 1e-4 * r), home.shape[1]
    while stack:
        h, p, depth = stack.pop()
        if not len(h) or not len(p):
            continue
        if len(h) > 192 and len(p) > 192 and depth < 4 * k:
            dim = (depth + 1) % k
            mid = np.median(home[h, dim])
            left = home[h, dim] <= mid
            if left.any() and not left.all():
                stack.append((h[left], p[probe[p, dim] <= mid + r + 1e-6], depth + 1))
                stack.append((h[~left], p[probe[p, dim] >= mid - r - 1e-6], depth + 1))
                continue
            if depth < k:
                stack.append((h, p, depth + 1))
                continue
        a = home[h]
        aa = np.einsum("ij,ij->i", a, a)
        for i in range(0, len(p), 4096):
            q = p[i : i + 4096]
            c = probe[q]
            near = np.nonzero(aa[:, None] - 2 * (a @ c.T) <= limit - np.einsum("ij,ij->i", c, c))
            if len(near[0]):
                yield h[near[0]], q[near[1]]


def join_tile(d: int, b: int, home: tuple[np.ndarray, ...], probe: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, root): of every vector with a link counted here, links by weight and a forest of them.

    ``home`` and ``probe`` are (ids, weights, raw components).
    """
    (hi, hw, hx), (pi, pw, px) = home, probe
    q, cut = rotation(d), blocks(d)
    share = [2 * (1 - threshold) * (s.stop - s.start) / d * (1 + _SLACK) + 1e-12 for s in cut]
    hu, pu = _unit(hx), _unit(px)
    hr, pr = hu @ q, pu @ q
    s = cut[b]
    pairs = []
    for h, p in in_range(hr[:, s].astype(np.float32), pr[:, s].astype(np.float32), share[b] ** 0.5):
        keep = hi[h] < pi[p]
        h, p = h[keep], p[keep]
        for i in range(0, len(h), 20_000):
            x, y = h[i : i + 20_000], p[i : i + 20_000]
            ok = np.einsum("ij,ij->i", hu[x], pu[y]) >= threshold
            x, y = x[ok], y[ok]
            gap = (hr[x] - pr[y]) ** 2
            fits = np.stack([gap[:, c].sum(1) <= m for c, m in zip(cut, share, strict=True)], 1) if len(x) else np.zeros((0, len(cut)), bool)
            first = fits.argmax(1) == b
            pairs.append((x[first], y[first]))
    if not pairs or not sum(len(x) for x, _ in pairs):
        z = np.zeros(0, np.int64)
        return z, z, z
    x, y = (np.concatenate(v) for v in zip(*pairs, strict=True))
    ids, inverse = np.unique(np.concatenate([hi[x], pi[y]]), return_inverse=True)
    u, v = inverse[: len(x)], inverse[len(x) :]
    links = np.bincount(u, pw[y], len(ids)) + np.bincount(v, hw[x], len(ids))
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return ids, links.astype(np.int64), ids[root]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id) for every row of ``vectors``."""
    spark = vectors.sparkSession
    rows = stash(packed(vectors, id_col, vec_col), "vectors")
    good = rows.where("d > 0 and id is not null")
    # ``id`` is a class's own number from here on, ``low`` the least id of its vectors
    classes = good.groupBy("d", "raw").agg(F.min("id").alias("low"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    classes = stash(classes, "vector-classes")
    placed = stash(_placed(classes, threshold), "vector-places")
    # one row for each cell: their number follows the blocks and the radius, not the vectors
    sizes = placed.groupBy("d", "b", "cell").agg(F.sum(1 - F.col("role")).alias("homes"), F.sum("role").alias("probes")).where("homes > 0 and probes > 0")
    total = classes.count()
    most = max(2048, min(TILE, int(total * 24 / (4 * partitions(spark)) + 1)))
    tiles = sizes.select("d", "b", "cell", F.ceil(F.col("homes") / most).alias("hs"), F.ceil(F.col("probes") / (2 * most)).alias("ps"))
    # a coordinate of a unit vector lies in -1..1: a block has at most 1 / r + 3 cells, whatever the table holds
    sized = placed.join(F.broadcast(tiles), ["d", "b", "cell"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    one = lambda c: F.array(c)
    i = F.explode(F.when(F.col("role") == 0, one(own("hs"))).otherwise(every("hs")))
    j = F.explode(F.when(F.col("role") == 1, one(own("ps"))).otherwise(every("ps")))
    work = sized.withColumn("i", i).withColumn("j", j).select("d", "b", "cell", "i", "j", "role", "id", "n", "raw")
    work = work.repartition(partitions(spark), "d", "b", "cell", "i", "j").sortWithinPartitions("d", "b", "cell", "i", "j", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            d, b = t["d"][0].as_py(), t["b"][0].as_py()
            role, ids, n = (t[c].to_numpy() for c in ("role", "id", "n"))
            x = unpacked(t["raw"].to_pylist(), d)
            h, p = role == 0, role == 1
            got = join_tile(d, b, (ids[h], n[h], x[h]), (ids[p], n[p], x[p]), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["id", "links", "root"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(5)], 1)
            turn = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, e in zip([0, *turn], [*turn, len(keys)], strict=True):
                if e > a:
                    if (key := tuple(keys[a])) != now:
                        yield from done()
                        now, held = key, []
                    held.append(batch.slice(a, e - a))
        yield from done()

    found = stash(work.mapInArrow(run, "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("id <> root"), "id", "root").withColumnRenamed("node", "id")
    known = classes.join(links, "id", "left").join(parts, "id", "left").select("d", "raw", "low", "n", "links", F.coalesce("component", "id").alias("c"))
    known = known.join(known.groupBy("c").agg(F.min("low").alias("component_id")), "c")
    known = known.select("d", "raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.where("not (d > 0 and id is not null)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.join(known, ["d", "raw"]).select("id", "n_links", "component_id").unionByName(alone)
