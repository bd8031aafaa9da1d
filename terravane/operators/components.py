"""Connected components of a link table by alternating star contractions.

A table of at most ``FEW`` links is settled in one task instead.

Each round makes two passes: every node first hands its larger neighbours to
its least one, then hands its smaller ones there.  Degrees are never gathered
into one task: minima are combined before the shuffle and the joins on a hub
are plain equi-joins, which adaptive execution splits when they are skewed.
The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cluster import shared_dir

#: Links that one task joins, at most.
FEW = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((find(u), find(v)))
            root[high] = low
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least id reachable, for every node with a link.

    ``edges`` has two BIGINT columns; order, repeats and self-links do not
    matter.  Null ends are ignored.  An empty table gives an empty result.
    """
    shared_dir(edges.sparkSession)
    now = (
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    seen = _state(now)
    if seen[0] <= FEW:
        return now.coalesce(1).mapInArrow(_joined, "node long, component long")
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u move to u's least neighbour (or u itself)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: now every row has u > v
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = small.checkpoint()
        then, seen = seen, _state(now)
        if then == seen:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
