"""A mesh of triangles: ground at points, stretches under lines, exact line of sight.

Triangles are rows (tri, rank, n1, e1, h1, n2, e2, h2, n3, e3, h3); where several lie over a place the
one of higher rank is the ground.  Points, lines and triangles meet by an equi-join
on the squares that they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.raster import TOLERANCE
from ..sources.catalog import Terrain
from ..sources.synthetic import CELL

#: Side of the squares that things meet in, metres.
SQUARE = 200.0
#: Share of a triangle's size by which a point on its edge may lie outside.
EDGE = 1e-9


def from_cells(terrain: Terrain, rows: tuple[int, int], cols: tuple[int, int], rank: int = 0) -> DataFrame:
    """Two triangles between every four neighbouring cell centres of a window."""
    cells = terrain.grid((rows[0], rows[1] + 1), (cols[0], cols[1] + 1)).select("r", "c", "n", "e", F.col("h").cast("double").alias("h"))
    east = Window.partitionBy("r").orderBy("c")
    north = Window.partitionBy("c").orderBy("r")
    quads = cells.withColumn("he", F.lead("h").over(east)).withColumns({"hn": F.lead("h").over(north), "hne": F.lead("he").over(north)}).where("h + he + hn + hne is not null")
    n2, e2 = F.col("n") + CELL, F.col("e") + CELL
    corner = lambda n, e, h: (n, e, F.col(h))
    sw, se, nw, ne = corner(F.col("n"), F.col("e"), "h"), corner(F.col("n"), e2, "he"), corner(n2, F.col("e"), "hn"), corner(n2, e2, "hne")
    each = lambda half, *k: F.struct(F.lit(half).alias("half"), *(v.alias(f"{name}{i}") for i, p in enumerate(k, 1) for name, v in zip("neh", p, strict=True)))
    both = quads.select("r", "c", F.explode(F.array(each(0, sw, se, nw), each(1, ne, nw, se))).alias("t"))
    return both.select(((F.col("r") * (1 << 24) + F.col("c")) * 2 + F.col("t.half")).alias("tri"), F.lit(rank).cast("long").alias("rank"), *(f"t.{name}{i}" for i in (1, 2, 3) for name in "neh"))


def _squares(low_n: Column, high_n: Column, low_e: Column, high_e: Column) -> tuple[Column, Column]:
    span = lambda a, b: F.explode(F.sequence(F.floor(a / SQUARE).cast("long"), F.floor(b / SQUARE).cast("long")))
    return span(low_n, high_n), span(low_e, high_e)


def _placed(triangles: DataFrame) -> DataFrame:
    n, e = _squares(F.least("n1", "n2", "n3"), F.greatest("n1", "n2", "n3"), F.least("e1", "e2", "e3"), F.greatest("e1", "e2", "e3"))
    return triangles.withColumn("qr", n).withColumn("qc", e)


def _area(an: Column, ae: Column, bn: Column, be: Column, cn: Column, ce: Column) -> Column:
    return (bn - an) * (ce - ae) - (be - ae) * (cn - an)


def ground(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """The points (id, n, e) with the height and triangle of highest rank over them, ties to the higher triangle id; null off the mesh."""
    c = F.col
    keyed = points.select("id", "n", "e").withColumns({"qr": F.floor(c("n") / SQUARE).cast("long"), "qc": F.floor(c("e") / SQUARE).cast("long")})
    whole = _area(c("n1"), c("e1"), c("n2"), c("e2"), c("n3"), c("e3"))
    met = keyed.join(_placed(triangles), ["qr", "qc"]).withColumn("whole", whole).where("whole <> 0")
    met = met.withColumns({"u": _area(c("n"), c("e"), c("n2"), c("e2"), c("n3"), c("e3")) / c("whole"), "v": _area(c("n1"), c("e1"), c("n"), c("e"), c("n3"), c("e3")) / c("whole")}).withColumn("w", 1 - c("u") - c("v"))
    met = met.where(F.least("u", "v", "w") >= -EDGE)
    best = met.groupBy("id").agg(F.max(F.struct("rank", "tri", (c("u") * c("h1") + c("v") * c("h2") + c("w") * c("h3")).alias("height"))).alias("b"))
    return points.join(best.select("id", c("b.height").alias("height"), c("b.tri").alias("tri")), "id", "left")


def along(triangles: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, tri, rank, t0, t1, g0, g1): the stretches of lines (id, n1, e1, n2, e2) over triangles, with the heights at their ends."""
    c = F.col
    own = lines.select("id", c("n1").alias("an"), c("e1").alias("ae"), c("n2").alias("bn"), c("e2").alias("be"))
    qn, qe = _squares(F.least("an", "bn"), F.greatest("an", "bn"), F.least("ae", "be"), F.greatest("ae", "be"))
    boxed = own.withColumn("qr", qn).withColumn("qc", qe)
    # squares of the line's box that the line itself comes near
    across = F.abs((c("qr") * SQUARE + SQUARE / 2 - c("an")) * (c("be") - c("ae")) - (c("qc") * SQUARE + SQUARE / 2 - c("ae")) * (c("bn") - c("an")))
    boxed = boxed.where(across <= SQUARE * F.sqrt((c("bn") - c("an")) * (c("bn") - c("an")) + (c("be") - c("ae")) * (c("be") - c("ae"))))
    met = boxed.join(_placed(triangles), ["qr", "qc"]).drop("qr", "qc").dropDuplicates(["id", "tri"])
    met = met.withColumn("whole", _area(c("n1"), c("e1"), c("n2"), c("e2"), c("n3"), c("e3"))).where("whole <> 0")
    weight = lambda n, e, i, j: _area(n, e, c(f"n{i}"), c(f"e{i}"), c(f"n{j}"), c(f"e{j}")) / c("whole")
    sides = {"u": (2, 3), "v": (3, 1), "w": (1, 2)}
    met = met.withColumns({f"{k}{end}": weight(c(f"{p}n"), c(f"{p}e"), i, j) for k, (i, j) in sides.items() for end, p in ((0, "a"), (1, "b"))})
    # each weight is linear along the line and must not be negative
    enter = [F.when(c(f"{k}1") > c(f"{k}0"), -c(f"{k}0") / (c(f"{k}1") - c(f"{k}0"))).otherwise(0.0) for k in sides]
    leave = [F.when(c(f"{k}1") < c(f"{k}0"), c(f"{k}0") / (c(f"{k}0") - c(f"{k}1"))).otherwise(1.0) for k in sides]
    still = [(c(f"{k}1") != c(f"{k}0")) | (c(f"{k}0") >= -EDGE) for k in sides]
    met = met.where(still[0] & still[1] & still[2]).withColumns({"t0": F.greatest(F.lit(0.0), *enter), "t1": F.least(F.lit(1.0), *leave)}).where("t1 > t0")
    height = lambda t: sum(((c(f"{k}0") + (c(f"{k}1") - c(f"{k}0")) * c(t)) * c(h) for k, h in (("u", "h1"), ("v", "h2"), ("w", "h3"))), F.lit(0.0))
    return met.select("id", "tri", "rank", "t0", "t1", height("t0").alias("g0"), height("t1").alias("g1"))


def spans(pieces: DataFrame) -> DataFrame:
    """(id, s, e, gs, ge): between neighbouring ends of pieces, the ground of the piece of highest rank; gaps are left out."""
    c = F.col
    marks = pieces.select("id", c("t0").alias("s")).union(pieces.select("id", "t1")).distinct()
    steps = marks.withColumn("e", F.lead("s").over(Window.partitionBy("id").orderBy("s"))).where("e > s").withColumn("m", (c("s") + c("e")) / 2)
    over = steps.join(pieces, "id").where("m between t0 and t1")
    at = lambda t: c("g0") + (c(t) - c("t0")) / (c("t1") - c("t0")) * (c("g1") - c("g0"))
    best = over.groupBy("id", "s", "e").agg(F.max(F.struct("rank", "tri", at("s").alias("gs"), at("e").alias("ge"))).alias("b"))
    return best.select("id", "s", "e", "b.gs", "b.ge")


def visible(triangles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, visible, clearance, block_n, block_e, block_h) of pairs (id, n1, e1, alt1, n2, e2, alt2), altitudes of both ends; uncovered stretches never block."""
    c = F.col
    under = spans(along(triangles, pairs)).join(pairs, "id")
    line = lambda t: c("alt1") + (c("alt2") - c("alt1")) * c(t)
    gaps = under.withColumns({"a": line("s") - c("gs"), "b": line("e") - c("ge")})
    first = F.when(c("a") < -TOLERANCE, c("s")).otherwise(c("s") + (c("e") - c("s")) * (c("a") + TOLERANCE) / (c("a") - c("b")))
    hit = F.when(F.least("a", "b") < -TOLERANCE, F.struct(first.alias("t"), (c("gs") + (c("ge") - c("gs")) * (first - c("s")) / (c("e") - c("s"))).alias("h")))
    found = gaps.withColumn("hit", hit).groupBy("id").agg(F.min(F.least("a", "b")).alias("clearance"), F.min("hit").alias("hit"))
    out = pairs.join(found, "id", "left")
    at = lambda i: c(f"{i}1") + (c(f"{i}2") - c(f"{i}1")) * c("hit.t")
    return out.select("id", c("hit").isNull().alias("visible"), "clearance", at("n").alias("block_n"), at("e").alias("block_e"), c("hit.h").alias("block_h"))


def highest(triangles: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, height, t): the highest ground under each line and the share at which it is first met."""
    s = spans(along(triangles, lines))
    ends = s.select("id", F.explode(F.array(F.struct(F.col("gs").alias("height"), (-F.col("s")).alias("back")), F.struct(F.col("ge").alias("height"), (-F.col("e")).alias("back")))).alias("x"))
    return ends.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.height", (-F.col("x.back")).alias("t"))
