"""Questions about points: ground, layers, coordinates, what is nearest, where a point lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import projection as P
from ..functions.shapes import Region
from ..sources.catalog import Terrain
from ..sources.synthetic import CELL, RAIL, ROAD, TILE
from . import windows

GROUND = "height double, depth double, water int, surface int, cover int, forest boolean"
#: Sides of the squares that nearest objects are looked for in, metres; each next one holds what the last did not decide.
RINGS = (500, 4000, 32_000, 256_000)
#: Features that go to every point in one array, at most.
FEW = 256


def cell_of(v: Column) -> Column:
    return F.floor(v / CELL).cast("long")


def ground(terrain: Terrain, points: DataFrame) -> DataFrame:
    """The points (id, n, e, ...) with height, depth, water, surface, cover and forest; nulls off the terrain.

    A terrain with a closed form answers by it, exactly and without a join;
    another one by its raster: bilinear height, the cell's own codes.
    """
    if terrain.form is None:
        cells = layer_at(terrain, points, ["water", "surface", "cover"])
        flat = bilinear_at(terrain, cells)
        as_int = {c: F.col(c).cast("int") for c in ("water", "surface", "cover")}
        return flat.withColumns({**as_int, "depth": F.lit(None).cast("double"), "forest": F.col("cover") == 3}).select(*points.columns, *(f.split()[0] for f in GROUND.split(", ")))
    form, at = terrain.form, (points.columns.index("n"), points.columns.index("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = form.ground(*(b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at))
            off = ~g["on"]
            cols = [pa.array(g["height"], mask=off), pa.array(g["depth"], mask=off | np.isnan(g["depth"]))]
            cols += [pa.array(g[k].astype(np.int32), mask=off) for k in ("water", "surface", "cover")] + [pa.array(g["forest"], mask=off)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(f.split()[0] for f in GROUND.split(", "))])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields), GROUND])
    return points.mapInArrow(run, schema)


def layer_at(terrain: Terrain, points: DataFrame, names: list[str]) -> DataFrame:
    """The points with the named layers of the cells that hold them."""
    keyed = points.withColumns({"r": cell_of(F.col("n")), "c": cell_of(F.col("e"))})
    wanted = keyed.select(F.floor(F.col("r") / TILE).cast("int").alias("tile_r"), F.floor(F.col("c") / TILE).cast("int").alias("tile_c"))
    return keyed.join(windows.layer_cells(terrain, names, wanted), ["r", "c"], "left").drop("r", "c")


def bilinear_at(terrain: Terrain, points: DataFrame, name: str = "height") -> DataFrame:
    """The points with the raster height between the four cell centres around them; null where one is missing."""
    at = lambda v: F.col(v) / CELL - 0.5
    keyed = points.withColumns({"__r": F.floor(at("n")).cast("long"), "__c": F.floor(at("e")).cast("long"), "__key": F.monotonically_increasing_id()})
    corners = keyed.select("__key", F.col("n"), F.col("e"), "__r", "__c", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("k"))
    fr, fc = at("n") - F.col("__r"), at("e") - F.col("__c")
    weight = F.when(F.col("k.a") == 1, fr).otherwise(1 - fr) * F.when(F.col("k.b") == 1, fc).otherwise(1 - fc)
    corners = corners.select("__key", (F.col("__r") + F.col("k.a")).alias("r"), (F.col("__c") + F.col("k.b")).alias("c"), weight.alias("weight"))
    wanted = corners.select(F.floor(F.col("r") / TILE).cast("int").alias("tile_r"), F.floor(F.col("c") / TILE).cast("int").alias("tile_c"))
    cells = windows.layer_cells(terrain, ["height"], wanted)
    found = corners.join(cells, ["r", "c"]).groupBy("__key").agg(F.sum(F.col("weight") * F.col("height")).alias(name), F.count("height").alias("known"))
    return keyed.join(found.where("known = 4"), "__key", "left").drop("__key", "__r", "__c", "known")


def sample(terrain: Terrain, points: DataFrame, names: list[str]) -> DataFrame:
    """The points with named layers: height and depth exact, the others of the cell."""
    own = [n for n in names if n in ("height", "depth")]
    rest = [n for n in names if n not in own and n not in windows.HORIZON_LAYERS]
    out = points
    if own:
        known = ground(terrain, points)
        out = known.select(*points.columns, *own)
    if rest:
        out = layer_at(terrain, out, rest)
    return out.select(*points.columns, *(n for n in names if n in own or n in rest))


def lattice(terrain: Terrain, region: Region, step: float, most: int) -> DataFrame:
    """Points (n, e) of a region every ``step`` metres from its south-west corner; more than ``most`` are an error, never cut."""
    if not step > 0:
        raise ValueError("the step must be positive")
    s, w, t, r = region.bounds()
    count = lambda low, high: int((high - low) / step + 1e-9) + 1
    at = lambda low: F.lit(float(low)) + F.col("id") * F.lit(float(step))
    spark = terrain.spark
    out = spark.range(count(s, t)).select(at(s).alias("n")).join(spark.range(count(w, r)).select(at(w).alias("e"))).where(region.condition(F.col("n"), F.col("e")))
    if most and out.limit(most + 1).count() > most:
        raise ValueError(f"the region holds more than {most} points; take a greater step")
    return out


def sample_region(terrain: Terrain, region: Region, step: float, names: list[str], most: int = 10_000) -> DataFrame:
    """Layers on a lattice of a region: height bilinear, the others of the cell."""
    points = lattice(terrain, region, step, most)
    rest = [n for n in names if n != "height"]
    out = layer_at(terrain, points, rest) if rest else points
    return bilinear_at(terrain, out).select("n", "e", *names) if "height" in names else out


def geo(points: DataFrame) -> DataFrame:
    """Latitude, longitude and grid reference of each point, and the way back to metres."""
    m = P.Staged(points)
    lat, lon = P.latlon(F.col("n"), F.col("e"), m=m)
    x, z = P.Mercator().forward(lat, lon, m)
    return m.done(lat=lat, lon=lon, mgrs=P.mgrs(lat, lon, m), back_n=x - P.ORIGIN[0], back_e=z - P.ORIGIN[1])


# --- nearest


def _few(features: DataFrame) -> bool:
    return features.limit(FEW + 1).count() <= FEW


def _within_one_row(points: DataFrame, features: DataFrame, n: int, found) -> DataFrame:
    """The n least of ``found(feature)``, a struct that begins with its distance, for every point.

    ``features`` has ``FEW`` rows at most: they travel as one array, so points are
    neither shuffled nor multiplied.
    """
    held = features.agg(F.collect_list(F.struct(*features.columns)).alias("__features"))
    every = F.transform("__features", found)
    best = F.array(F.array_min(every)) if n == 1 else F.slice(F.array_sort(every), 1, n)
    out = points.join(F.broadcast(held)).select("id", "n", "e", F.posexplode(best).alias("rnk", "b"))
    return out.where("b is not null").select("id", "n", "e", (F.col("rnk") + 1).alias("rnk"), "b.*")


def nearest_rows(points: DataFrame, features: DataFrame, n: int, ties: list[str]) -> DataFrame:
    """The n nearest features (fn, fe, ...) of each point (id, n, e) with ``distance`` and ``rnk``.

    A table of few features goes to the points whole.  Else points and features
    meet by square: a point looks into the 3 x 3 squares around it, and asks again
    with larger squares where fewer than n features lie within one square's side,
    which is as far as the 3 x 3 are complete.
    """
    if _few(features):
        dn, de = lambda f: F.col("n") - f["fn"], lambda f: F.col("e") - f["fe"]
        rest = [c for c in features.columns if c not in ties]
        found = lambda f: F.struct((dn(f) * dn(f) + de(f) * de(f)).alias("d2"), *(f[t].alias(t) for t in ties), *(f[c].alias(c) for c in rest))
        return _within_one_row(points, features, n, found).withColumn("distance", F.sqrt("d2")).drop("d2")
    out, left = None, points.select("id", "n", "e")
    for k, side in enumerate(RINGS):
        near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        square = lambda v: F.floor(F.col(v) / side).cast("long")  # noqa: B023, E731
        asked = left.withColumn("q", near).withColumns({"qr": square("n") + F.col("q.a"), "qc": square("e") + F.col("q.b")}).drop("q")
        placed = features.withColumns({"qr": square("fn"), "qc": square("fe")})
        d2 = (F.col("n") - F.col("fn")) * (F.col("n") - F.col("fn")) + (F.col("e") - F.col("fe")) * (F.col("e") - F.col("fe"))
        found = asked.join(placed, ["qr", "qc"]).withColumn("distance", F.sqrt(d2))
        last = k + 1 == len(RINGS)
        if not last:
            found = found.where(F.col("distance") <= side)
        ranked = found.withColumn("rnk", F.row_number().over(Window.partitionBy("id").orderBy(d2, *ties))).where(F.col("rnk") <= n).drop("qr", "qc")
        if last:
            return ranked if out is None else out.unionByName(ranked)
        full = ranked.groupBy("id").agg(F.count("*").alias("found")).where(F.col("found") == n).select("id")
        done = ranked.join(full, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = left.join(full, "id", "left_anti")
    return out


def nearest_segments(points: DataFrame, segments: DataFrame, n: int = 1) -> DataFrame:
    """The n nearest lines (line, ord) of each point, by their segments (n1, e1, n2, e2): the closest point and its share along.

    Few segments go to the points whole; else a segment is entered in every square
    that it meets.
    """
    if _few(segments):

        def found(f: Column) -> Column:
            dn, de = f["n2"] - f["n1"], f["e2"] - f["e1"]
            size = dn * dn + de * de
            t = F.when(size > 0, F.least(F.greatest(((F.col("n") - f["n1"]) * dn + (F.col("e") - f["e1"]) * de) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
            at = f["n1"] + t * dn, f["e1"] + t * de
            gap = F.sqrt((F.col("n") - at[0]) * (F.col("n") - at[0]) + (F.col("e") - at[1]) * (F.col("e") - at[1]))
            return F.struct(gap.alias("distance"), f["line"].alias("line"), f["ord"].alias("ord"), at[0].alias("at_n"), at[1].alias("at_e"), t.alias("t"))

        if n == 1:
            return _within_one_row(points, segments, 1, found).drop("n", "e")
        each = _within_one_row(points, segments, FEW, found).groupBy("id", "line").agg(F.min(F.struct("distance", "ord", "at_n", "at_e", "t")).alias("b")).select("id", "line", "b.*")
        return each.withColumn("rnk", F.row_number().over(Window.partitionBy("id").orderBy("distance", "line"))).where(F.col("rnk") <= n)
    out, left = None, points.select("id", "n", "e")
    for k, side in enumerate(RINGS[1:]):
        low = lambda a, b: F.floor(F.least(a, b) / side).cast("long")  # noqa: B023, E731
        high = lambda a, b: F.floor(F.greatest(a, b) / side).cast("long")  # noqa: B023, E731
        placed = segments.withColumn("qr", F.explode(F.sequence(low("n1", "n2"), high("n1", "n2")))).withColumn("qc", F.explode(F.sequence(low("e1", "e2"), high("e1", "e2"))))
        near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        asked = left.withColumn("q", near).withColumns({"qr": F.floor(F.col("n") / side).cast("long") + F.col("q.a"), "qc": F.floor(F.col("e") / side).cast("long") + F.col("q.b")}).drop("q")
        dn, de = F.col("n2") - F.col("n1"), F.col("e2") - F.col("e1")
        size = dn * dn + de * de
        t = F.when(size > 0, F.least(F.greatest(((F.col("n") - F.col("n1")) * dn + (F.col("e") - F.col("e1")) * de) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        found = asked.join(placed, ["qr", "qc"]).withColumn("t", t).withColumns({"at_n": F.col("n1") + F.col("t") * dn, "at_e": F.col("e1") + F.col("t") * de})
        found = found.withColumn("distance", F.sqrt((F.col("n") - F.col("at_n")) * (F.col("n") - F.col("at_n")) + (F.col("e") - F.col("at_e")) * (F.col("e") - F.col("at_e"))))
        last = k + 2 == len(RINGS)
        if not last:
            found = found.where(F.col("distance") <= side)
        best = found.groupBy("id", "line").agg(F.min(F.struct("distance", "ord", "at_n", "at_e", "t")).alias("b")).select("id", "line", "b.*")
        ranked = best.withColumn("rnk", F.row_number().over(Window.partitionBy("id").orderBy("distance", "line"))).where(F.col("rnk") <= n)
        if last:
            return ranked if out is None else out.unionByName(ranked)
        full = ranked.groupBy("id").agg(F.count("*").alias("found")).where(F.col("found") == n).select("id")
        done = ranked.join(full, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = left.join(full, "id", "left_anti")
    return out


def edge_segments(terrain: Terrain, kind: int) -> DataFrame:
    """(line, ord, n1, e1, n2, e2, before): the segments of a network's edges and how far along the edge they begin."""
    # points on a straight line between their neighbours add nothing
    w = Window.partitionBy("line").orderBy("ord")
    p = terrain.table("edges").where(F.col("kind") == kind).select(F.col("edge_id").alias("line"), F.posexplode("points").alias("ord", "p")).select("line", "ord", "p.n", "p.e")
    p = p.withColumns({"pn": F.lag("n").over(w), "pe": F.lag("e").over(w), "qn": F.lead("n").over(w), "qe": F.lead("e").over(w)})
    straight = ((F.col("n") - F.col("pn")) * (F.col("qe") - F.col("e")) - (F.col("e") - F.col("pe")) * (F.col("qn") - F.col("n")) == 0) & ((F.col("n") - F.col("pn")) * (F.col("qn") - F.col("n")) + (F.col("e") - F.col("pe")) * (F.col("qe") - F.col("e")) > 0)
    p = p.where(~F.coalesce(straight, F.lit(False))).select("line", "ord", "n", "e")
    flat = p.select("line", "ord", F.col("n").alias("n1"), F.col("e").alias("e1"), F.lead("n").over(w).alias("n2"), F.lead("e").over(w).alias("e2")).where("n2 is not null")
    size = F.sqrt((F.col("n2") - F.col("n1")) * (F.col("n2") - F.col("n1")) + (F.col("e2") - F.col("e1")) * (F.col("e2") - F.col("e1")))
    return flat.withColumn("before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


KINDS = ("scenery", "airdrome", "town", "beacon", "node", "road", "rail", "place")


def nearest(terrain: Terrain, points: DataFrame, kind: str, n: int = 1, of_class: str | None = None, places: DataFrame | None = None) -> DataFrame:
    """The n nearest things of a kind of each point (id, n, e): rnk, what, distance and where.

    Ties go by table or edge order, of scenery by id as text.
    """
    if kind not in KINDS or not 1 <= n <= 50:
        raise ValueError(f"a kind is one of {', '.join(KINDS)} and n 1 to 50")
    if kind in ("road", "rail"):
        found = nearest_segments(points, edge_segments(terrain, ROAD if kind == "road" else RAIL), n)
        return found.select("id", "rnk", F.col("line").cast("string").alias("what"), "distance", "at_n", "at_e")
    plain = {
        "airdrome": ("airdromes", "airdrome_id", "display_name"),
        "town": ("towns", "ord", "name"),
        "beacon": ("beacons", "callsign", "callsign"),
        "node": ("nodes", "node_id", "name"),
    }
    if kind == "scenery":
        features = terrain.objects().where(F.col("class") == of_class if of_class else F.lit(True)).select(F.col("n").alias("fn"), F.col("e").alias("fe"), F.col("id").cast("string").alias("tie"), F.col("id").cast("string").alias("what"))
    elif kind == "place":
        features = places.select(F.col("n").alias("fn"), F.col("e").alias("fe"), F.col("place").alias("tie"), F.col("place").cast("string").alias("what"))
    elif kind == "node":
        sides = F.explode(F.array(F.struct(F.col("red_n").alias("fn"), F.col("red_e").alias("fe")), F.struct(F.col("blue_n").alias("fn"), F.col("blue_e").alias("fe"))))
        features = terrain.table("nodes").select(F.col("node_id").alias("tie"), F.col("name").alias("what"), sides.alias("s")).select("tie", "what", "s.fn", "s.fe")
    else:
        table, tie, name = plain[kind]
        features = terrain.table(table).select(F.col("n").alias("fn"), F.col("e").alias("fe"), F.col(tie).alias("tie"), F.col(name).alias("what"))
    found = nearest_rows(points, features, n, ["tie"])
    return found.select("id", "rnk", "what", "distance", F.col("fn").alias("at_n"), F.col("fe").alias("at_e"))


def town_words(town: Column, distance: Column, degrees: Column) -> Column:
    """Like ``3 km NE of town_1``, ``400 m S of town_1`` or ``at town_1``."""
    whole = lambda v: F.floor(v + 0.5).cast("long").cast("string")
    side = F.concat(P.compass(degrees), F.lit(" of "), town)
    metres = (F.floor(distance / 100 + 0.5).cast("long") * 100).cast("string")
    return F.when(distance < 50, F.concat(F.lit("at "), town)).when(distance >= 950, F.concat(whole(distance / 1000), F.lit(" km "), side)).otherwise(F.concat(metres, F.lit(" m "), side))


def point_info(terrain: Terrain, points: DataFrame) -> DataFrame:
    """All that is known of each point (id, n, e): ground, slope, aspect, town in words, road, airfield, coordinates."""
    base = points.select("id", "n", "e")
    known = layer_at(terrain, ground(terrain, base), ["slope", "aspect"])
    town = nearest(terrain, base, "town").select("id", F.col("what").alias("town"), F.col("distance").alias("town_distance"), F.col("at_n").alias("tn"), F.col("at_e").alias("te"))
    road = nearest(terrain, base, "road").select("id", F.col("what").alias("road"), F.col("distance").alias("road_distance"))
    field = nearest(terrain, base, "airdrome").select("id", F.col("what").alias("airdrome"), F.col("distance").alias("airdrome_distance"))
    out = known.join(town, "id", "left").join(road, "id", "left").join(field, "id", "left")
    m = P.Staged(out)
    lat, lon = P.latlon(F.col("n"), F.col("e"), m=m)
    # the bearing is read from the town to the point
    town_bearing = m.keep(P.bearing(F.col("n") - F.col("tn"), F.col("e") - F.col("te"), m))
    words = town_words(F.col("town"), F.col("town_distance"), town_bearing)
    return m.done(lat=lat, lon=lon, mgrs=P.mgrs(lat, lon, m), town_bearing=town_bearing, description=words).drop("tn", "te")
