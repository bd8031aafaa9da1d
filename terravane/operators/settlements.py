"""Places: buildings joined across gaps, their size, form, names and ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..sources.catalog import Terrain
from ..sources.synthetic import CELL
from .components import connected_components
from .windows import arrow_type

# Fixed values, metres: the gap that still joins, the cap on a building's radius, how far a name reaches, the ground around a building.
GAP, RADIUS_CAP, NAME_REACH, GROUND = 200.0, 60.0, 1000.0, 100.0
# Least footprint and height of a building, metres a storey, buildings of a place.
FOOTPRINT, HEIGHT, STOREY, BUILDINGS = 60.0, 2.0, 3.0, 3
#: No two buildings farther apart than this link: a square's side.
SQUARE = GAP + 2 * RADIUS_CAP
# Families that stand apart from a town.
APART = ("farm", "outbuilding", "military")
SIZES = ("hamlet", "village", "large_village", "town", "city", "large_city")


def buildings(objects: DataFrame) -> DataFrame:
    """(id, n, e, radius, counts, floor) of the objects that take part in a place: houses count, industry only links."""
    w, d = F.abs("w"), F.abs("d")
    joins = (F.col("class") == "industrial") | ((F.col("class") == "building") & F.col("family").isNotNull() & ~F.col("family").isin(*APART))
    storeys = F.greatest(F.lit(1.0), F.floor(F.col("tall") / STOREY + 0.5))
    radius = F.least(F.greatest(w, d) / 2, F.lit(RADIUS_CAP))
    return objects.where(joins & (w * d >= FOOTPRINT) & (F.col("tall") >= HEIGHT)).select("id", "n", "e", radius.alias("radius"), (F.col("class") == "building").alias("counts"), (w * d * storeys).alias("floor"))


def _near(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """Every pair of rows whose (n, e) and (n2, e2) lie within ``side`` along both axes, and some beyond: an equi-join on squares."""
    square = lambda v: F.floor(F.col(v) / side).cast("long")
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    spread = right.withColumn("q", near).withColumns({"qr": square("n2") + F.col("q.a"), "qc": square("e2") + F.col("q.b")}).drop("q")
    return left.withColumns({"qr": square("n"), "qc": square("e")}).join(spread, ["qr", "qc"]).drop("qr", "qc")


def _gap() -> Column:
    dn, de = F.col("n") - F.col("n2"), F.col("e") - F.col("e2")
    return F.sqrt(dn * dn + de * de)


def links(built: DataFrame) -> DataFrame:
    """(a, b), a less than b: buildings whose circles leave a gap of at most ``GAP``."""
    other = built.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("e").alias("e2"), F.col("radius").alias("r2"))
    pairs = _near(built.select(F.col("id").alias("a"), "n", "e", "radius"), other, SQUARE)
    return pairs.where((F.col("a") < F.col("b")) & (_gap() <= GAP + F.col("radius") + F.col("r2"))).select("a", "b")


def members(terrain: Terrain) -> DataFrame:
    """The buildings with ``place``: the least id of a counting building of their group; groups of too few counting ones are left out."""
    built = buildings(terrain.objects())
    groups = connected_components(links(built)).select(F.col("node").alias("id"), F.col("component").alias("label"))
    held = built.join(groups, "id", "left").withColumn("label", F.coalesce("label", "id"))
    places = held.groupBy("label").agg(F.min(F.when(F.col("counts"), F.col("id"))).alias("place"), F.sum(F.col("counts").cast("int")).alias("counting")).where(F.col("counting") >= BUILDINGS)
    return held.join(places.select("label", "place"), "label").drop("label")


def names(terrain: Terrain, of: DataFrame) -> DataFrame:
    """(place, names): towns name the place with most counting buildings within reach, ties to the least id; most buildings first."""
    town = terrain.table("towns").select("ord", "name", F.col("n").alias("n2"), F.col("e").alias("e2"))
    votes = _near(of.where("counts").select("place", "n", "e"), town, NAME_REACH).where(_gap() <= NAME_REACH).groupBy("ord", "name", "place").agg(F.count("*").alias("votes"))
    best = votes.withColumn("rnk", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("votes"), "place"))).where("rnk = 1")
    return best.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "ord", "name"))), lambda x: x["name"]).alias("names"))


def size_class(count: Column, floor: Column) -> Column:
    return F.when(count < 50, "hamlet").when(count < 200, "village").when(floor >= 20e6, "large_city").when(floor >= 3e6, "city").when(floor >= 0.5e6, "town").otherwise("large_village")


def form_of(named: Column, count: Column, floor_per_hectare: Column) -> Column:
    return F.when(named > 1, "agglomeration").when((count >= 1000) & (floor_per_hectare < 2500), "dispersed").otherwise("compact")


def places(terrain: Terrain, of: DataFrame | None = None) -> DataFrame:
    """Every place: buildings, floor, centre, hectares, box of its whole group, names, size and form."""
    of = members(terrain) if of is None else of
    mine = F.when(F.col("counts"), F.lit(True))
    hectare = F.struct(F.floor(F.col("n") / 100), F.floor(F.col("e") / 100))
    per = of.groupBy("place").agg(
        F.count(mine).alias("buildings"),
        F.sum(F.when(F.col("counts"), F.col("floor"))).alias("floor_m2"),
        F.avg(F.when(F.col("counts"), F.col("n"))).alias("n"),
        F.avg(F.when(F.col("counts"), F.col("e"))).alias("e"),
        F.countDistinct(F.when(F.col("counts"), hectare)).alias("hectares"),
        F.min("n").alias("south"), F.min("e").alias("west"), F.max("n").alias("north"), F.max("e").alias("east"),
    )
    out = per.join(names(terrain, of), "place", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return out.withColumns({"size": size_class(F.col("buildings"), F.col("floor_m2")), "form": form_of(F.size("names"), F.col("buildings"), F.col("floor_m2") / F.col("hectares"))})


def towns(terrain: Terrain, region: S.Region | None = None, size: tuple[str, ...] = (), form: tuple[str, ...] = (), least_buildings: int = 0, sort: str = "buildings", limit: int = 50) -> DataFrame:
    """Places by a figure, greatest first, ties to the least id; ``matched`` counts those that fit before the limit."""
    if sort not in ("buildings", "floor_m2", "hectares") or not 1 <= limit <= 1000:
        raise ValueError("sort by buildings, floor_m2 or hectares, and take 1 to 1000")
    out = places(terrain)
    if region is not None:
        out = out.where(region.condition(F.col("n"), F.col("e")))
    if size:
        out = out.where(F.col("size").isin(*size))
    if form:
        out = out.where(F.col("form").isin(*form))
    out = out.where(F.col("buildings") >= least_buildings)
    matched = out.agg(F.count("*").alias("matched"))
    return out.orderBy(F.desc(sort), "place").limit(limit).join(F.broadcast(matched))


def ground_cells(of: DataFrame) -> DataFrame:
    """(place, r, c): cells whose centre lies within ``GROUND`` of a counting building's circle."""
    reach = F.col("radius") + GROUND
    span = lambda v: F.sequence(F.floor((F.col(v) - reach) / CELL).cast("long"), F.floor((F.col(v) + reach) / CELL).cast("long"))
    cells = of.where("counts").withColumn("r", F.explode(span("n"))).withColumn("c", F.explode(span("e")))
    dn, de = (F.col("r") + 0.5) * CELL - F.col("n"), (F.col("c") + 0.5) * CELL - F.col("e")
    return cells.where(F.sqrt(dn * dn + de * de) <= reach).select("place", "r", "c").distinct()


def place_at(of: DataFrame, points: DataFrame) -> DataFrame:
    """The points (id, n, e) with the place whose ground holds their cell, the least id where several do."""
    cells = ground_cells(of).groupBy("r", "c").agg(F.min("place").alias("place"))
    keyed = points.withColumns({"r": F.floor(F.col("n") / CELL).cast("long"), "c": F.floor(F.col("e") / CELL).cast("long")})
    return keyed.join(cells, ["r", "c"], "left").drop("r", "c")


def outlines(of: DataFrame, within: float = 25.0) -> DataFrame:
    """(place, cells, area, polygons): the ground of each place outlined, simplified and drawn as GeoJSON."""
    import pyarrow as pa

    def draw(table: pa.Table) -> pa.Table:
        cells = set(zip(table.column("r").to_pylist(), table.column("c").to_pylist(), strict=True))
        place = table.column("place")[0].as_py()
        rings = S.outlines(cells)
        drawn = [S.polygon_feature([S.simplified(ring, within) for ring in p], place=place) for p in rings]
        area = sum(S.ring_area(ring) for p in rings for ring in p)
        return pa.table({"place": [place], "cells": [len(cells)], "area": [area], "polygons": [S.collection(drawn)]}, schema=pa.schema([("place", arrow_type("long")), ("cells", arrow_type("long")), ("area", arrow_type("double")), ("polygons", arrow_type("string"))]))

    return ground_cells(of).groupBy("place").applyInArrow(draw, "place long, cells long, area double, polygons string")
