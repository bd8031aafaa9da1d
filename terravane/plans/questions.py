"""The operations applied to questions that come from the driver's tables, over the synthetic terrain's tables.

Each query reads the terrain's stored tables; its SQL is the closed form's, by
other means, so that the two agree only if both are right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..operators import airfields, mesh, network, offroad, points, settlements, sight, sites, windows
from ..sources.catalog import Terrain, synthetic
from ..sources.synthetic import CELL
from .closed_form import layers as form_layers
from .closed_form import oracle as O
from .closed_form import points as form_points
from .closed_form import sites as form_sites
from .closed_form import terrain as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def asks(sql: str | None) -> Callable[[Callable], Callable]:
    """Registers a query of (terrain, table reader) with the SQL it is held against."""

    def register(make: Callable[[Terrain, Callable[[str], DataFrame]], DataFrame]) -> Callable:
        name = make.__name__.removeprefix("q_")

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(synthetic(spark), lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = query
        if sql is not None:
            SQL[name] = O.for_duckdb(sql)
        return make

    return register


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, k) for c, k in places.items()})


# --- requests, as columns and as SQL


def spread(key: Column) -> dict[str, Column]:
    """Places in the covered square from an integer key."""
    return {"n": (2000 + (key * 7919) % 66000).cast("double"), "e": (2000 + (key * 104729) % 66000).cast("double")}


def events(table: Callable) -> DataFrame:
    return table("events").select(F.col("event_id").alias("id")).withColumns(spread(F.col("id")))


EVENTS = T.points("events", "event_id")


def pairs(table: Callable) -> DataFrame:
    """Ends up to 35 km apart, 10 and 30 m above ground."""
    k = F.col("id")
    out = table("customer").select(F.col("c_custkey").alias("id")).withColumns({"n1": spread(k)["n"], "e1": spread(k)["e"]})
    out = out.withColumns({"n2": (2000 + (k * 15485863) % 66000).cast("double"), "e2": (2000 + (k * 32452843) % 66000).cast("double"), "a1": F.lit(10.0), "a2": F.lit(30.0)})
    return out.where((F.col("n1") != F.col("n2")) & (F.col("e1") != F.col("e2")))


PAIRS = (
    "(SELECT * FROM (SELECT c_custkey AS id, CAST(2000 + (c_custkey * 7919) % 66000 AS DOUBLE) AS n1, CAST(2000 + (c_custkey * 104729) % 66000 AS DOUBLE) AS e1, 10e0 AS a1, "
    "CAST(2000 + (c_custkey * 15485863) % 66000 AS DOUBLE) AS n2, CAST(2000 + (c_custkey * 32452843) % 66000 AS DOUBLE) AS e2, 30e0 AS a2 FROM {t:customer}) c WHERE n1 <> n2 AND e1 <> e2)"
)


def posts(table: Callable, name: str, key: str, radius: float) -> DataFrame:
    """Sites around the hills, 15 m above ground."""
    k = F.col("id")
    out = table(name).select(F.col(key).cast("long").alias("id"))
    return out.withColumns({"n": (40000 + (k * 7919) % 14000 + 7).cast("double"), "e": (25000 + (k * 104729) % 16000 + 13).cast("double"), "a": F.lit(15.0), "radius": F.lit(float(radius))})


def posts_sql(name: str, key: str) -> str:
    return f"(SELECT CAST({key} AS BIGINT) AS id, CAST(40000 + ({key} * 7919) % 14000 + 7 AS DOUBLE) AS n0, CAST(25000 + ({key} * 104729) % 16000 + 13 AS DOUBLE) AS e0, 15e0 AS a0 FROM {{t:{name}}})"


SUPPLIERS, NATIONS = posts_sql("supplier", "s_suppkey"), posts_sql("nation", "n_nationkey")

# --- points


@asks(form_points.sample_points(EVENTS))
def q_sample(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(points.ground(terrain, events(table)), height=4, depth=4)


_LATTICE = S.Box(45000.0, 29000.0, 45000.0 + 79 * 70, 29000.0 + 99 * 70)


@asks(f"SELECT n, e, height, CAST(water AS DOUBLE) AS water, CAST(surface AS DOUBLE) AS surface, CAST(cover AS DOUBLE) AS cover FROM ({form_points.sample_lattice(45000, 29000, 80, 100, 70)}) q")
def q_sample_lattice(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(points.sample_region(terrain, _LATTICE, 70.0, ["height", "water", "surface", "cover"]), height=4)


_GN, _GE = O.horn("floor(n / 50e0)", "floor(e / 50e0)")


@asks(f"SELECT id, round(degrees(atan(sqrt(gn * gn + ge * ge))), 4) AS slope, CASE WHEN h IS NULL OR water = 2 THEN 0e0 ELSE 1e0 END AS valid FROM (SELECT id, {_GN} AS gn, {_GE} AS ge, {O.corner('floor(n / 50e0)', 'floor(e / 50e0)')} AS h, {T.water('(floor(n / 50e0) * 50e0 + 25e0)', '(floor(e / 50e0) * 50e0 + 25e0)')} AS water FROM {EVENTS} p) q")
def q_sample_layers(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(points.sample(terrain, events(table), ["slope", "valid"]), slope=4).select("id", "slope", "valid")


@asks(f"SELECT g.id, g.lat, g.lon, g.back_n, g.back_e, {O.grid_reference('p.n', 'p.e')} AS mgrs FROM (SELECT id, lat, lon, back_x + 0e0 AS back_n, back_z + 0e0 AS back_e FROM ({form_points.geo(EVENTS)}) q) g JOIN {EVENTS} p ON p.id = g.id")
def q_geo(terrain: Terrain, table: Callable) -> DataFrame:
    out = points.geo(events(table))
    back = {f"back_{v}": F.round(F.col(f"back_{v}") - F.col(v), 3) + 0.0 for v in ("n", "e")}
    return out.withColumns({**back, "lat": F.round("lat", 7), "lon": F.round("lon", 7)}).select("id", "lat", "lon", "mgrs", "back_n", "back_e")


@asks(O.point_info(EVENTS))
def q_point_info(terrain: Terrain, table: Callable) -> DataFrame:
    out = points.point_info(terrain, events(table))
    out = rounded(out, height=3, slope=4, aspect=4, lat=6, lon=6, town_distance=3, town_bearing=3, road_distance=3, airdrome_distance=3)
    return out.select("id", "height", "water", "cover", "slope", "aspect", "lat", "lon", "mgrs", "town", "town_distance", "town_bearing", "description", "road_distance", "airdrome_distance")


def _near(kind: str, n: int = 1, of_class: str | None = None) -> Callable:
    def make(terrain: Terrain, table: Callable) -> DataFrame:
        return points.nearest(terrain, events(table), kind, n, of_class).select("id", "rnk", "what", F.round("distance", 4).alias("distance"))

    make.__name__ = f"nearest_{of_class or kind}"
    return make


_things = lambda where: f"(SELECT n AS fn, e AS fe, CAST(id AS VARCHAR) AS tie, CAST(id AS VARCHAR) AS what FROM {T.scenery()} s{where})"
asks(O.nearest(EVENTS, _things(""), 3))(_near("scenery", 3))
asks(O.nearest(EVENTS, _things(" WHERE class = 'industrial'"), 1))(_near("scenery", 1, "industrial"))
asks(O.nearest(EVENTS, f"(SELECT ord AS tie, name AS what, n AS fn, e AS fe FROM {T.towns()} t)", 2))(_near("town", 2))
asks(O.nearest(EVENTS, O.values([("SY1", "SY1", 60025.0, 18750.0), ("SY2", "SY2", 60025.0, 21250.0)], "tie, what, fn, fe"), 1))(_near("beacon"))
asks(O.nearest(EVENTS, O.values([(k, f"node_{k}", 5000.0 + 15000 * k, e) for k in (1, 2) for e in (38000.0, 42000.0)], "tie, what, fn, fe"), 1))(_near("node"))
asks(O.nearest(EVENTS, O.values([(1, "Synth Field", 60025.0, 20000.0)], "tie, what, fn, fe"), 1))(_near("airdrome"))


@asks(f"SELECT id, edge_id, round(at_n, 3) AS at_n, round(at_e, 3) AS at_e, round(distance, 4) AS distance FROM {O.snapped(EVENTS, 'n', 'e')} q")
def q_nearest_road(terrain: Terrain, table: Callable) -> DataFrame:
    out = points.nearest(terrain, events(table), "road")
    return rounded(out, at_n=3, at_e=3, distance=4).select("id", F.col("what").cast("int").alias("edge_id"), "at_n", "at_e", "distance")


@asks(f"SELECT id, edge_id, round(at_n, 3) AS at_n, round(at_e, 3) AS at_e, round(distance, 4) AS distance FROM {O.snapped(EVENTS, 'n', 'e', True)} q")
def q_nearest_rail(terrain: Terrain, table: Callable) -> DataFrame:
    out = points.nearest(terrain, events(table), "rail")
    return rounded(out, at_n=3, at_e=3, distance=4).select("id", F.col("what").cast("int").alias("edge_id"), "at_n", "at_e", "distance")


_RING, _DISK = S.Ring(60025.0, 20000.0, 8000.0, 30000.0), S.Circle(46000.0, 32000.0, 9000.0)
_STAR = S.Polygon(((30000.0, 20000.0), (60000.0, 30000.0), (30000.0, 55000.0), (52000.0, 12000.0), (50000.0, 60000.0)))


def _even_odd(points_: tuple) -> str:
    each = []
    for (n0, e0), (n1, e1) in zip(points_, points_[1:] + points_[:1], strict=True):
        (a, b), (c, d) = sorted(((n0, e0), (n1, e1)))
        each.append(f"CASE WHEN n >= {T.num(a)} AND n < {T.num(c)} AND e < {T.num(b)} + (n - {T.num(a)}) / {T.num(c - a)} * {T.num(d - b)} THEN 1 ELSE 0 END")
    return f"({' + '.join(each)}) % 2 = 1"


@asks(
    f"SELECT id, sqrt((n - 60025e0) * (n - 60025e0) + (e - 20000e0) * (e - 20000e0)) BETWEEN 8000 AND 30000 AS in_ring, (n - 46000e0) * (n - 46000e0) + (e - 32000e0) * (e - 32000e0) <= 81000000e0 AS in_disk, {_even_odd(_STAR.points)} AS in_star FROM {EVENTS} p"
)
def q_regions(terrain: Terrain, table: Callable) -> DataFrame:
    n, e = F.col("n"), F.col("e")
    return events(table).select("id", _RING.condition(n, e).alias("in_ring"), _DISK.condition(n, e).alias("in_disk"), _STAR.condition(n, e).alias("in_star"))


# --- layers


def _layer(name: str, sql: str, window: tuple[int, int, int, int], names: list[str], places: int = 4) -> None:
    row, rows, col, cols = window

    def make(terrain: Terrain, table: Callable) -> DataFrame:
        out = windows.layers(terrain, names, (row, row + rows - 1), (col, col + cols - 1))
        return rounded(out, **{n: 6 if n.startswith("share_") else places for n in names})

    make.__name__ = name
    asks(sql)(make)


_as_double = lambda sql, *cols: f"SELECT r, c, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM ({sql}) q"
_distance = lambda window, seed, name: f"SELECT r, c, distance AS {name} FROM ({form_layers.distance_layer(*window, seed)}) q"
_HILLS, _SLOPES = (1060, 200, 560, 200), (880, 300, 500, 400)
_layer("layer_slope", _as_double(form_layers.slope_layers(*_SLOPES), "valid", "slope", "aspect", "roughness"), _SLOPES, ["valid", "slope", "aspect", "roughness"])
_layer("layer_disk", form_layers.disk_layers(1090, 100, 560, 120), (1090, 100, 560, 120), ["tpi_300", *(f"share_{c}" for c in T.COVERS.values())])
_layer("layer_tpi_2000", f"SELECT r, c, tpi_2000 FROM ({form_layers.disk_layers(900, 80, 580, 80, 2000, 'tpi_2000')}) q", (900, 80, 580, 80), ["tpi_2000"])
_layer("layer_dist_road", _distance(_HILLS, "surface = 4", "dist_road"), _HILLS, ["dist_road"])
_layer("layer_dist_rail", _distance(_HILLS, "r = 1040 AND c BETWEEN 100 AND 1299", "dist_rail"), _HILLS, ["dist_rail"])
_layer("layer_dist_water", _distance((240, 160, 960, 160), "water <> 0", "dist_water"), (240, 160, 960, 160), ["dist_water"])
_layer("layer_dist_sea", _distance((500, 160, 500, 160), "water = 2", "dist_sea"), (500, 160, 500, 160), ["dist_sea"])
_layer("layer_dist_forest", _distance((760, 160, 1000, 160), "cover = 3", "dist_forest"), (760, 160, 1000, 160), ["dist_forest"])
_layer("layer_count_building", f"SELECT r, c, CAST(objects AS DOUBLE) AS count_building FROM ({form_layers.count_layer(1080, 200, 560, 200, 'building')}) q", (1080, 200, 560, 200), ["count_building"])
_layer("layer_count_industrial", f"SELECT r, c, CAST(objects AS DOUBLE) AS count_industrial FROM ({form_layers.count_layer(1060, 100, 780, 100, 'industrial')}) q", (1060, 100, 780, 100), ["count_industrial"])
_layer("layer_tree_density", O.tree_density(790, 100, 1090, 100), (790, 100, 1090, 100), ["tree_density"])


@asks(O.horizon((226, 229), (150, 153), 40_000))
def q_layer_horizon(terrain: Terrain, table: Callable) -> DataFrame:
    out = windows.horizon(terrain, (226 * 4, 229 * 4 + 3), (150 * 4, 153 * 4 + 3))
    return out.select("hr", "hc", F.posexplode("bins").alias("bin", "angle"))


@asks(f"SELECT hr, hc, round(avg(angle), 6) AS enclosure FROM ({O.horizon((232, 235), (156, 159), 40_000)}) q GROUP BY hr, hc")
def q_layer_enclosure(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(windows.horizon(terrain, (232 * 4, 235 * 4 + 3), (156 * 4, 159 * 4 + 3)), enclosure=6).select("hr", "hc", "enclosure")


# --- line of sight


@asks(O.line(PAIRS))
def q_visible(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(sight.visible(terrain, pairs(table)), clearance=3).select("id", "visible", "clearance")


@asks(f"SELECT id, r, c, round(floor_agl, 3) <= 30 AS seen FROM {O.sweep(NATIONS, 4000)} f")
def q_viewshed(terrain: Terrain, table: Callable) -> DataFrame:
    return sight.viewshed(terrain, posts(table, "nation", "n_nationkey", 4000).withColumn("target", F.lit(30.0)))


@asks(f"SELECT id, r, c, round(floor_agl, 3) AS floor_agl, round(floor_agl + h, 3) AS floor_msl FROM {O.sweep(SUPPLIERS, 1500)} f")
def q_radar_floor(terrain: Terrain, table: Callable) -> DataFrame:
    out = sight.radar_floor(terrain, posts(table, "supplier", "s_suppkey", 1500))
    return out.select("id", "r", "c", F.round("floor_agl", 3).alias("floor_agl"), F.round(F.col("floor_agl") + F.col("h"), 3).alias("floor_msl"))


_BANDS = O.values([(30.0,), (100.0,), (300.0,), (1000.0,)], "alt_agl")


@asks(f"SELECT id, alt_agl, round(avg(CASE WHEN round(floor_agl, 3) <= alt_agl THEN 1e0 ELSE 0e0 END), 6) AS covered_fraction, count(*) AS cells, CAST(sum(CASE WHEN round(floor_agl, 3) <= alt_agl THEN 0 ELSE 1 END) AS BIGINT) AS dead_cells FROM {O.sweep(SUPPLIERS, 2000)} f, {_BANDS} b GROUP BY id, alt_agl")
def q_coverage(terrain: Terrain, table: Callable) -> DataFrame:
    out = sight.coverage(terrain, posts(table, "supplier", "s_suppkey", 2000))
    return rounded(out, covered_fraction=6).select("id", "alt_agl", "covered_fraction", "cells", "dead_cells")


@asks(f"SELECT r, c, round(min(floor_agl), 3) AS floor_agl, CAST(sum(CASE WHEN round(floor_agl, 3) <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS seen_count, count(*) AS in_reach FROM {O.sweep(SUPPLIERS, 2000)} f GROUP BY r, c")
def q_exposure(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(sight.exposure(terrain, posts(table, "supplier", "s_suppkey", 2000), 100.0), floor_agl=3)


@asks(O.spectrum(NATIONS, 4000, (30, 100), 5, 3000))
def q_approach_spectrum(terrain: Terrain, table: Callable) -> DataFrame:
    out = sight.spectrum(terrain, posts(table, "nation", "n_nationkey", 4000), (30.0, 100.0), 5.0, 3000.0)
    return rounded(out, masked_fraction=6)


_LEG = "(SELECT id, n0 AS n, e0 AS e, a0 AS a, n0 - 4000e0 AS n1, e0 + 1500e0 AS e1, 20e0 AS a1, n0 + 4500e0 AS n2, e0 - 2500e0 AS e2, 60e0 AS a2 FROM {sites} s)"


@asks(O.unmask(_LEG.replace("{sites}", SUPPLIERS), 100))
def q_unmask_profile(terrain: Terrain, table: Callable) -> DataFrame:
    end = lambda dn, de, a: F.struct((F.col("n") + dn).alias("n"), (F.col("e") + de).alias("e"), F.lit(a).alias("a"))
    asked = posts(table, "supplier", "s_suppkey", 0).withColumn("route", F.array(end(-4000.0, 1500.0, 20.0), end(4500.0, -2500.0, 60.0))).drop("radius")
    return rounded(sight.unmask(terrain, asked, 100.0), from_m=3, to_m=3)


# --- the mesh between cell centres


_MESH = ((920, 959), (620, 659))
_ON_MESH = "(SELECT p_partkey AS id, CAST(46030 + (p_partkey * 7919) % 1980 AS DOUBLE) AS n, CAST(31030 + (p_partkey * 104729) % 1980 AS DOUBLE) AS e FROM {t:part})"


@asks(O.triangle(_ON_MESH))
def q_mesh_ground(terrain: Terrain, table: Callable) -> DataFrame:
    k = F.col("id")
    asked = table("part").select(F.col("p_partkey").alias("id")).withColumns({"n": (46030 + (k * 7919) % 1980).cast("double"), "e": (31030 + (k * 104729) % 1980).cast("double")})
    return mesh.ground(mesh.from_cells(terrain, *_MESH), asked).select("id", F.round("height", 6).alias("height"))


# --- sites and objects


_CIRCLES = "(SELECT c_custkey AS id, CAST(54000 + (c_custkey * 379) % 3000 AS DOUBLE) AS n, CAST(29000 + (c_custkey * 997) % 12000 AS DOUBLE) AS e, 1500e0 AS radius FROM {t:customer})"


@asks(form_sites.scenery_in(_CIRCLES))
def q_scenery_in(terrain: Terrain, table: Callable) -> DataFrame:
    k = F.col("id")
    asked = table("customer").select(F.col("c_custkey").alias("id")).withColumns({"n": (54000 + (k * 379) % 3000).cast("double"), "e": (29000 + (k * 997) % 12000).cast("double"), "radius": F.lit(1500.0)})
    return sites.scenery_in(terrain, asked)


_SHAPES = "(SELECT id, n, e, CAST(5 + p.p_size AS DOUBLE) AS wn, CAST(5 + 2 * p.p_size AS DOUBLE) AS we FROM " + T.points("part", "p_partkey") + " q JOIN {t:part} p ON p.p_partkey = q.id)"


@asks(form_sites.validate_placements(_SHAPES, 2.0))
def q_validate_placements(terrain: Terrain, table: Callable) -> DataFrame:
    asked = table("part").select(F.col("p_partkey").alias("id"), (5 + F.col("p_size")).cast("double").alias("w"), (5 + 2 * F.col("p_size")).cast("double").alias("d")).withColumns(spread(F.col("id")))
    none = lambda kind: F.lit(None).cast(kind)
    asked = asked.withColumns({
        "kind": F.lit("box"), "radius": none("double"), "rotation": F.lit(0.0), "points": none("array<struct<n:double,e:double>>"),
        "afloat": F.lit(False), "max_slope": none("double"), "min_depth": F.lit(2.0), "allow_forest": F.lit(False),
    })
    out = sites.validate_placements(terrain, asked)
    return out.select("id", "cells", "relief", F.size("covers").cast("long").alias("covers"), "objects_met", F.round("min_depth", 4).alias("min_depth"), "verdict")


_SITE_WINDOW = (1060, 80, 600, 80)
_SITE_BOX = S.Box(1060 * 50 + 25.0, 600 * 50 + 25.0, 1139 * 50 + 25.0, 679 * 50 + 25.0)
_CRITERIA = [{"name": "slope_max", "deg": 8.0}, {"name": "cover_in", "classes": ["plain"]}, {"name": "dist_road_band", "min": 0.0, "max": 3000.0}]


@asks(form_sites.score_sites(*_SITE_WINDOW))
def q_score_sites(terrain: Terrain, table: Callable) -> DataFrame:
    asked = points.lattice(terrain, _SITE_BOX, 2.0 * CELL, 0).select((F.col("n") * 100_000 + F.col("e")).cast("long").alias("id"), "n", "e")
    out = sites.best_orientation(sites.score_sites(terrain, asked, _CRITERIA))
    value = lambda k: F.round(F.element_at("values", k), 4)
    return out.select("n", "e", value(2).alias("slope"), value(4).alias("distance"), "pass", F.round("score", 6).alias("score"))


@asks(None)
def q_find_sites(terrain: Terrain, table: Callable) -> DataFrame:
    """Ten kinds of criteria, footprints at two orientations; greedy spacing has no SQL."""
    criteria = [
        *_CRITERIA, {"name": "span_max", "m": 10.0}, {"name": "slope_band", "min": 0.0, "max": 6.0, "residual_max": 2.0}, {"name": "tpi_class_in", "classes": ["mid", "flat", "upper", "lower"]},
        {"name": "clearing_max", "radius": 150.0, "max": 1}, {"name": "scenery_in_footprint_max", "max": 0}, {"name": "dist_water_min", "m": 500.0}, {"name": "dist_airdrome_band", "min": 0.0, "max": 30000.0},
    ]
    out = sites.find_sites(terrain, _SITE_BOX, criteria, spacing=400.0, footprint=(120.0, 60.0), orientations=(0.0, 45.0))
    return rounded(out, score=6).select("rnk", "n", "e", "orientation", "score")


@asks(f"SELECT a, b FROM ({form_sites.settlements()}) q")
def q_settlement_links(terrain: Terrain, table: Callable) -> DataFrame:
    return settlements.links(settlements.buildings(terrain.objects()))


@asks(O.towns())
def q_towns(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(settlements.towns(terrain), floor_m2=3, n=3, e=3).drop("matched", "names")


# --- networks


_WAYS = "(SELECT o_orderkey AS id, CAST(30000 + (o_orderkey * 7919) % 36000 AS DOUBLE) AS n1, CAST(4000 + (o_orderkey * 104729) % 62000 AS DOUBLE) AS e1, CAST(30000 + (o_orderkey * 15485863) % 36000 AS DOUBLE) AS n2, CAST(4000 + (o_orderkey * 32452843) % 62000 AS DOUBLE) AS e2 FROM {t:orders} WHERE o_orderkey % 10 = 1)"


def ways(table: Callable) -> DataFrame:
    k = F.col("id")
    asked = table("orders").where("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("id"))
    at = lambda base, mul, over: (base + (k * mul) % over).cast("double")
    return asked.withColumns({"n1": at(30000, 7919, 36000), "e1": at(4000, 104729, 62000), "n2": at(30000, 15485863, 36000), "e2": at(4000, 32452843, 62000)})


@asks(O.routes(_WAYS))
def q_route(terrain: Terrain, table: Callable) -> DataFrame:
    out = network.route(terrain, ways(table), max_detour=1000.0)
    return rounded(out, length=3, snap_from=3, snap_to=3).select("id", "length", "snap_from", "snap_to")


@asks(None)
def q_route_alternatives(terrain: Terrain, table: Callable) -> DataFrame:
    """Three routes apart by raising the price of edges used; sequential searches have no SQL."""
    k = F.col("id")
    at = lambda base, mul, over: (base + (k * mul) % over).cast("double")
    asked = table("nation").select(F.col("n_nationkey").cast("long").alias("id")).withColumns({"n1": at(54000, 7919, 2000), "e1": at(6000, 104729, 25000), "n2": at(50000, 15485863, 9000), "e2": at(46000, 32452843, 18000)})
    return rounded(network.route_alternatives(terrain, asked), length=3, stretch=6, overlap=6)


@asks(O.betweenness())
def q_chokepoints(terrain: Terrain, table: Callable) -> DataFrame:
    return rounded(network.chokepoints(terrain, limit=500), betweenness=6)


@asks(None)
def q_trafficability(terrain: Terrain, table: Callable) -> DataFrame:
    """Ways to a road up to 20 km; a heap search has no SQL."""
    k = F.col("id")
    asked = table("nation").select(F.col("n_nationkey").cast("long").alias("id")).withColumns({"n": (40000 + (k * 7919) % 20000).cast("double"), "e": (27000 + (k * 104729) % 30000).cast("double")})
    return rounded(offroad.trafficability(terrain, asked), cost=3, length=3, road_n=3, road_e=3, straight_distance=3)


# --- airfields and the whole


@asks(O.airfield_info(30, 35))
def q_airfield_info(terrain: Terrain, table: Callable) -> DataFrame:
    out = rounded(airfields.airfield_info(terrain, 30.0, 35.0), lat=6, lon=6, elevation=3, width=3, course_deg=6, length=3)
    return out.select("designator", "lat", "lon", "course_deg", "length", "width", "elevation", "stands", "stands_fitting", "beacons")


@asks(O.describe())
def q_describe(terrain: Terrain, table: Callable) -> DataFrame:
    return airfields.describe(terrain)
