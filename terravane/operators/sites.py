"""Siting by many criteria, and checks of placed shapes.

Candidates of a tile meet, in one task, the ground around it, the objects and
lines near it and its horizon; a tile's candidates are split in shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import raster as R
from ..functions import shapes as S
from ..sources.catalog import Terrain
from ..sources.synthetic import CELL, COVER, RAIL, ROAD, SEA, SURFACE, TILE
from . import points, windows
from .windows import around, on_blocks

# How far a criterion looks for objects beyond its shape, the margin at which a mask scores in full, the slope of flat ground.
OBJECT_REACH, FULL_MARGIN, MID_SLOPE = 500.0, 10.0, 5.0
LANDFORMS = ("ridge", "valley", "upper", "lower", "mid", "flat")
SHARES = 4
LISTED = 100


def unit(v: float) -> float:
    return 0.0 if math.isnan(v) else min(1.0, max(0.0, v))


def under(v: float, limit: float) -> float:
    """1 - v / limit, held to 0..1; at a limit of 0, 1 where v is 0."""
    return unit(1 - v / limit) if limit > 0 else unit(float(v <= limit))


def band(v: float, low: float, high: float) -> float:
    return unit((high - v) / (high - low) if high > low else 1.0 + 0 * v)


@dataclass
class Around:
    """What criteria may read about the candidates of a tile."""

    block: R.Block
    objects: list[dict]
    lines: dict[str, list[np.ndarray]]
    horizon: dict[tuple[int, int], list[float] | None]
    airdromes: list[dict]
    ends: list[list[tuple[float, float, float]]]
    w: float = 0.0
    d: float = 0.0
    kept: dict = field(default_factory=dict)

    def layer(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def slope(self) -> np.ndarray:
        return self.layer("slope", lambda: R.slope_layers(self.block.h)["slope"])

    def valid(self) -> np.ndarray:
        return self.layer("valid", lambda: ~np.isnan(self.block.h) & (self.block.water != SEA))

    def rect(self, n: float, e: float, deg: float) -> S.Shape:
        return S.turned_box(n, e, self.d, self.w, math.radians(deg))

    def cells(self, n: float, e: float, deg: float) -> list[tuple[int, int]]:
        """Cells whose centres lie in the footprint, the candidate's own first."""
        own = math.floor(n / CELL), math.floor(e / CELL)
        rect = self.rect(n, e, deg)
        s, w, t, r = rect.bounds()
        out = [own]
        for i in range(math.floor(s / CELL), math.floor(t / CELL) + 1):
            out += [(i, j) for j in range(math.floor(w / CELL), math.floor(r / CELL) + 1) if (i, j) != own and rect.holds(((i + 0.5) * CELL, (j + 0.5) * CELL))]
        return [(i - self.block.row, j - self.block.col) for i, j in out]

    def at(self, layer: np.ndarray, n: float, e: float) -> float:
        return float(layer[math.floor(n / CELL) - self.block.row, math.floor(e / CELL) - self.block.col])

    def distance(self, name: str, cap: float) -> np.ndarray:
        def seeds() -> np.ndarray:
            if name in ("road", "rail"):
                return R.line_cells(self.lines[name], self.block.row, self.block.col, *self.block.shape)
            return self.block.water > 0 if name == "water" else self.block.cover == COVER[name]

        return self.layer(f"{name} {cap}", lambda: R.distance(seeds(), cap))


Result = tuple[float, bool, float]


def _valid(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    cells = a.cells(n, e, deg)
    share = sum(bool(a.valid()[c]) for c in cells) / len(cells)
    return share, share == 1, share


def _slope_max(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    worst = max((float(a.slope()[c]) for c in a.cells(n, e, deg)), key=lambda v: math.inf if math.isnan(v) else v)
    return worst, worst <= p["deg"], under(worst, p["deg"])


def fit_plane(block: R.Block, cells: set[tuple[int, int]]) -> tuple[float, float] | None:
    """(slope in degrees, root mean square of the heights about it) of the plane through cells; None where it has none."""
    at = np.array(sorted(cells))
    h = block.h[at[:, 0], at[:, 1]]
    if np.isnan(h).any():
        return None
    m = np.column_stack([at * float(CELL), np.ones(len(at))])
    got, _, rank, _ = np.linalg.lstsq(m - np.array([*m[:, :2].mean(0), 0.0]), h, rcond=None)
    if rank < 3:
        return None
    left = h - (m - np.array([*m[:, :2].mean(0), 0.0])) @ got
    return math.degrees(math.atan(math.hypot(got[0], got[1]))), float(np.sqrt((left * left).mean()))


def _slope_band(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    ring = {(i + x, j + y) for i, j in a.cells(n, e, deg) for x in (-1, 0, 1) for y in (-1, 0, 1)}
    fit = fit_plane(a.block, ring)
    if fit is None:
        return math.nan, False, 0.0
    rough = p.get("residual_max", 1.0)
    return fit[0], p["min"] <= fit[0] <= p["max"] and fit[1] <= rough, band(fit[0], p["min"], p["max"]) * under(fit[1], rough)


def _span_max(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    at = [*a.rect(n, e, deg).corners, (n, e)]
    h = a.block.bilinear(np.array([x for x, _ in at]), np.array([y for _, y in at]))
    span = math.nan if np.isnan(h).any() else float(h.max() - h.min())
    return span, span <= p["m"], under(span, p["m"])


def _codes(layer: str, names: dict[str, int], field_name: str) -> Callable[..., Result]:
    def term(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
        wanted = {names[v] if isinstance(v, str) else v for v in p[field_name]}
        cells = a.cells(n, e, deg)
        share = sum(int(getattr(a.block, layer)[c]) in wanted for c in cells) / len(cells)
        return share, share == 1, share

    return term


def _cover_fraction(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    v = a.at(a.layer(f"share {p['class']} {p['radius']}", lambda: R.cover_share(a.block.cover, COVER[p["class"]], p["radius"])), n, e)
    return v, v >= p["min"], unit(v)


def _distance_band(kind: str | None) -> Callable[..., Result]:
    def term(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
        v = a.at(a.distance(kind or p["class"], p["max"] + CELL), n, e)
        return v, p["min"] <= v <= p["max"], band(v, p["min"], p["max"])

    return term


def _water_min(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    v = a.at(a.distance("water", max(2 * p["m"], R.DISTANCE_CAP)), n, e)
    return v, v >= p["m"], unit(v / (2 * p["m"])) if p["m"] > 0 else 1.0


def _airdrome_band(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    at = [x for x in a.airdromes if p.get("airdrome") in (None, x["airdrome_id"], x["name_id"], x["display_name"])]
    v = min((math.hypot(x["n"] - n, x["e"] - e) for x in at), default=math.inf)
    return v, p["min"] <= v <= p["max"], band(v, p["min"], p["max"])


def _objects(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    radius = p.get("radius", 150.0)
    count = float(sum(math.hypot(o["n"] - n, o["e"] - e) <= radius and p.get("class") in (None, o["class"]) for o in a.objects))
    return count, count <= p["max"], under(count, p["max"])


def _in_footprint(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    rect = a.rect(n, e, deg).moved(-n, -e)
    near = OBJECT_REACH + math.hypot(a.w, a.d)
    count = float(sum(math.hypot(o["n"] - n, o["e"] - e) <= near and rect.meets(S.turned_box(o["n"] - n, o["e"] - e, o["w"], o["d"], o["rotation"])) for o in a.objects))
    return count, count <= p["max"], under(count, p["max"])


def _bins(a: Around, n: float, e: float) -> np.ndarray | None:
    span = R.HORIZON_SPAN * CELL
    got = a.horizon.get((math.floor(n / span), math.floor(e / span)))
    return None if got is None else np.array(got)


def _enclosure(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    bins = _bins(a, n, e)
    v = math.nan if bins is None else float(bins.mean())
    return v, v >= p["deg"], unit(v / (2 * p["deg"])) if p["deg"] > 0 else unit(float(v >= p["deg"]))


def sector(bearing: float, half: float) -> list[int]:
    """Horizon bins whose centre lines lie within ``half`` degrees of a bearing, or the one that holds it."""
    width = 360 / R.BINS
    off = [abs((b * width - bearing + 180) % 360 - 180) for b in range(R.BINS)]
    return [b for b in range(R.BINS) if off[b] <= half] or [math.floor(bearing / width + 0.5) % R.BINS]


def _masked(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    bins = _bins(a, n, e)
    if bins is None:
        return math.nan, False, 0.0
    part = bins[sector(p["bearing_deg"], p["half_width_deg"])]
    return float(part.min()), bool(part.min() >= p["min_elev_deg"]), unit(float((part - p["min_elev_deg"]).mean()) / FULL_MARGIN)


def _sight(ends: str, wanted: bool) -> Callable[..., Result]:
    def term(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
        g = float(a.block.ground(np.array([n]), np.array([e]))[0])
        if math.isnan(g):
            return math.nan, False, 0.0
        seen = [R.exact_line(a.block, q, (n, e, g + p.get("own", 2.0)))[0] for q in p["__ends"]]
        share = sum(seen) / len(seen)
        return share, share >= p["min_fraction"] if wanted else share <= p["max_fraction"], share if wanted else 1 - share

    return term


def landform(near: float, far: float, slope: float, threshold: float) -> str | None:
    if math.isnan(near) or math.isnan(far) or math.isnan(slope):
        return None
    if abs(near) > threshold:
        return "ridge" if near > 0 else "valley"
    if abs(far) > threshold:
        return "upper" if far > 0 else "lower"
    return "mid" if slope > MID_SLOPE else "flat"


def _landform(a: Around, n: float, e: float, deg: float, p: dict) -> Result:
    near, far = (a.at(a.layer(f"tpi {r}", lambda r=r: R.position(a.block.h, r)), n, e) for r in (300, 2000))
    got = landform(near, far, a.at(a.slope(), n, e), p.get("threshold", 10.0))
    if got is None:
        return math.nan, False, 0.0
    return float(LANDFORMS.index(got)), got in p["classes"], float(got in p["classes"])


#: Criterion: the term, and how far it looks (metres) given its parameters.
CRITERIA: dict[str, tuple[Callable[..., Result], Callable[[dict], float]]] = {
    "valid": (_valid, lambda p: 0),
    "slope_max": (_slope_max, lambda p: CELL),
    "slope_band": (_slope_band, lambda p: CELL),
    "span_max": (_span_max, lambda p: CELL),
    "surface_in": (_codes("surface", SURFACE, "classes"), lambda p: 0),
    "surface_enum_in": (_codes("surface", SURFACE, "values"), lambda p: 0),
    "cover_in": (_codes("cover", COVER, "classes"), lambda p: 0),
    "cover_fraction_min": (_cover_fraction, lambda p: p["radius"]),
    "dist_cover_band": (_distance_band(None), lambda p: p["max"] + CELL),
    "dist_road_band": (_distance_band("road"), lambda p: p["max"] + CELL),
    "dist_rail_band": (_distance_band("rail"), lambda p: p["max"] + CELL),
    "dist_water_min": (_water_min, lambda p: max(2 * p["m"], R.DISTANCE_CAP)),
    "dist_airdrome_band": (_airdrome_band, lambda p: 0),
    "scenery_max": (_objects, lambda p: 0),
    "scenery_in_footprint_max": (_in_footprint, lambda p: 0),
    "clearing_max": (_objects, lambda p: 0),
    "enclosure_min": (_enclosure, lambda p: 0),
    "masked_from": (_masked, lambda p: 0),
    "not_visible_from": (_sight("observers", False), lambda p: 0),
    "visible_to": (_sight("targets", True), lambda p: 0),
    "tpi_class_in": (_landform, lambda p: 2000),
}


def checked(criteria: list[dict]) -> list[dict]:
    """The criteria with ``valid`` in front, once; unknown names are errors."""
    unknown = [c.get("name") for c in criteria if c.get("name") not in CRITERIA]
    if unknown:
        raise ValueError(f"no criterion {unknown[0]}; they are {', '.join(CRITERIA)}")
    return [{"name": "valid"}, *(c for c in criteria if c["name"] != "valid")]


TERMS = "id long, n double, e double, orientation double, ord long, pass boolean, score double, values array<double>, passes array<boolean>, scores array<double>"


def score_sites(terrain: Terrain, candidates: DataFrame, criteria: list[dict], footprint: tuple[float, float] = (0.0, 0.0), orientations: tuple[float, ...] = (0.0,), weights: dict[str, float] | None = None) -> DataFrame:
    """The terms of every candidate (id, n, e) at every orientation: values, hard tests and scores in order of the criteria.

    ``valid`` comes first.  ``score`` is the weighted sum of the terms' scores;
    ``footprint`` is width and depth in metres.
    """
    criteria, weights = checked(criteria), weights or {}
    names = {c["name"] for c in criteria}
    sights = [list(c.get("observers") or c.get("targets")) for c in criteria if c["name"] in ("not_visible_from", "visible_to")]
    reach = max([CRITERIA[c["name"]][1](c) for c in criteria]) + math.hypot(*footprint) + 2 * CELL
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
    asked = candidates.select("id", "n", "e").groupBy(F.floor(F.col("n") / (CELL * TILE)).cast("long").alias("tr"), F.floor(F.col("e") / (CELL * TILE)).cast("long").alias("tc"), share.alias("share"))
    asked = asked.agg(F.collect_list(F.struct("id", "n", "e")).alias("candidates")).withColumn("id", F.concat_ws(":", "tr", "tc", "share"))
    side = CELL * TILE
    if names & {"scenery_max", "clearing_max", "scenery_in_footprint_max"}:
        far = max([c.get("radius", 150.0) for c in criteria if c["name"] in ("scenery_max", "clearing_max")] + [OBJECT_REACH + math.hypot(*footprint)])
        span = lambda v: F.explode(F.sequence(F.floor((F.col(v) - far) / side).cast("long"), F.floor((F.col(v) + far) / side).cast("long")))
        near = terrain.objects().select("n", "e", "class", "w", "d", "rotation").withColumn("tr", span("n")).withColumn("tc", span("e"))
        near = near.groupBy("tr", "tc").agg(F.collect_list(F.struct("n", "e", "class", "w", "d", "rotation")).alias("objects"))
        asked = asked.join(near, ["tr", "tc"], "left")
    for name, kind in (("road", ROAD), ("rail", RAIL)):
        if f"dist_{name}_band" in names:
            lines = terrain.table("edges").where(F.col("kind") == kind)
            asked = asked.join(F.broadcast(lines.agg(F.collect_list(F.transform("points", lambda p: F.struct(p["n"].alias("n"), p["e"].alias("e")))).alias(name))))
    if "dist_airdrome_band" in names:
        asked = asked.join(F.broadcast(terrain.table("airdromes").agg(F.collect_list(F.struct("airdrome_id", "name_id", "display_name", "n", "e")).alias("airdromes"))))
    if names & {"enclosure_min", "masked_from"}:
        box = candidates.agg(*(f(v).alias(f"{k}{v}") for k, f in (("lo", F.min), ("hi", F.max)) for v in ("n", "e"))).first()
        if box["lon"] is not None:
            cell = lambda v: int(v // CELL)
            bins = windows.horizon(terrain, (cell(box["lon"]), cell(box["hin"])), (cell(box["loe"]), cell(box["hie"])))
            per = TILE // R.HORIZON_SPAN
            bins = bins.groupBy(F.floor(F.col("hr") / per).alias("tr"), F.floor(F.col("hc") / per).alias("tc")).agg(F.collect_list(F.struct("hr", "hc", "bins")).alias("horizon"))
            asked = asked.join(bins, ["tr", "tc"], "left")

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        lines = {k: [np.array([(p["n"], p["e"]) for p in line]) for line in q.get(k) or ()] for k in ("road", "rail")}
        a = Around(block, q.get("objects") or [], lines, {(h["hr"], h["hc"]): h["bins"] for h in q.get("horizon") or ()}, q.get("airdromes") or [], [], *footprint)
        mine = []
        for c in criteria:
            c = dict(c)
            points_ = c.get("observers") or c.get("targets")
            if points_:
                g = block.ground(np.array([p[0] for p in points_]), np.array([p[1] for p in points_]))
                c["__ends"] = [(p[0], p[1], float(h) + p[2]) for p, h in zip(points_, g, strict=True)]
            mine.append(c)
        fields = [f.split()[0] for f in TERMS.split(", ")]
        out: dict[str, list] = {k: [] for k in fields}
        for s in q["candidates"]:
            for k, deg in enumerate(orientations):
                got = [CRITERIA[c["name"]][0](a, s["n"], s["e"], deg, c) for c in mine]
                total = sum(weights.get(c["name"], 1.0) * g[2] for c, g in zip(mine, got, strict=True))
                row = (s["id"], s["n"], s["e"], deg, k, all(g[1] for g in got), total, [None if math.isnan(g[0]) else float(g[0]) for g in got], [bool(g[1]) for g in got], [float(g[2]) for g in got])
                for name, v in zip(fields, row, strict=True):
                    out[name].append(v)
        return out

    edge = lambda v, k: F.col(v) * TILE + k
    pad = math.ceil(reach / CELL)
    window = {"row": edge("tr", -pad), "col": edge("tc", -pad), "row_end": edge("tr", TILE + pad), "col_end": edge("tc", TILE + pad)}
    for v, low, high, i in (("n", "row", "row_end", 0), ("e", "col", "col_end", 1)):
        spots = [p[i] for ends in sights for p in ends]
        if spots:
            window[low] = F.least(window[low], F.lit(int(min(spots) // CELL) - 2))
            window[high] = F.greatest(window[high], F.lit(int(max(spots) // CELL) + 2))
    return on_blocks(terrain, asked, {k: v.cast("long") for k, v in window.items()}, kernel, TERMS)


def best_orientation(terms: DataFrame) -> DataFrame:
    """One row a candidate: passing first, then the higher score, ties to the orientation first given."""
    w = Window.partitionBy("id").orderBy(F.desc("pass"), F.desc("score"), "ord")
    return terms.withColumn("rnk", F.row_number().over(w)).where("rnk = 1").drop("rnk", "ord")


def find_sites(terrain: Terrain, region: S.Region, criteria: list[dict], step: float = 2 * CELL, spacing: float = 0.0, limit: int = 20, **options) -> DataFrame:
    """The best passing sites of a region's lattice, by score, then north, then east, none nearer to a better one than ``spacing``."""
    lattice = points.lattice(terrain, region, step, 1 << 18)
    s, w, _, _ = region.bounds()
    index = F.floor((F.col("n") - s) / step + 0.5) * (1 << 20) + F.floor((F.col("e") - w) / step + 0.5)
    best = best_orientation(score_sites(terrain, lattice.select(index.cast("long").alias("id"), "n", "e"), criteria, **options)).where("pass")
    return spaced(best, spacing, limit)


def spaced(sites: DataFrame, spacing: float, limit: int = 20) -> DataFrame:
    """Greedy suppression in order of score, north, east: each kept unless a kept one is nearer than the spacing.

    Inherently sequential; reads the sorted rows one partition at a time and
    stops at ``limit`` (200 at most).
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    kept: list = []
    for row in sites.orderBy(F.desc("score"), "n", "e").toLocalIterator():
        if all(math.hypot(row["n"] - k["n"], row["e"] - k["e"]) >= spacing for k in kept):
            kept.append(row)
            if len(kept) == limit:
                break
    return sites.sparkSession.createDataFrame(kept, sites.schema).withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("score"), "n", "e")))


# --- scenery and placements


def scenery_in(terrain: Terrain, regions: DataFrame, pools: tuple[str, ...] = ("objects",), classes: tuple[str, ...] = ()) -> DataFrame:
    """(id, pool, class, objects, first_id) in each circle (id, n, e, radius), edge included; effects only when named.

    Circles are entered in every square of two kilometres that they meet.
    """
    side = 2000.0
    span = lambda v: F.explode(F.sequence(F.floor((F.col(v) - F.col("radius")) / side).cast("long"), F.floor((F.col(v) + F.col("radius")) / side).cast("long")))
    asked = regions.select("id", "n", "e", "radius").withColumn("qr", span("n")).withColumn("qc", span("e"))
    objects = terrain.objects(pools, effects="effect" in classes)
    if classes:
        objects = objects.where(F.col("class").isin(*classes))
    objects = objects.select(F.col("id").alias("oid"), "pool", "class", F.col("n").alias("on"), F.col("e").alias("oe"))
    placed = objects.withColumns({"qr": F.floor(F.col("on") / side).cast("long"), "qc": F.floor(F.col("oe") / side).cast("long")})
    dn, de = F.col("on") - F.col("n"), F.col("oe") - F.col("e")
    met = asked.join(placed, ["qr", "qc"]).where(dn * dn + de * de <= F.col("radius") * F.col("radius"))
    return met.groupBy("id", "pool", "class").agg(F.count("*").alias("objects"), F.min("oid").alias("first_id"))


def counts_by(found: DataFrame) -> DataFrame:
    """(id, pool, class, objects): counts by pool and class, and by class over all pools (pool null)."""
    return found.groupingSets([["id", "pool", "class"], ["id", "class"]], "id", "pool", "class").agg(F.sum("objects").alias("objects"))


PLACED = "id long, cells long, relief double, max_slope double, min_depth double, covers array<string>, objects_met long, nearest_ids array<long>, issues array<string>, verdict string"


def validate_placements(terrain: Terrain, placements: DataFrame) -> DataFrame:
    """Checks of shapes: (id, kind, n, e, radius, w, d, rotation, points, afloat, max_slope, min_depth, allow_forest).

    A shape is a point, a disc, a box (``w`` north, ``d`` east, turned clockwise by
    ``rotation`` degrees) or a convex polygon of ``points`` (n, e).  Issues are no_ground, water, land, forest, shallow,
    slope, objects and pavement; the verdict is the first of them, else ok.
    """
    reach = F.greatest(F.coalesce("radius", F.lit(0.0)), F.sqrt(F.coalesce("w", F.lit(0.0)) * F.coalesce("w", F.lit(0.0)) + F.coalesce("d", F.lit(0.0)) * F.coalesce("d", F.lit(0.0))))
    far = F.aggregate(F.coalesce("points", F.array().cast("array<struct<n:double,e:double>>")), F.lit(0.0), lambda s, p: F.greatest(s, F.sqrt((p["n"] - F.col("n")) * (p["n"] - F.col("n")) + (p["e"] - F.col("e")) * (p["e"] - F.col("e")))))
    asked = placements.withColumn("__reach", F.greatest(reach, far))
    side = 1000.0
    wide = F.col("__reach") + OBJECT_REACH
    span = lambda v: F.explode(F.sequence(F.floor((F.col(v) - wide) / side).cast("long"), F.floor((F.col(v) + wide) / side).cast("long")))
    squares = asked.select("id", "n", "e", "__reach").withColumn("qr", span("n")).withColumn("qc", span("e"))
    objects = terrain.objects(("objects", "lines", "trees")).select(F.col("id").alias("oid"), "pool", F.col("n").alias("on"), F.col("e").alias("oe"), "w", "d", "rotation")
    size = F.sqrt(F.col("w") * F.col("w") + F.col("d") * F.col("d")) / 2
    dn, de = F.col("on") - F.col("n"), F.col("oe") - F.col("e")
    near = squares.join(objects.withColumns({"qr": F.floor(F.col("on") / side).cast("long"), "qc": F.floor(F.col("oe") / side).cast("long")}), ["qr", "qc"])
    # circles around both that do not meet leave nothing to test
    near = near.where(F.sqrt(dn * dn + de * de) <= F.col("__reach") + size + 1).groupBy("id").agg(F.collect_list(F.struct("oid", "pool", F.col("on").alias("n"), F.col("oe").alias("e"), "w", "d", "rotation")).alias("__near"))
    paint = terrain.table("paint").agg(F.collect_list(F.struct("n1", "e1", "n2", "e2", "n3", "e3")).alias("__paint"))
    asked = asked.join(near, "id", "left").join(F.broadcast(paint))
    fields = [f.split()[0] for f in PLACED.split(", ")]
    cover_names = R.COVER_NAMES
    water_names = {1: "lake", 2: "sea", 3: "river"}

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        shape = shape_of(q)
        o = shape.middle()
        local = shape.moved(-o[0], -o[1])
        if q["kind"] == "point":
            cells, at = [(math.floor(q["n"] / CELL), math.floor(q["e"] / CELL))], (np.array([q["n"]]), np.array([q["e"]]))
        else:
            cells = S.covered_cells(shape)
            at = tuple((np.array([c[k] for c in cells]) + 0.5) * CELL for k in (0, 1))
        i, j = (np.array([c[k] for c in cells]) for k in (0, 1))
        i, j = i - block.row, j - block.col
        form = block.form
        if form is not None:
            g = form.ground(*at)
            on, depth, water, cover, wood = g["on"], g["depth"], g["water"], g["cover"], g["forest"]
        else:
            on, depth, water, cover = ~np.isnan(block.h[i, j]), np.full(len(i), np.nan), block.water[i, j], block.cover[i, j]
            wood = cover == COVER["forest"]
        slope = block.slope()[i, j]
        issues = []
        if (~on).any():
            issues.append("no_ground")
        if q["afloat"]:
            if (on & (water == 0)).any():
                issues.append("land")
        else:
            issues += [f"water_{name}" for code, name in water_names.items() if (on & (water == code)).any()]
            if (on & wood).any() and not q["allow_forest"]:
                issues.append("forest")
        wet = depth[on & (water != 0)]
        wet = wet[~np.isnan(wet)]
        if q["min_depth"] is not None and len(wet) and wet.min() < q["min_depth"]:
            issues.append("shallow")
        steep = slope[~np.isnan(slope)]
        if q["max_slope"] is not None and len(steep) and steep.max() > q["max_slope"]:
            issues.append("slope")
        met = [x for x in q["__near"] or () if local.meets(object_shape(x).moved(-o[0], -o[1]))]
        met.sort(key=lambda x: (math.hypot(x["n"] - q["n"], x["e"] - q["e"]), x["oid"]))
        if met:
            issues.append("objects")
        if any(local.meets(S.Shape(((t["n1"] - o[0], t["e1"] - o[1]), (t["n2"] - o[0], t["e2"] - o[1]), (t["n3"] - o[0], t["e3"] - o[1])))) for t in q["__paint"] or ()):
            issues.append("pavement")
        h = block.h[i, j]
        row = (
            q["id"], len(cells), float(np.nanmax(h) - np.nanmin(h)) if (~np.isnan(h)).any() else None, float(steep.max()) if len(steep) else None, float(wet.min()) if len(wet) else None,
            [cover_names[c] for c in sorted({int(c) for c in cover[on]})], len(met), [x["oid"] for x in met[:LISTED]], issues, issues[0] if issues else "ok",
        )
        return {k: [v] for k, v in zip(fields, row, strict=True)}

    return on_blocks(terrain, asked, around(F.col("n"), F.col("e"), F.col("__reach")), kernel, PLACED, together=True)


def shape_of(q: dict) -> S.Shape:
    if q["kind"] == "disc":
        return S.Shape(((q["n"], q["e"]),), q["radius"])
    if q["kind"] == "box":
        return S.turned_box(q["n"], q["e"], q["w"], q["d"], math.radians(q["rotation"] or 0.0))
    if q["kind"] == "polygon":
        return S.Shape(tuple((p["n"], p["e"]) for p in q["points"]))
    return S.Shape(((q["n"], q["e"]),))


def object_shape(o: dict) -> S.Shape:
    """An object's turned box, or of a tree the circle in it."""
    if o["pool"] == "trees":
        return S.Shape(((o["n"], o["e"]),), min(o["w"], o["d"]) / 2)
    return S.turned_box(o["n"], o["e"], o["w"], o["d"], o["rotation"])
