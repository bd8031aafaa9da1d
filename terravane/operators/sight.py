"""Line of sight: exact between points, swept around sites, gathered over many sites.

Every request (id, ...) meets the tiles of its own window, so requests spread
over the cluster and none of them is gathered on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import raster as R
from ..functions import shapes as S
from ..sources.catalog import Terrain
from ..sources.synthetic import CELL
from .windows import around, on_blocks

#: Heights above ground of the bands of coverage, metres.
BANDS = (30.0, 100.0, 300.0, 1000.0)


def visible(terrain: Terrain, pairs: DataFrame) -> DataFrame:
    """Whether the ends of each (id, n1, e1, a1, n2, e2, a2) see each other; altitudes above ground.

    With the least gap between line and ground, and where the line is first
    blocked; null where an end has no ground.  A terrain with a closed form
    needs no tiles, so its pairs are not shuffled.
    """
    names = ["visible", "clearance", "block_n", "block_e", "block_h"]
    kinds = ["boolean", "double", "double", "double", "double"]

    def seen(block: R.Block, q: dict) -> list:
        g = block.ground(np.array([q["n1"], q["n2"]]), np.array([q["e1"], q["e2"]]))
        if np.isnan(g).any():
            return [None] * 5
        a, b = (q["n1"], q["e1"], float(g[0]) + q["a1"]), (q["n2"], q["e2"], float(g[1]) + q["a2"])
        ok, gap, at = R.exact_line(block, a, b)
        return [ok, min(q["a1"], q["a2"]) if math.isnan(gap) else gap, *(at or (None, None, None))]

    if terrain.form is not None:
        import pyarrow as pa

        none = R.Block(0, 0, *(np.zeros((0, 0)),) * 4, terrain.form)

        def run(batches):
            for b in batches:
                rows = [seen(none, q) for q in b.to_pylist()]
                made = [pa.array([r[i] for r in rows], {"boolean": pa.bool_(), "double": pa.float64()}[k]) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["id", *names])

        return pairs.select("id", "n1", "e1", "a1", "n2", "e2", "a2").mapInArrow(run, ", ".join(["id long", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))

    low, high = (lambda a, b: F.least(F.col(a), F.col(b))), (lambda a, b: F.greatest(F.col(a), F.col(b)))
    window = {"row": F.floor(low("n1", "n2") / CELL) - 2, "col": F.floor(low("e1", "e2") / CELL) - 2, "row_end": F.floor(high("n1", "n2") / CELL) + 2, "col_end": F.floor(high("e1", "e2") / CELL) + 2}
    kernel = lambda q, block: {"id": [q["id"]], **{n: [v] for n, v in zip(names, seen(block, q), strict=True)}}
    return on_blocks(terrain, pairs, {k: v.cast("long") for k, v in window.items()}, kernel, ", ".join(["id long", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))


def _swept(q: dict, block: R.Block) -> R.Sweep | None:
    eye = float(block.ground(np.array([q["n"]]), np.array([q["e"]]))[0])
    return None if math.isnan(eye) else R.sweep(block, q["n"], q["e"], eye + q["a"], q["radius"])


def radar_floor(terrain: Terrain, sites: DataFrame) -> DataFrame:
    """(id, r, c, d, h, floor_agl) of every cell with ground within the radius of each site (id, n, e, a, radius).

    The floor is the least height above ground that the site sees; a site
    without ground gives no rows.
    """

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        s = _swept(q, block)
        if s is None:
            return {k: [] for k in ("id", "r", "c", "d", "h", "floor_agl")}
        return {"id": np.full(len(s.r), q["id"]), "r": s.r, "c": s.c, "d": s.d, "h": s.h, "floor_agl": s.floor}

    return on_blocks(terrain, sites, around(F.col("n"), F.col("e"), F.col("radius")), kernel, "id long, r long, c long, d double, h double, floor_agl double")


def viewshed(terrain: Terrain, sites: DataFrame) -> DataFrame:
    """(id, r, c, seen): whether each site (..., target) sees a target over each cell."""
    asked = sites.select("id", "target")
    return radar_floor(terrain, sites.drop("target")).join(asked, "id").select("id", "r", "c", (F.round("floor_agl", 3) <= F.col("target")).alias("seen"))


def mask(terrain: Terrain, sites: DataFrame, within: float = CELL / 2) -> DataFrame:
    """(id, row, col, rows, cols, bits, visible_fraction, polygons): each viewshed as one row.

    ``bits`` are base64, most significant first, row by row; the seen cells'
    outlines, simplified to ``within`` metres, are a GeoJSON collection.
    """

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        import base64

        s = _swept(q, block)
        if s is None:
            return {k: [] for k in ("id", "row", "col", "rows", "cols", "bits", "visible_fraction", "polygons")}
        seen = np.round(s.floor, 3) <= q["target"]
        grid = np.zeros((int(np.ptp(s.r)) + 1, int(np.ptp(s.c)) + 1), bool)
        grid[s.r - s.r.min(), s.c - s.c.min()] = seen
        cells = set(zip(s.r[seen].tolist(), s.c[seen].tolist(), strict=True))
        drawn = [S.polygon_feature([S.simplified(ring, within) for ring in p], site=q["id"]) for p in S.outlines(cells)]
        return {
            "id": [q["id"]], "row": [int(s.r.min())], "col": [int(s.c.min())], "rows": [grid.shape[0]], "cols": [grid.shape[1]],
            "bits": [base64.b64encode(np.packbits(grid.ravel()).tobytes()).decode()], "visible_fraction": [float(seen.mean())], "polygons": [S.collection(drawn)],
        }

    return on_blocks(terrain, sites, around(F.col("n"), F.col("e"), F.col("radius")), kernel, "id long, row long, col long, rows long, cols long, bits string, visible_fraction double, polygons string")


def floor_raster(terrain: Terrain, sites: DataFrame) -> DataFrame:
    """(id, row, col, rows, cols, agl): each site's floor as one row, base64 of little-endian floats, NaN beyond its disk."""

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        import base64

        s = _swept(q, block)
        if s is None:
            return {k: [] for k in ("id", "row", "col", "rows", "cols", "agl")}
        grid = np.full((int(np.ptp(s.r)) + 1, int(np.ptp(s.c)) + 1), np.nan, "<f4")
        grid[s.r - s.r.min(), s.c - s.c.min()] = s.floor
        return {"id": [q["id"]], "row": [int(s.r.min())], "col": [int(s.c.min())], "rows": [grid.shape[0]], "cols": [grid.shape[1]], "agl": [base64.b64encode(grid.tobytes()).decode()]}

    return on_blocks(terrain, sites, around(F.col("n"), F.col("e"), F.col("radius")), kernel, "id long, row long, col long, rows long, cols long, agl string")


def floor_bands(terrain: Terrain, sites: DataFrame, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(id, alt_agl, covered_fraction, cells): the share of each site's disk seen at each height above ground."""
    each = F.explode(F.array(*(F.lit(b) for b in bands)))
    seen = F.avg(F.when(F.round("floor_agl", 3) <= F.col("alt_agl"), 1.0).otherwise(0.0))
    # heights are read off one row a site and height: cells are counted before the shuffle
    return radar_floor(terrain, sites).withColumn("alt_agl", each).groupBy("id", "alt_agl").agg(seen.alias("covered_fraction"), F.count("*").alias("cells"))


def coverage(terrain: Terrain, sites: DataFrame, bands: tuple[float, ...] = BANDS, least_masked: float = 8000.0, asset: S.Region | None = None) -> DataFrame:
    """``floor_bands`` with the dead cells, the share of an asset's cells seen and whether a blind way in exists."""
    cells = radar_floor(terrain, sites).withColumn("alt_agl", F.explode(F.array(*(F.lit(b) for b in bands))))
    seen = F.round("floor_agl", 3) <= F.col("alt_agl")
    mine = asset.condition((F.col("r") + 0.5) * CELL, (F.col("c") + 0.5) * CELL) if asset else F.lit(False)
    out = cells.groupBy("id", "alt_agl").agg(
        F.avg(F.when(seen, 1.0).otherwise(0.0)).alias("covered_fraction"),
        F.count("*").alias("cells"),
        F.sum(F.when(seen, 0).otherwise(1)).cast("long").alias("dead_cells"),
        F.coalesce(F.avg(F.when(mine, F.when(seen, 1.0).otherwise(0.0))), F.lit(0.0)).alias("asset_fraction"),
    )
    blind = spectrum(terrain, sites, bands, 5.0, least_masked).groupBy("id", "alt_agl").agg(F.bool_or("blind").alias("blind_approach_exists"))
    return out.join(blind, ["id", "alt_agl"], "left")


def point_floor(terrain: Terrain, asks: DataFrame) -> DataFrame:
    """(id, floor_msl, floor_agl): the exact least altitude over each point (id, n, e, a, pn, pe) that its site sees; infinite where none."""

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        g = block.ground(np.array([q["n"], q["pn"]]), np.array([q["e"], q["pe"]]))
        if math.isnan(g[0]):
            return {"id": [q["id"]], "floor_msl": [None], "floor_agl": [None]}
        msl = R.exact_floor(block, (q["n"], q["e"], float(g[0]) + q["a"]), (q["pn"], q["pe"]))
        msl = msl if math.isnan(g[1]) else max(msl, float(g[1]))
        return {"id": [q["id"]], "floor_msl": [msl], "floor_agl": [None if math.isnan(g[1]) else msl - float(g[1])]}

    window = {"row": F.floor(F.least("n", "pn") / CELL) - 2, "col": F.floor(F.least("e", "pe") / CELL) - 2, "row_end": F.floor(F.greatest("n", "pn") / CELL) + 2, "col_end": F.floor(F.greatest("e", "pe") / CELL) + 2}
    return on_blocks(terrain, asks, {k: v.cast("long") for k, v in window.items()}, kernel, "id long, floor_msl double, floor_agl double")


def exposure(terrain: Terrain, sites: DataFrame, target: float, bands: tuple[float, ...] = ()) -> DataFrame:
    """(r, c, floor_agl, seen_count, in_reach, unseen by band) of every cell that a site reaches: the least floor over all sites."""
    seen = F.round("floor_agl", 3) <= target
    unseen = [(F.round(F.min("floor_agl"), 3) > b).alias(f"unseen_{b:g}") for b in bands]
    return radar_floor(terrain, sites).groupBy("r", "c").agg(F.min("floor_agl").alias("floor_agl"), F.sum(F.when(seen, 1).otherwise(0)).cast("long").alias("seen_count"), F.count("*").alias("in_reach"), *unseen)


def exposure_in(terrain: Terrain, sites: DataFrame, rows: tuple[int, int], cols: tuple[int, int], target: float) -> DataFrame:
    """``exposure`` over a window of cells with ground: infinite floors where no site reaches."""
    cells = terrain.grid(rows, cols).where("h is not null").select("r", "c")
    out = cells.join(exposure(terrain, sites, target), ["r", "c"], "left")
    return out.select("r", "c", F.coalesce("floor_agl", F.lit(math.inf)).alias("floor_agl"), F.coalesce("seen_count", F.lit(0)).alias("seen_count"), F.coalesce("in_reach", F.lit(0)).alias("in_reach"))


def spectrum(terrain: Terrain, sites: DataFrame, bands: tuple[float, ...] = BANDS, step_deg: float = 5.0, least_masked: float = 8000.0) -> DataFrame:
    """(id, alt_agl, bearing_deg, unmask_dist, masked_fraction, blind): each bearing marched inward over the floor.

    A radial is blind if a target at the height is never seen on it or only
    within ``least_masked`` metres; one without ground is not.
    """
    if not 0.1 <= step_deg <= 90:
        raise ValueError("the azimuth step must be 0.1 to 90 degrees")
    count, half = round(360 / step_deg), CELL / 2

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        s = _swept(q, block)
        names = ("id", "alt_agl", "bearing_deg", "unmask_dist", "masked_fraction", "blind")
        out: dict[str, list] = {k: [] for k in names}
        if s is None:
            return out
        floor = np.full(block.shape, np.nan)
        floor[s.r - block.row, s.c - block.col] = np.round(s.floor, 3)
        d = np.arange(int(q["radius"] // half), 0, -1) * half
        for k in range(count):
            turn = math.radians(k * step_deg)
            r = np.floor((q["n"] + d * math.cos(turn)) / CELL).astype(int) - block.row
            c = np.floor((q["e"] + d * math.sin(turn)) / CELL).astype(int) - block.col
            f = floor[r, c]
            judged = ~np.isnan(f)
            for band in bands:
                with np.errstate(invalid="ignore"):
                    seen = judged & (f <= band)
                far = float(d[seen.argmax()]) if seen.any() else None
                share = float(1 - seen.sum() / judged.sum()) if judged.any() else 0.0
                row = (q["id"], band, k * step_deg, far, share, bool(judged.any() and (far is None or far < least_masked)))
                for name, v in zip(names, row, strict=True):
                    out[name].append(v)
        return out

    return on_blocks(terrain, sites, around(F.col("n"), F.col("e"), F.col("radius")), kernel, "id long, alt_agl double, bearing_deg double, unmask_dist double, masked_fraction double, blind boolean")


def blind_arcs(radials: DataFrame) -> DataFrame:
    """(id, alt_agl, from_deg, to_deg, radials): runs of blind bearings of ``spectrum``; one may close over north.

    Islands of equal flags are numbered by a running sum; the last one joins the
    first where both are blind.
    """
    w = Window.partitionBy("id", "alt_agl").orderBy("bearing_deg")
    turn = F.when(F.col("blind") == F.lag("blind").over(w), 0).otherwise(1)
    runs = radials.withColumn("turn", turn).withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    every = Window.partitionBy("id", "alt_agl")
    runs = runs.withColumns({"last": F.max("run").over(every), "first_blind": F.min(F.struct("bearing_deg", "blind")).over(every)["blind"], "last_blind": F.max(F.struct("bearing_deg", "blind")).over(every)["blind"]})
    closes = F.col("first_blind") & F.col("last_blind") & (F.col("last") > 1)
    runs = runs.withColumns({"wraps": closes & (F.col("run") == F.col("last")), "run": F.when(closes & (F.col("run") == F.col("last")), 1).otherwise(F.col("run"))})
    at = F.col("bearing_deg") - F.when(F.col("wraps"), 360.0).otherwise(0.0)
    out = runs.where("blind").groupBy("id", "alt_agl", "run").agg(F.min(at).alias("from_deg"), F.max(at).alias("to_deg"), F.count("*").alias("radials"))
    return out.withColumn("from_deg", F.when(F.col("from_deg") < 0, F.col("from_deg") + 360).otherwise(F.col("from_deg"))).drop("run")


def spectrum_summary(radials: DataFrame) -> DataFrame:
    """(id, alt_agl, blind_fraction, median_unmask, nearest_unmask, arcs) of ``spectrum``."""
    arcs = blind_arcs(radials).groupBy("id", "alt_agl").agg(F.count("*").alias("arcs"), F.max("radials").alias("widest"))
    out = radials.groupBy("id", "alt_agl").agg(F.avg(F.col("blind").cast("int")).alias("blind_fraction"), F.median("unmask_dist").alias("median_unmask"), F.min("unmask_dist").alias("nearest_unmask"))
    return out.join(arcs, ["id", "alt_agl"], "left").fillna(0, ["arcs", "widest"])


def unmask(terrain: Terrain, requests: DataFrame, step: float = 100.0) -> DataFrame:
    """(id, run, visible, samples, from_m, to_m): runs of seen and masked samples along each route.

    A request is (id, n, e, a, route: array of (n, e, a)), heights above ground.
    Samples lie every ``step`` metres and at the last point; one off the terrain
    is passed over.  A sample is seen as ``visible`` sees it; from a site without
    ground none is.
    """
    if not step > 0:
        raise ValueError("the step must be positive")

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "run", "visible", "samples", "from_m", "to_m")}
        eye = float(block.ground(np.array([q["n"]]), np.array([q["e"]]))[0]) + q["a"]
        at = samples([(p["n"], p["e"], p["a"]) for p in q["route"]], step)
        run = 0
        for along, n, e, a in at:
            g = float(block.ground(np.array([n]), np.array([e]))[0])
            if math.isnan(g):
                continue
            seen = not math.isnan(eye) and R.exact_line(block, (q["n"], q["e"], eye), (n, e, g + a))[0]
            if run and out["visible"][-1] == seen:
                out["samples"][-1] += 1
                out["to_m"][-1] = along
            else:
                run += 1
                for name, v in zip(out, (q["id"], run, seen, 1, along, along), strict=True):
                    out[name].append(v)
        return out

    n, e = F.transform("route", lambda p: p["n"]), F.transform("route", lambda p: p["e"])
    low = lambda own, all_: F.floor(F.least(F.col(own), F.array_min(all_)) / CELL) - 2
    high = lambda own, all_: F.floor(F.greatest(F.col(own), F.array_max(all_)) / CELL) + 2
    window = {"row": low("n", n), "col": low("e", e), "row_end": high("n", n), "col_end": high("e", e)}
    return on_blocks(terrain, requests, {k: v.cast("long") for k, v in window.items()}, kernel, "id long, run long, visible boolean, samples long, from_m double, to_m double")


def unmask_summary(runs: DataFrame) -> DataFrame:
    """(id, first_seen, visible_fraction, masked_segments) of ``unmask``."""
    return runs.groupBy("id").agg(
        F.min(F.when(F.col("visible"), F.col("from_m"))).alias("first_seen"),
        (F.sum(F.when(F.col("visible"), F.col("samples")).otherwise(0)) / F.sum("samples")).alias("visible_fraction"),
        F.sum(F.when(F.col("visible"), 0).otherwise(1)).cast("long").alias("masked_segments"),
    )


def samples(route: list[tuple[float, float, float]], step: float) -> list[tuple[float, float, float, float]]:
    """(along, n, e, a) every ``step`` metres of a route and at its end."""
    legs = [math.dist(p[:2], q[:2]) for p, q in zip(route, route[1:], strict=False)]
    total, out, before, k = sum(legs), [], 0.0, 0
    for (p, q), size in zip(zip(route, route[1:], strict=False), legs, strict=True):
        while k * step < before + size and k * step < total - step * 1e-6:
            u = (k * step - before) / size if size else 0.0
            out.append((k * step, *(x + u * (y - x) for x, y in zip(p, q, strict=True))))
            k += 1
        before += size
    return [*out, (total, *route[-1])]
