"""Kernels over windows of cells: requests or tiles meet the stored tiles that they need.

A request goes to the tiles of its window by an equi-join on tile keys, and the
tiles of one request come together in one task.  A window is bounded
(``MOST_CELLS``), so a task's memory is, whatever the table of requests holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster as R
from ..sources.catalog import LAYERS, Terrain
from ..sources.synthetic import CELL, COVER, RAIL, ROAD, SEA, TILE

#: Cells of one window at most.
MOST_CELLS = 4 << 20
#: Requests that may share a block if all lie in one tile.
TOGETHER = 20_000
_TILE_FIELDS = ("tile_r", "tile_c", *LAYERS)


def around(n: Column, e: Column, reach: Column) -> dict[str, Column]:
    """The window of cells within a distance of a point, with two cells to spare."""
    low = lambda v: (F.floor((v - reach) / CELL) - 2).cast("long")
    high = lambda v: (F.floor((v + reach) / CELL) + 2).cast("long")
    return {"row": low(n), "col": low(e), "row_end": high(n), "col_end": high(e)}


def on_blocks(terrain: Terrain, requests: DataFrame, window: dict[str, Column], kernel: Callable[[dict, R.Block], dict[str, list]], schema: str, key: str = "id", together: bool = False) -> DataFrame:
    """The rows that ``kernel`` makes of each request and the block of cells of its window.

    ``key`` tells requests apart; a window of more than ``MOST_CELLS`` cells is an error.
    With ``together`` the requests whose windows begin in one tile share a block: for
    kernels that read a few cells, whose tiles would be most of the work.  A tile's
    requests are split in as many shares as ``TOGETHER`` goes into all of them.
    """
    asked = requests.withColumns({f"__w_{k}": v for k, v in window.items()})
    plain = list(requests.columns)
    if together:
        tile = lambda v: F.floor(F.col(v) / TILE).alias(f"__t{v}")
        own = F.struct(*(F.col(f"`{c}`") for c in plain))
        ends = [f(c).alias(c) for f, c in ((F.min, "__w_row"), (F.min, "__w_col"), (F.max, "__w_row_end"), (F.max, "__w_col_end"))]
        asked = asked.groupBy(tile("__w_row"), tile("__w_col"), F.pmod(F.xxhash64(key), F.lit(1 + requests.count() // TOGETHER)).alias("__share")).agg(F.collect_list(own).alias("__all"), *ends)
    else:
        asked = asked.withColumn("__all", F.array(F.struct(*(F.col(f"`{c}`") for c in plain))))
    groups = ["__t__w_row", "__t__w_col", "__share"] if together else [key]
    asked = asked.select(*groups, "__all", "__w_row", "__w_col", "__w_row_end", "__w_col_end")
    span = lambda a, b: F.sequence(F.floor(F.col(a) / TILE).cast("int"), F.floor(F.col(b) / TILE).cast("int"))
    keys = asked.withColumn("tile_r", F.explode(span("__w_row", "__w_row_end"))).withColumn("tile_c", F.explode(span("__w_col", "__w_col_end")))
    # the first tile of a window carries its requests
    first = (F.col("tile_r") == F.floor(F.col("__w_row") / TILE)) & (F.col("tile_c") == F.floor(F.col("__w_col") / TILE))
    joined = keys.withColumn("__all", F.when(first, F.col("__all"))).join(terrain.tiles(), ["tile_r", "tile_c"], "left")
    form, names = terrain.form, [f.split()[0] for f in schema.split(", ")]
    kinds = pa.schema([(n, arrow_type(t)) for n, t in (f.split(maxsplit=1) for f in schema.split(", "))])

    def run(table: pa.Table) -> pa.Table:
        row, col, row_end, col_end = (table.column(f"__w_{k}")[0].as_py() for k in ("row", "col", "row_end", "col_end"))
        rows, cols = row_end - row + 1, col_end - col + 1
        if rows * cols > MOST_CELLS:
            raise ValueError(f"a window of {rows} x {cols} cells is more than {MOST_CELLS}")
        tiles = [t for t in zip(*(table.column(f).to_pylist() for f in _TILE_FIELDS), strict=True) if t[2] is not None]
        block = R.Block.from_tiles(tiles, row, col, rows, cols, form)
        made = [kernel(q, block) for all_ in table.column("__all").to_pylist() for q in all_ or ()]
        if len(made) == 1:
            return pa.table({n: made[0][n] for n in names}, schema=kinds)
        return pa.table({n: [v for m in made for v in m[n]] for n in names}, schema=kinds)

    return joined.groupBy(*groups).applyInArrow(run, schema)


def arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(arrow_type(kind[6:-1]))
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind]


# --- layers by name


def _distance(name: str) -> Callable:
    def seeds(block: R.Block, marks: dict[str, np.ndarray]) -> np.ndarray:
        if name == "water":
            return block.water > 0
        if name == "sea":
            return block.water == SEA
        if name == "builtup":
            return R.disk_sum(marks["building"], BUILTUP_RADIUS) >= BUILTUP_LEAST
        if name in COVER:
            return block.cover == COVER[name]
        return marks[name] > 0

    def layer(block: R.Block, marks: dict[str, np.ndarray]) -> np.ndarray:
        d = R.distance(seeds(block, marks))
        return np.where(d >= R.DISTANCE_CAP, np.nan, d)

    return layer


# Radii of the counts, densities and shares, and what counts as built up.
COUNT_RADIUS, DENSITY_RADIUS, SHARE_RADIUS = 1000.0, 300.0, 300.0
BUILTUP_RADIUS, BUILTUP_LEAST = 100.0, 3.0
_slopes = lambda k, block, marks: R.slope_layers(block.h)[k]
_hectares = lambda radius: (R.disk_sum(np.ones((2 * int(radius // CELL) + 1,) * 2), radius).max()) * CELL * CELL / 1e4
_code = lambda name, block, marks: np.where(getattr(block, name) < 0, np.nan, getattr(block, name))

#: Layer: metres of ground needed around a cell, marks needed, and the kernel.
LAYER: dict[str, tuple[float, tuple[str, ...], Callable]] = {
    "height": (0, (), lambda b, m: b.h),
    "water": (0, (), partial(_code, "water")),
    "surface": (0, (), partial(_code, "surface")),
    "cover": (0, (), partial(_code, "cover")),
    "valid": (0, (), lambda b, m: ((~np.isnan(b.h)) & (b.water != SEA)).astype(float)),
    "slope": (CELL, (), partial(_slopes, "slope")),
    "aspect": (CELL, (), partial(_slopes, "aspect")),
    "roughness": (CELL, (), partial(_slopes, "roughness")),
    "tpi_300": (300, (), lambda b, m: R.position(b.h, 300)),
    "tpi_2000": (2000, (), lambda b, m: R.position(b.h, 2000)),
    "count_building": (COUNT_RADIUS, ("building",), lambda b, m: R.disk_sum(m["building"], COUNT_RADIUS)),
    "count_industrial": (COUNT_RADIUS, ("industrial",), lambda b, m: R.disk_sum(m["industrial"], COUNT_RADIUS)),
    "tree_density": (DENSITY_RADIUS, ("trees",), lambda b, m: R.disk_sum(m["trees"], DENSITY_RADIUS) / _hectares(DENSITY_RADIUS)),
    "line_density": (DENSITY_RADIUS, ("lines",), lambda b, m: R.disk_sum(m["lines"], DENSITY_RADIUS) / _hectares(DENSITY_RADIUS)),
    **{f"share_{c}": (SHARE_RADIUS, (), partial(lambda code, b, m: R.cover_share(b.cover, code, SHARE_RADIUS), code)) for c, code in COVER.items()},
    "dist_road": (R.DISTANCE_CAP, ("road",), _distance("road")),
    "dist_rail": (R.DISTANCE_CAP, ("rail",), _distance("rail")),
    "dist_water": (R.DISTANCE_CAP, (), _distance("water")),
    "dist_sea": (R.DISTANCE_CAP, (), _distance("sea")),
    "dist_builtup": (R.DISTANCE_CAP + BUILTUP_RADIUS, ("building",), _distance("builtup")),
    **{f"dist_{c}": (R.DISTANCE_CAP, (), _distance(c)) for c in COVER if c != "water"},
}
HORIZON_LAYERS = ("enclosure", *(f"horizon_{b}" for b in range(R.BINS)))


def marks(terrain: Terrain, kinds: set[str]) -> DataFrame:
    """(tile_r, tile_c, marks: array of (kind, cell, count)): objects by cell, and the cells that a network's lines cross.

    Counted by cell first, so a tile carries 4096 entries of a kind at most.
    """
    cell = lambda v: F.floor(F.col(v) / CELL).cast("long")
    parts = []
    if kinds & {"building", "industrial", "trees", "lines"}:
        kind = F.when(F.col("pool") == "objects", F.col("class")).otherwise(F.col("pool"))
        objects = terrain.objects(tuple(p for p in ("objects", "trees", "lines") if p in kinds or p == "objects")).select(kind.alias("kind"), cell("n").alias("r"), cell("e").alias("c"))
        parts.append(objects.where(F.col("kind").isin(*kinds)).groupBy("kind", "r", "c").agg(F.count("*").alias("count")))
    if kinds & {"road", "rail"}:
        names = {ROAD: "road", RAIL: "rail"}
        wanted = [k for k, v in names.items() if v in kinds]

        def cross(batches):
            for b in batches:
                rows = sorted({(names[k], r, c) for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p, q in zip(line, line[1:], strict=False) for r, c, s, t in R.crossed((p["n"], p["e"]), (q["n"], q["e"])) if t > s})
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["kind", "r", "c"])

        lines = terrain.table("edges").where(F.col("kind").isin(*wanted)).select("kind", "points").mapInArrow(cross, "kind string, r long, c long")
        parts.append(lines.distinct().withColumn("count", F.lit(1).cast("long")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    place = (F.pmod(F.col("r"), F.lit(TILE)) * TILE + F.pmod(F.col("c"), F.lit(TILE))).cast("int")
    tile = lambda v: F.floor(F.col(v) / TILE).cast("int")
    return every.groupBy(tile("r").alias("tile_r"), tile("c").alias("tile_c")).agg(F.collect_list(F.struct("kind", place.alias("cell"), F.col("count").cast("double").alias("count"))).alias("marks"))


def layer_cells(terrain: Terrain, names: list[str], tiles: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """(r, c, one double column a name) for every cell of the wanted tiles (tile_r, tile_c), null where undefined.

    Each tile is computed from itself and a rim of neighbours as wide as its
    layers look; ``rows`` and ``cols`` keep a window only.
    """
    unknown = [n for n in names if n not in LAYER]
    if unknown:
        raise ValueError(f"no layer {', '.join(unknown)}; the layers are {', '.join([*LAYER, *HORIZON_LAYERS])}")
    halo = max(math.ceil(LAYER[n][0] / CELL) for n in names)
    kinds = {k for n in names for k in LAYER[n][1]}
    rim = -(-halo // TILE)
    form = terrain.form
    steps = F.explode(F.sequence(F.lit(-rim), F.lit(rim)))
    wanted = tiles.select(F.col("tile_r").alias("tr"), F.col("tile_c").alias("tc")).distinct().withColumn("dr", steps).withColumn("dc", steps)
    wanted = wanted.select("tr", "tc", (F.col("tr") + F.col("dr")).alias("tile_r"), (F.col("tc") + F.col("dc")).alias("tile_c"))
    stored = terrain.tiles((rows[0] - halo, rows[1] + halo) if rows else None, (cols[0] - halo, cols[1] + halo) if cols else None)
    if kinds:
        stored = stored.join(marks(terrain, kinds), ["tile_r", "tile_c"], "left")
    joined = wanted.join(stored, ["tile_r", "tile_c"], "left")

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        r0, c0, side = tr * TILE, tc * TILE, TILE + 2 * halo
        known = table.to_pylist()
        block = R.Block.from_tiles([tuple(t[f] for f in _TILE_FIELDS) for t in known if t["height"] is not None], r0 - halo, c0 - halo, side, side, form)
        counts = {k: np.zeros((side, side)) for k in kinds}
        for t in known if kinds else ():
            for m in t["marks"] or ():
                i, j = t["tile_r"] * TILE + m["cell"] // TILE - r0 + halo, t["tile_c"] * TILE + m["cell"] % TILE - c0 + halo
                if 0 <= i < side and 0 <= j < side and m["kind"] in counts:
                    counts[m["kind"]][i, j] = m["count"]
        r, c = np.meshgrid(np.arange(r0, r0 + TILE), np.arange(c0, c0 + TILE), indexing="ij")
        keep = np.ones((TILE, TILE), bool)
        for v, span in ((r, rows), (c, cols)):
            if span:
                keep &= (v >= span[0]) & (v <= span[1])
        cut = slice(halo, halo + TILE)
        out = {"r": pa.array(r[keep]), "c": pa.array(c[keep])}
        for name in names:
            v = LAYER[name][2](block, counts)[cut, cut][keep]
            out[name] = pa.array(v, mask=np.isnan(v))
        return pa.table(out)

    return joined.groupBy("tr", "tc").applyInArrow(run, ", ".join(["r long", "c long", *(f"{n} double" for n in names)]))


def tiles_of(terrain: Terrain, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The keys of the tiles that a window of cells meets, the terrain's or not."""
    spark = terrain.spark
    a = spark.range(rows[0] // TILE, rows[1] // TILE + 1).select(F.col("id").cast("int").alias("tile_r"))
    return a.join(spark.range(cols[0] // TILE, cols[1] // TILE + 1).select(F.col("id").cast("int").alias("tile_c")))


def layers(terrain: Terrain, names: list[str], rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """(r, c, layers) of a window of cells, its last row and column included."""
    return layer_cells(terrain, names, tiles_of(terrain, rows, cols), rows, cols)


def zone_map(terrain: Terrain, names: list[str], rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """(tile_r, tile_c, least and greatest of each layer): what a tile can hold, for leaving it out of a search."""
    tile = lambda v: F.floor(F.col(v) / TILE).cast("int")
    ends = [f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max))]
    return layers(terrain, names, rows, cols).groupBy(tile("r").alias("tile_r"), tile("c").alias("tile_c")).agg(*ends)


def horizon(terrain: Terrain, rows: tuple[int, int], cols: tuple[int, int], reach: float = R.HORIZON_RANGE) -> DataFrame:
    """(hr, hc, bins, enclosure) of the horizon cells (four by four cells) that a window of cells meets.

    Bins are degrees; null where the centre has no ground.  Horizon cells are
    computed in batches of a tile, each from the ground within ``reach``.
    """
    span = R.HORIZON_SPAN
    per = TILE // span
    hr, hc = (rows[0] // span, rows[1] // span), (cols[0] // span, cols[1] // span)
    asked = tiles_of(terrain, rows, cols).select(F.col("tile_r").alias("tr"), F.col("tile_c").alias("tc"), F.concat_ws(":", "tile_r", "tile_c").alias("id"))
    k = int(reach // CELL) + 2
    window = {"row": F.col("tr") * TILE - k, "col": F.col("tc") * TILE - k, "row_end": (F.col("tr") + 1) * TILE + k, "col_end": (F.col("tc") + 1) * TILE + k}

    def kernel(request: dict, block: R.Block) -> dict[str, list]:
        i, j = np.meshgrid(np.arange(request["tr"] * per, (request["tr"] + 1) * per), np.arange(request["tc"] * per, (request["tc"] + 1) * per), indexing="ij")
        keep = (i >= hr[0]) & (i <= hr[1]) & (j >= hc[0]) & (j <= hc[1])
        cells = np.stack([i[keep], j[keep]], 1)
        angles = R.code_degrees(R.horizon_codes(block, cells, reach))
        known = ~np.isnan(angles).any(1)
        bins = [a.tolist() if ok else None for a, ok in zip(angles, known, strict=True)]
        return {"hr": cells[:, 0].tolist(), "hc": cells[:, 1].tolist(), "bins": bins, "enclosure": [float(np.mean(b)) if b else None for b in bins]}

    window = {n: v.cast("long") for n, v in window.items()}
    return on_blocks(terrain, asked, window, kernel, "hr long, hc long, bins array<double>, enclosure double")
