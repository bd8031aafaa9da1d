"""A terrain as a folder of Parquet tables, and the frames that operators read from it.

``tiles`` holds the four stored layers, 64 x 64 cells a row, in folders by tile
row; ``scenery`` lies in folders by pool and is sorted by hectometre columns, so
boxes prune files and row groups; the networks and the reference tables are small.
A terrain without a closed form takes its ground from the raster.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cluster import shared_dir, ship
from .synthetic import CELL, TILE, Form

SCHEMAS = {
    "tiles": "tile_r int, tile_c int, height binary, water binary, surface binary, cover binary",
    "scenery": "id long, pool string, model string, class string, family string, n double, e double, rotation double, w double, d double, tall double",
    "edges": "edge_id long, kind int, class string, a long, b long, length double, crosses_water boolean, points array<struct<n:double,e:double,h:double>>",
    "passes": "kind int, node long, from_edge long, to_edge long",
    "airdromes": "airdrome_id long, name_id string, display_name string, n double, e double, runway_names array<string>",
    "runways": "airdrome_id long, name_id string, name string, edge1 string, n1 double, e1 double, edge2 string, n2 double, e2 double, course_deg double",
    "paint": "airdrome_id long, n1 double, e1 double, n2 double, e2 double, n3 double, e3 double",
    "stands": "airdrome_id long, name string, class string, width double, length double, height double, helicopters boolean, airplanes boolean, n double, e double",
    "beacons": "airdrome_id long, callsign string, name string, frequency_hz double, channel long, n double, e double",
    "radio": "airdrome_id long, radio_id string, callsign string, hf double, fm double, vhf double, uhf double",
    "towns": "ord long, name string, n double, e double",
    "nodes": "node_id long, name string, red_n double, red_e double, blue_n double, blue_e double",
}
FOLDERS = {"tiles": ["tile_r"], "scenery": ["pool"]}
LAYERS = {"height": ("<i2", -32768), "water": ("u1", 255), "surface": ("u1", 0), "cover": ("u1", 0)}

# Name patterns of the classes, first match winning, and of the families.
CLASS_RULES = [
    ("effect", "smoke|fire_|effect"),
    ("wall", "fence|zabor|wall"),
    ("industrial", "sklad|him_bak|factory|zavod|angar|tank_|kotelnaya"),
]
FAMILY_RULES = [("farm", "farm|ferma"), ("outbuilding", "saray|shed|garage"), ("military", "kazarma|bunker|military"), ("apartment", "apart|dom_9|hrushevka"), ("shop", "shop|magazin"), ("civic", "school|hospital|church"), ("house", "home|house|dom")]


def classes(model: Column, w: Column, d: Column, tall: Column) -> tuple[Column, Column]:
    """Class and family of a model by its name and box: rules first, then size (under 4 square metres it is no building)."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(CLASS_RULES):
        kind = F.when(model.rlike(pattern), name).otherwise(kind)
    kind = F.coalesce(kind, F.when((w > 0) & (d > 0) & (w * d < 4), "misc").otherwise("building"))
    family = F.lit("unknown")
    for name, pattern in reversed(FAMILY_RULES):
        family = F.when(model.rlike(pattern), name).otherwise(family)
    return kind, F.when(kind == "industrial", "industrial").when(kind == "building", family)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Terrain:
    """The tables of one terrain; ``form`` is its closed form, if it has one."""

    def __init__(self, spark: SparkSession, path: str, form: Form | None = None, cells: int | None = None):
        self.spark, self.path, self.form = spark, path.rstrip("/"), form
        self.cells = form.cells if form else cells
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def tiles(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        """Tiles that meet a range of cell rows and columns, ends included."""
        out = self.table("tiles")
        for name, span in (("tile_r", rows), ("tile_c", cols)):
            if span:
                out = out.where(F.col(name).between(span[0] // TILE, span[1] // TILE))
        return out

    def grid(self, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
        """(r, c, n, e, h, water, surface, cover) of a window of cells; null layers where the terrain has none."""
        known = self.tiles(rows, cols).mapInArrow(_unpacked, "r long, c long, h long, water long, surface long, cover long")
        at = self.spark.range(rows[0], rows[1] + 1).select(F.col("id").alias("r")).join(self.spark.range(cols[0], cols[1] + 1).select(F.col("id").alias("c")))
        out = at.join(known, ["r", "c"], "left")
        return out.select("r", "c", ((F.col("r") + 0.5) * CELL).alias("n"), ((F.col("c") + 0.5) * CELL).alias("e"), "h", "water", "surface", "cover")

    def known_cells(self) -> DataFrame:
        """(r, c, h, water, surface, cover) of every stored cell; the rim of a tile may have none."""
        return self.tiles().mapInArrow(_unpacked, "r long, c long, h long, water long, surface long, cover long")

    def objects(self, pools: tuple[str, ...] = ("objects",), effects: bool = False) -> DataFrame:
        """Scenery of the pools; effects are volumes in the air and only come when asked for."""
        out = self.table("scenery").where(F.col("pool").isin(*pools))
        return out if effects else out.where("class <> 'effect'")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.to_pylist():
            r, c = np.meshgrid(np.arange(t["tile_r"] * TILE, (t["tile_r"] + 1) * TILE), np.arange(t["tile_c"] * TILE, (t["tile_c"] + 1) * TILE), indexing="ij")
            cols = [pa.array(r.ravel()), pa.array(c.ravel())]
            for name, (kind, none) in LAYERS.items():
                v = np.frombuffer(t[name], kind).astype(np.int64)
                cols.append(pa.array(v, mask=v == none))
            yield pa.RecordBatch.from_arrays(cols, names=["r", "c", "h", "water", "surface", "cover"])


def write_synthetic(spark: SparkSession, path: str, form: Form) -> None:
    """Writes the tables of a synthetic terrain; ``done`` comes last."""
    ship(spark)
    side = -(-form.cells // TILE)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                rows = [{"tile_r": r, "tile_c": c, **form.tile(r, c)} for c in range(side)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("tile_r", pa.int32()), ("tile_c", pa.int32()), *((k, pa.binary()) for k in LAYERS)]))

    bands = spark.range(0, side, 1, min(side, max(2, spark.sparkContext.defaultParallelism)))
    save = lambda df, name: df.write.mode("overwrite").partitionBy(*FOLDERS.get(name, [])).parquet(f"{path}/{name}")
    save(bands.mapInArrow(tiles, SCHEMAS["tiles"]), "tiles")
    raw = spark.createDataFrame(form.scenery(), "id long, pool string, model string, n double, e double, rotation double, w double, d double, tall double")
    kind, family = classes(F.col("model"), F.col("w"), F.col("d"), F.col("tall"))
    names = [f.split()[0] for f in SCHEMAS["scenery"].split(", ")]
    save(raw.withColumn("class", kind).withColumn("family", family).select(*names).coalesce(1).sortWithinPartitions("pool", F.floor(F.col("n") / 1000), F.floor(F.col("e") / 1000)), "scenery")
    edges = form.edges()
    at: dict[tuple[int, int], list[int]] = {}
    for e in edges:
        at.setdefault((e[1], e[3]), []).append(e[0])
        at.setdefault((e[1], e[4]), []).append(e[0])
    small = form.small_tables() | {"edges": edges, "passes": [(k, node, i, j) for (k, node), mine in at.items() for i in mine for j in mine if i != j]}
    small["stands"] = [(a, name, cls, wide, long, tall, heli, plane, n, e) for a, name, n, e, cls, wide, long, tall, heli, plane in small["stands"]]
    for name, rows in small.items():
        save(spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1), name)
    spark.createDataFrame([(json.dumps(asdict(form)),)], "form string").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")


_open: dict[tuple[str, str], Terrain] = {}


def synthetic(spark: SparkSession, seed: int = 1, size: int = 70_000) -> Terrain:
    """The synthetic terrain's tables in the shared folder, written at first use."""
    form = Form(seed, size)
    key = hashlib.sha256(repr((form, sorted(SCHEMAS.items()), CLASS_RULES, FAMILY_RULES)).encode()).hexdigest()[:12]
    base = shared_dir(spark).rstrip("/")
    held = _open.get((spark.sparkContext.applicationId, f"{base}/{key}"))
    if held:
        return held
    path = f"{base}/terrain-{seed}-{size}-{key}"
    if not _exists(spark, f"{path}/done/_SUCCESS"):
        write_synthetic(spark, path, form)
    out = _open[spark.sparkContext.applicationId, f"{base}/{key}"] = Terrain(spark, path, form)
    return out


def stored(spark: SparkSession, path: str, cells: int) -> Terrain:
    """A terrain of tables that someone else wrote, ``cells`` a side."""
    return Terrain(spark, path, None, cells)
