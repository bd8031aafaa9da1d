"""The synthetic terrain's closed form in numpy, and the rows of its tables.

Metres north and east of the grid's corner.  The seed moves the town's houses;
a greater size adds land to the north and east.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

CELL, TILE, MARGIN = 50, 64, 2000
LEAST_SIZE = 70_000
# Corner of the grid in map metres, plane, hills (height, north, east) and their spread.
ORIGIN = (-30000, -45000)
PLANE, HILLS, SIGMA = (-30.0, 0.01), ((600.0, 46000.0, 30000.0), (250.0, 46000.0, 35000.0)), 1500.0
# Coast line north + east, its shelf; lake; river; all in metres.
COAST, SHELF = 52000.0, 0.01
LAKE_N, LAKE_E, LAKE_R, LAKE_LEVEL, LAKE_DEPTH = 13000.0, 52000.0, 2000.0, 100.0, 12.0
RIVER_E, RIVER_HALF, RIVER_DEPTH = 45000.0, 30.0, 3.0
# Boxes as (south, north, west, east).
TOWN, FIELD, BEACH = (55100, 56900, 29100, 30900), (20000, 23000, 60000, 63000), (30000, 32000, 20000, 24000)
FOREST, CLEARING, WOODED_TOWN = (40000, 44000, 55000, 59000), (41500, 42500, 56500, 57500), (55100, 55600, 29100, 29600)
TREES_PER_CELL = 3
# Codes of the layers.
LAND, LAKE, SEA, RIVER = 0, 1, 2, 3
COVER = {"plain": 1, "field": 2, "forest": 3, "town": 4, "beach": 5, "runway": 6, "water": 7}
SURFACE = {"land": 1, "shallow": 2, "water": 3, "road": 4, "runway": 5}
# Road strips as (north or east line, from, to, runs north), half their width; the runway.
STRIPS = ((55025.0, 5000.0, 65000.0, False), (32525.0, 40000.0, 65000.0, True), (55025.0, 50000.0, 60000.0, True), (57025.0, 32525.0, 40525.0, False), (40525.0, 55025.0, 57025.0, True))
STRIP_HALF = 5.0
RUNWAY_N, RUNWAY_E, RUNWAY_LENGTH, RUNWAY_WIDTH = 60025.0, 20000.0, 2500.0, 50.0
# The pieces of the networks as (class, node, node, line, from, to, runs north); roads first, then the railway.
ROAD, RAIL = 2, 1
PIECES = (
    ("road", 1, 2, 55025.0, 5000.0, 32525.0, False),
    ("road", 2, 13, 55025.0, 32525.0, 40525.0, False),
    ("road", 13, 3, 55025.0, 40525.0, 44900.0, False),
    ("road", 3, 4, 55025.0, 44900.0, 45100.0, False),
    ("road", 4, 10, 55025.0, 45100.0, 55025.0, False),
    ("road", 10, 5, 55025.0, 55025.0, 65000.0, False),
    ("rdb", 6, 2, 32525.0, 40000.0, 55025.0, True),
    ("rdb", 2, 14, 32525.0, 55025.0, 57025.0, True),
    ("rdb", 14, 7, 32525.0, 57025.0, 65000.0, True),
    ("rdb", 11, 10, 55025.0, 50000.0, 55025.0, True),
    ("rdb", 10, 12, 55025.0, 55025.0, 60000.0, True),
    ("road", 14, 15, 57025.0, 32525.0, 40525.0, False),
    ("road", 13, 15, 40525.0, 55025.0, 57025.0, True),
    ("rw", 8, 9, 52025.0, 5000.0, 65000.0, False),
)
VERTEX = 500.0


def box(n: np.ndarray, e: np.ndarray, b: tuple[int, int, int, int]) -> np.ndarray:
    return (n >= b[0]) & (n < b[1]) & (e >= b[2]) & (e < b[3])


@dataclass(frozen=True)
class Form:
    seed: int = 1
    size: int = LEAST_SIZE

    def __post_init__(self) -> None:
        if self.size < LEAST_SIZE or self.size % 1000:
            raise ValueError("the size must be whole kilometres, 70 km at least")

    @property
    def cells(self) -> int:
        return self.size // CELL

    def covered(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        top = self.size - MARGIN
        return (n >= MARGIN) & (n < top) & (e >= MARGIN) & (e < top)

    def land(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The plane and the hills, before any water."""
        out = PLANE[0] + PLANE[1] * np.asarray(n, float)
        for h, n0, e0 in HILLS:
            out = out + h * np.exp(-((n - n0) * (n - n0) + (e - e0) * (e - e0)) / (2.0 * SIGMA * SIGMA))
        return out

    def on_road(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast(n, e).shape, bool)
        for line, a, b, north in STRIPS:
            across, along = (e, n) if north else (n, e)
            out |= (abs(across - line) <= STRIP_HALF) & (along >= a) & (along <= b)
        return out

    def on_runway(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (abs(n - RUNWAY_N) <= RUNWAY_WIDTH / 2) & (abs(e - RUNWAY_E) <= RUNWAY_LENGTH / 2)

    def bare_water(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The water class as if there were no roads over it."""
        lake = (n - LAKE_N) * (n - LAKE_N) + (e - LAKE_E) * (e - LAKE_E) <= LAKE_R * LAKE_R
        return np.select([n + e < COAST, lake, abs(e - RIVER_E) <= RIVER_HALF], [SEA, LAKE, RIVER], LAND)

    def water(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(self.on_road(n, e), LAND, self.bare_water(n, e))

    def height(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        w = self.water(n, e)
        return np.select([w == SEA, w == LAKE], [0.0, LAKE_LEVEL], self.land(n, e))

    def depth(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of the water; nothing on land."""
        w = self.water(n, e)
        r2 = ((n - LAKE_N) * (n - LAKE_N) + (e - LAKE_E) * (e - LAKE_E)) / (LAKE_R * LAKE_R)
        return np.select([w == SEA, w == LAKE, w == RIVER], [(COAST - n - e) / math.sqrt(2) * SHELF, LAKE_DEPTH * (1 - r2), RIVER_DEPTH], np.nan)

    def surface(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.select([self.on_runway(n, e), self.on_road(n, e), self.water(n, e) != LAND], [SURFACE["runway"], SURFACE["road"], SURFACE["water"]], SURFACE["land"])

    def wooded(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        return box(n, e, FOREST) & ~box(n, e, CLEARING)

    def forest(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.water(n, e) == LAND) & (self.wooded(n, e) | box(n, e, WOODED_TOWN))

    def cover(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        rules = [("water", self.water(n, e) != LAND), ("runway", self.on_runway(n, e)), ("town", box(n, e, TOWN)), ("forest", self.wooded(n, e)), ("field", box(n, e, FIELD)), ("beach", box(n, e, BEACH))]
        return np.select([r for _, r in rules], [COVER[c] for c, _ in rules], COVER["plain"])

    def ground(self, n: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
        """Everything known of points; ``on`` is false off the terrain."""
        return {"on": self.covered(n, e), "height": self.height(n, e), "depth": self.depth(n, e), "water": self.water(n, e), "surface": self.surface(n, e), "cover": self.cover(n, e), "forest": self.forest(n, e)}

    def tile(self, tile_r: int, tile_c: int) -> dict[str, bytes]:
        """The stored layers of a tile, packed row by row; -32768, 255, 0 and 0 off the terrain."""
        r, c = np.meshgrid(np.arange(tile_r * TILE, (tile_r + 1) * TILE), np.arange(tile_c * TILE, (tile_c + 1) * TILE), indexing="ij")
        n, e = r * float(CELL) + CELL / 2, c * float(CELL) + CELL / 2
        on = self.covered(n, e)
        packed = lambda v, none, kind: np.where(on, v, none).astype(kind).tobytes()
        return {"height": packed(np.floor(self.height(n, e) + 0.5), -32768, "<i2"), "water": packed(self.water(n, e), 255, "u1"), "surface": packed(self.surface(n, e), 0, "u1"), "cover": packed(self.cover(n, e), 0, "u1")}

    # --- rows of the tables

    def edges(self) -> list[tuple]:
        """(edge_id, kind, class, a, b, length, crosses_water, points as (n, e, h))."""
        out = []
        for i, (kind, a, b, line, start, stop, north) in enumerate(PIECES):
            at = [start, *np.arange(math.floor(start / VERTEX) * VERTEX + VERTEX, stop, VERTEX).tolist(), stop]
            ne = [(t, line) if north else (line, t) for t in at]
            steps = np.append(np.arange(start, stop, 25.0), stop)
            along = (steps, np.full(len(steps), line)) if north else (np.full(len(steps), line), steps)
            wet = bool((self.bare_water(*along) != LAND).any())
            out.append((i, RAIL if kind == "rw" else ROAD, kind, a, b, stop - start, wet, [(n, e, float(self.land(n, e))) for n, e in ne]))
        return out

    def scenery(self) -> list[tuple]:
        """(id, pool, model, n, e, rotation, w, d, tall); a box is w along its own north, d along its own east."""
        rows, state = [], self.seed

        def unit() -> float:
            nonlocal state
            state = state * 16807 % 2147483647
            return state / 2147483647

        for _ in range(24):
            n = 56000 + (2 * unit() - 1) * 800
            rows.append(("home1ug_a", n, 30000 + (2 * unit() - 1) * 800, 24.0, 12.0, 8.0))
        rows += [("sklad_new", 54000.0, 40000.0, 41.4, 43.3, 12.0), ("him_bak_a_new", 54000.0, 40120.0, 20.0, 20.0, 15.0)]
        rows += [("blk_light_pole", 55050.0, 30000.0 + 1000 * k, 0.4, 0.4, 10.0) for k in range(14)]
        rows += [("synth_nobox", 50025.0, 20025.0 + 100 * k, 0.0, 0.0, 0.0) for k in range(2)]
        out = [(70000001 + i, "objects", m, round(n, 3), round(e, 3), 0.0, w, d, t) for i, (m, n, e, w, d, t) in enumerate(rows)]
        out += [(80000001 + k, "lines", "pole_power", 20000.0 + 200 * k, 50025.0, 0.0, 1.0, 1.0, 12.0) for k in range(201)]
        r, c = np.meshgrid(np.arange(FOREST[0] // CELL, FOREST[1] // CELL), np.arange(FOREST[2] // CELL, FOREST[3] // CELL), indexing="ij")
        n, e = r.ravel() * 50.0 + 25, c.ravel() * 50.0 + 25
        keep = self.wooded(n, e)
        spots = [at for at in zip(n[keep].tolist(), e[keep].tolist(), strict=True) for _ in range(TREES_PER_CELL)]
        return out + [(90000001 + i, "trees", "pine_1", a, b, 0.0, 6.0, 6.0, 15.0) for i, (a, b) in enumerate(spots)]

    def small_tables(self) -> dict[str, list[tuple]]:
        """Rows of the reference tables; columns in ``catalog.SCHEMAS``."""
        half, w = RUNWAY_LENGTH / 2, RUNWAY_E - RUNWAY_LENGTH / 2
        return {
            "airdromes": [(1, "SYNTH", "Synth Field", RUNWAY_N, RUNWAY_E, ["09", "27"])],
            "runways": [(1, "SYNTH", "09-27", "09", RUNWAY_N, RUNWAY_E - half, "27", RUNWAY_N, RUNWAY_E + half, 90.0)],
            "paint": [(1, RUNWAY_N - 25, w, RUNWAY_N - 25, w + 2 * half, RUNWAY_N + 25, w + 2 * half), (1, RUNWAY_N - 25, w, RUNWAY_N + 25, w + 2 * half, RUNWAY_N + 25, w)],
            "stands": [(1, f"{k + 1:02d}", RUNWAY_N + 300, w + 100 * k, "stand_40x40m", 40.0, 40.0, None, True, True) for k in range(4)],
            "beacons": [(1, "SY1", "Synth Field", 750000.0, 10, RUNWAY_N, w), (1, "SY2", "Synth Field", 108100000.0, None, RUNWAY_N, w + 2 * half)],
            "radio": [(1, "airfield1_0", "Synth Field", 3750000.0, 38400000.0, 121000000.0, 250000000.0)],
            "towns": [(k, f"town_{k + 1}", 30000.0 + 12000 * k, 60000.0) for k in range(3)],
            "nodes": [(k + 1, f"node_{k + 1}", 20000.0 + 15000 * k, 38000.0, 20000.0 + 15000 * k, 42000.0) for k in range(2)],
        }
