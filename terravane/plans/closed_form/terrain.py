"""The closed-form terrain: every layer is an expression of metres north and east.

Cells are 50 m squares keyed by integer row and column; a cell's height is the
rounded height of its centre, null outside the covered square.  Nothing is read
or stored: the optimizer folds the expressions into whichever query asks.
"""

from __future__ import annotations

from functools import cache

# Fixed values of the terrain, in metres north / east of the origin.
ORIGIN_X, ORIGIN_Z = -30000, -45000
SIZE, MARGIN, CELL = 70000, 2000, 50
LAND = {"base": -30, "slope": 0.01, "sigma": 1500}
HILLS = [(600, 46000, 30000), (250, 46000, 35000)]
COAST = 52000
LAKE = {"north": 13000, "east": 52000, "radius": 2000, "level": 100, "depth": 12}
RIVER = {"east": 45000, "half": 30, "depth": 3}
ROADS = [("ew", 55025, 5000, 65000, False), ("ns", 32525, 40000, 65000, True), ("east", 55025, 50000, 60000, True), ("loop_north", 57025, 32525, 40525, False), ("loop_east", 40525, 55025, 57025, True)]
RAIL = ("rail", 52025, 5000, 65000, False)
ROAD_HALF = 5
RUNWAY = {"north": 60025, "east": 20000, "length": 2500, "width": 50}
TOWN_BOX, FIELD_BOX, BEACH_BOX = (55100, 56900, 29100, 30900), (20000, 23000, 60000, 63000), (30000, 32000, 20000, 24000)
FOREST_BOX, HOLE_BOX, WOODED_BOX = (40000, 44000, 55000, 59000), (41500, 42500, 56500, 57500), (55100, 55600, 29100, 29600)
COVERS = {1: "plain", 2: "field", 3: "forest", 4: "town", 5: "beach", 6: "runway", 7: "water"}
TOWNS = [("town_1", 30000, 60000), ("town_2", 42000, 60000), ("town_3", 54000, 60000)]


def num(x: float) -> str:
    """A double literal in both dialects."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def box(n: str, e: str, b: tuple[int, int, int, int]) -> str:
    return f"({n} >= {b[0]} AND {n} < {b[1]} AND {e} >= {b[2]} AND {e} < {b[3]})"


def covered(n: str, e: str) -> str:
    return box(n, e, (MARGIN, SIZE - MARGIN, MARGIN, SIZE - MARGIN))


def on_road(n: str, e: str) -> str:
    parts = []
    for _, fixed, a, b, north in ROADS:
        across, along = (e, n) if north else (n, e)
        parts.append(f"(abs({across} - {fixed}) <= {ROAD_HALF} AND {along} BETWEEN {a} AND {b})")
    return "(" + " OR ".join(parts) + ")"


def ground(n: str, e: str) -> str:
    hill = lambda h, n0, e0: f"{num(h)} * exp(-(({n} - {num(n0)}) * ({n} - {num(n0)}) + ({e} - {num(e0)}) * ({e} - {num(e0)})) / {num(2 * LAND['sigma'] ** 2)})"
    return f"({num(LAND['base'])} + {num(LAND['slope'])} * {n} + {' + '.join(hill(*h) for h in HILLS)})"


def _lake2(n: str, e: str) -> str:
    return f"(({n} - {num(LAKE['north'])}) * ({n} - {num(LAKE['north'])}) + ({e} - {num(LAKE['east'])}) * ({e} - {num(LAKE['east'])}))"


def water(n: str, e: str) -> str:
    return f"(CASE WHEN {on_road(n, e)} THEN 0 WHEN {n} + {e} < {COAST} THEN 2 WHEN {_lake2(n, e)} <= {num(LAKE['radius'] ** 2)} THEN 1 WHEN abs({e} - {RIVER['east']}) <= {RIVER['half']} THEN 3 ELSE 0 END)"


def height(n: str, e: str) -> str:
    return f"(CASE {water(n, e)} WHEN 2 THEN 0e0 WHEN 1 THEN {num(LAKE['level'])} ELSE {ground(n, e)} END)"


def depth(n: str, e: str) -> str:
    return f"(CASE {water(n, e)} WHEN 2 THEN ({COAST} - {n} - {e}) / sqrt(2e0) * 0.01e0 WHEN 1 THEN {num(LAKE['depth'])} * (1e0 - {_lake2(n, e)} / {num(LAKE['radius'] ** 2)}) WHEN 3 THEN {num(RIVER['depth'])} END)"


def on_runway(n: str, e: str) -> str:
    return f"(abs({n} - {RUNWAY['north']}) <= {RUNWAY['width'] // 2} AND abs({e} - {RUNWAY['east']}) <= {RUNWAY['length'] // 2})"


def surface(n: str, e: str) -> str:
    return f"(CASE WHEN {on_runway(n, e)} THEN 5 WHEN {on_road(n, e)} THEN 4 WHEN {water(n, e)} <> 0 THEN 3 ELSE 1 END)"


def wooded(n: str, e: str) -> str:
    return f"({box(n, e, FOREST_BOX)} AND NOT {box(n, e, HOLE_BOX)})"


def forest(n: str, e: str) -> str:
    return f"({water(n, e)} = 0 AND ({wooded(n, e)} OR {box(n, e, WOODED_BOX)}))"


def cover(n: str, e: str) -> str:
    return (
        f"(CASE WHEN {water(n, e)} <> 0 THEN 7 WHEN {on_runway(n, e)} THEN 6 WHEN {box(n, e, TOWN_BOX)} THEN 4 WHEN {wooded(n, e)} THEN 3 "
        f"WHEN {box(n, e, FIELD_BOX)} THEN 2 WHEN {box(n, e, BEACH_BOX)} THEN 5 ELSE 1 END)"
    )


def cells(row: int, rows: int, col: int, cols: int) -> str:
    """A window of the grid: r, c, n, e (centre), h, water, surface, cover; null layers off the terrain."""
    at = f"(SELECT a.i + {row} AS r, b.i + {col} AS c, CAST((a.i + {row}) * 50 + 25 AS DOUBLE) AS n, CAST((b.i + {col}) * 50 + 25 AS DOUBLE) AS e FROM {{seq:{rows}}} a, {{seq:{cols}}} b)"
    on = covered("n", "e")
    return (
        f"(SELECT r, c, n, e, CASE WHEN {on} THEN CAST(floor({height('n', 'e')} + 0.5e0) AS BIGINT) END AS h, CASE WHEN {on} THEN {water('n', 'e')} END AS water, "
        f"CASE WHEN {on} THEN {surface('n', 'e')} END AS surface, CASE WHEN {on} THEN {cover('n', 'e')} END AS cover FROM {at} g)"
    )


def cells_around(n: float, e: float, radius: float) -> str:
    r0, c0, k = int((n - radius) // CELL) - 2, int((e - radius) // CELL) - 2, int(2 * radius // CELL) + 6
    return cells(r0, k, c0, k)


def quads(window: str) -> str:
    """Each cell with its three neighbours towards north and east, for bilinear heights: h00 h01 h10 h11."""
    return f"""(SELECT r, c, h00, h01, lead(h00) OVER (PARTITION BY c ORDER BY r) AS h10, lead(h01) OVER (PARTITION BY c ORDER BY r) AS h11
      FROM (SELECT r, c, h AS h00, lead(h) OVER (PARTITION BY r ORDER BY c) AS h01 FROM {window} w) q)"""


def bilinear(n: str, e: str) -> str:
    """The height between four cell centres of a joined quad."""
    fr, fc = f"({n} / 50e0 - 0.5e0 - r)", f"({e} / 50e0 - 0.5e0 - c)"
    return f"(h00 * (1e0 - {fr}) * (1e0 - {fc}) + h01 * (1e0 - {fr}) * {fc} + h10 * {fr} * (1e0 - {fc}) + h11 * {fr} * {fc})"


@cache
def scenery() -> str:
    """The scenery objects as a relation: id, model, class, family pool, n, e, w, d, height."""
    rows, state = [], 1

    def unit() -> float:
        nonlocal state
        state = state * 16807 % 2147483647
        return state / 2147483647

    for _ in range(24):
        n = 56000 + (2 * unit() - 1) * 800
        rows.append(("home1ug_a", "building", n, 30000 + (2 * unit() - 1) * 800, 24, 12, 8))
    rows += [("sklad_new", "industrial", 54000, 40000, 41.4, 43.3, 12), ("him_bak_a_new", "industrial", 54000, 40120, 20, 20, 15)]
    rows += [("blk_light_pole", "misc", 55050, 30000 + 1000 * k, 0.4, 0.4, 10) for k in range(14)]
    rows += [("nobox", "building", 50025, 20025 + 100 * k, 0, 0, 0) for k in range(2)]
    text = ", ".join(f"({70000001 + i}, '{m}', '{c}', {num(round(n, 3))}, {num(round(e, 3))}, {num(w)}, {num(d)}, {num(h)})" for i, (m, c, n, e, w, d, h) in enumerate(rows))
    return f"(SELECT CAST(id AS BIGINT) AS id, model, class, n, e, w, d, tall FROM (VALUES {text}) AS s(id, model, class, n, e, w, d, tall))"


def towns() -> str:
    text = ", ".join(f"({i}, '{name}', {num(n)}, {num(e)})" for i, (name, n, e) in enumerate(TOWNS))
    return f"(SELECT CAST(ord AS BIGINT) AS ord, name, n, e FROM (VALUES {text}) AS s(ord, name, n, e))"


def points(table: str, key: str) -> str:
    """Points of the covered square from an integer key of a table."""
    return f"(SELECT {key} AS id, CAST(2000 + ({key} * 7919) % 66000 AS DOUBLE) AS n, CAST(2000 + ({key} * 104729) % 66000 AS DOUBLE) AS e FROM {{t:{table}}})"
