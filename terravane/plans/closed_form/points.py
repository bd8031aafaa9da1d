"""Layers at points and lattices, coordinates, nearest features, point information."""

from __future__ import annotations

from . import geodesy as G
from . import terrain as T


def sample_points(points: str) -> str:
    """Stored layers and depth at each (id, n, e); null off the terrain."""
    on = T.covered("n", "e")
    layer = lambda f: f"CASE WHEN {on} THEN {f('n', 'e')} END"
    return f"""SELECT id, n, e, round({layer(T.height)}, 4) AS height, {layer(T.water)} AS water, {layer(T.surface)} AS surface,
      {layer(T.cover)} AS cover, round({layer(T.depth)}, 4) AS depth, {layer(T.forest)} AS forest FROM {points} p"""


def sample_lattice(n0: float, e0: float, rows: int, cols: int, step: float) -> str:
    """Bilinear raster height and nearest codes on a lattice from the south-west corner."""
    r0, c0 = int(n0 // T.CELL) - 1, int(e0 // T.CELL) - 1
    window = T.cells(r0, int(rows * step // T.CELL) + 4, c0, int(cols * step // T.CELL) + 4)
    at = f"(SELECT {T.num(n0)} + a.i * {T.num(step)} AS n, {T.num(e0)} + b.i * {T.num(step)} AS e FROM {{seq:{rows}}} a, {{seq:{cols}}} b)"
    return f"""SELECT p.n, p.e, round({T.bilinear('p.n', 'p.e').replace(' r)', ' q.r)').replace(' c)', ' q.c)')}, 4) AS height, x.water, x.surface, x.cover
      FROM {at} p LEFT JOIN {T.quads(window)} q ON q.r = CAST(floor(p.n / 50e0 - 0.5e0) AS BIGINT) AND q.c = CAST(floor(p.e / 50e0 - 0.5e0) AS BIGINT)
      LEFT JOIN {window} x ON x.r = CAST(floor(p.n / 50e0) AS BIGINT) AND x.c = CAST(floor(p.e / 50e0) AS BIGINT)"""


def geo(points: str) -> str:
    """Latitude and longitude of each point and the way back."""
    rel = f"(SELECT id, n + {T.ORIGIN_X} AS x, e + {T.ORIGIN_Z} AS z FROM {points} p)"
    return f"SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(x2 - x, 3) + 0e0 AS back_x, round(z2 - z, 3) + 0e0 AS back_z FROM {G.to_xz(G.to_latlon(rel))} t"


def _ranked(points: str, features: str, tie: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, {tie}) AS rnk FROM (
      SELECT p.id, p.n, p.e, f.*, (p.n - f.fn) * (p.n - f.fn) + (p.e - f.fe) * (p.e - f.fe) AS d2 FROM {points} p, {features} f) x) y WHERE rnk <= {n}"""


def nearest_scenery(points: str, n: int = 3, kind: str | None = None) -> str:
    """The n nearest objects of each point; ties by id as text."""
    where = f" WHERE class = '{kind}'" if kind else ""
    features = f"(SELECT id AS fid, class, n AS fn, e AS fe, CAST(id AS VARCHAR(20)) AS tid FROM {T.scenery()} s{where})"
    return f"SELECT id, rnk, fid, class, round(sqrt(d2), 4) AS distance FROM ({_ranked(points, features, 'tid', n)}) z"


def nearest_road(points: str) -> str:
    """The nearest point on a road's centre line; ties by order of the roads."""
    rows = ", ".join(f"({i}, '{name}', {T.num(a if north else fixed)}, {T.num(b if north else fixed)}, {T.num(fixed if north else a)}, {T.num(fixed if north else b)})" for i, (name, fixed, a, b, north) in enumerate(T.ROADS))
    on = "least(greatest(p.n, f.n0), f.n1)", "least(greatest(p.e, f.e0), f.e1)"
    return f"""SELECT id, road, round(qn, 3) AS at_n, round(qe, 3) AS at_e, round(sqrt(d2), 4) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, ord) AS rnk FROM (SELECT *, (n - qn) * (n - qn) + (e - qe) * (e - qe) AS d2 FROM (
        SELECT p.id, p.n, p.e, f.ord, f.road, {on[0]} AS qn, {on[1]} AS qe FROM {points} p, (SELECT * FROM (VALUES {rows}) AS v(ord, road, n0, n1, e0, e1)) f) a) b) c WHERE rnk = 1"""


def point_info(points: str) -> str:
    """Height, water and cover, nearest town with bearing and wording, latitude and longitude."""
    towns = f"(SELECT ord, name, n AS fn, e AS fe FROM {T.towns()} t)"
    near = f"(SELECT id, name AS town, fn - n AS dn, fe - e AS de, sqrt(d2) AS distance FROM ({_ranked(points, towns, 'ord', 1)}) z)"
    # the bearing is read from the town to the point
    town = f"(SELECT id, town, distance, {G.bearing('-dn', '-de')} AS b FROM {near} w)"
    km = "CAST(CAST(floor(distance / 1000e0 + 0.5e0) AS BIGINT) AS VARCHAR(20))"
    metres = "CAST(CAST(floor(distance / 100e0 + 0.5e0) AS BIGINT) * 100 AS VARCHAR(20))"
    words = f"CASE WHEN distance < 50e0 THEN concat('at ', town) WHEN distance >= 950e0 THEN concat({km}, ' km ', {G.compass('b')}, ' of ', town) ELSE concat({metres}, ' m ', {G.compass('b')}, ' of ', town) END"
    rel = f"(SELECT id, n, e, n + {T.ORIGIN_X} AS x, e + {T.ORIGIN_Z} AS z FROM {points} p)"
    return f"""SELECT g.id, round({T.height('g.n', 'g.e')}, 3) AS height, {T.water('g.n', 'g.e')} AS water, {T.cover('g.n', 'g.e')} AS cover, round(g.lat, 6) AS lat, round(g.lon, 6) AS lon,
      t.town, round(t.distance, 3) AS town_distance, round(t.b, 3) AS town_bearing, {words} AS description FROM {G.to_latlon(rel)} g JOIN {town} t ON g.id = t.id"""
