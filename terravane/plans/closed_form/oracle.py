"""SQL of the registered queries over the closed form: one text a query, none of it shared with the operators."""

from __future__ import annotations

from ...sources.synthetic import PIECES
from . import geodesy as G
from . import layers, points, sites
from . import terrain as T
from .render import for_duckdb

num = T.num


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else num(v) if isinstance(v, float) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names}))"


def edges(rail: bool = False) -> str:
    """(edge_id, kind, a, b, n0, n1, e0, e1, length) of the network's pieces."""
    rows = [(i, kind, a, b, *((start, stop, line, line) if north else (line, line, start, stop)), stop - start) for i, (kind, a, b, line, start, stop, north) in enumerate(PIECES) if (kind == "rw") == rail]
    return values(rows, "edge_id, kind, a, b, n0, n1, e0, e1, length")


def corner(r: str, c: str) -> str:
    """The stored height of a cell, null off the terrain."""
    n, e = f"(({r}) * 50e0 + 25e0)", f"(({c}) * 50e0 + 25e0)"
    return f"(CASE WHEN {T.covered(n, e)} THEN floor({T.height(n, e)} + 0.5e0) END)"


def raster(n: str, e: str) -> str:
    """Bilinear between the four cell centres around a point."""
    r, c = f"floor({n} / 50e0 - 0.5e0)", f"floor({e} / 50e0 - 0.5e0)"
    fr, fc = f"({n} / 50e0 - 0.5e0 - {r})", f"({e} / 50e0 - 0.5e0 - {c})"
    return f"({corner(r, c)} * (1e0 - {fr}) * (1e0 - {fc}) + {corner(r, f'{c} + 1')} * (1e0 - {fr}) * {fc} + {corner(f'{r} + 1', c)} * {fr} * (1e0 - {fc}) + {corner(f'{r} + 1', f'{c} + 1')} * {fr} * {fc})"


def triangle(asked: str) -> str:
    """Heights of the plane through the three cell centres around each point, two triangles between four of them."""
    r, c = "floor(n / 50e0 - 0.5e0)", "floor(e / 50e0 - 0.5e0)"
    at = f"(SELECT id, n / 50e0 - 0.5e0 - {r} AS fr, e / 50e0 - 0.5e0 - {c} AS fc, {corner(r, c)} AS sw, {corner(r, f'{c} + 1')} AS se, {corner(f'{r} + 1', c)} AS nw, {corner(f'{r} + 1', f'{c} + 1')} AS ne FROM {asked} p)"
    return f"SELECT id, round(CASE WHEN fr + fc <= 1e0 THEN sw + fr * (nw - sw) + fc * (se - sw) ELSE ne + (1e0 - fr) * (se - ne) + (1e0 - fc) * (nw - ne) END, 6) AS height FROM {at} q"


def sweep(site_rows: str, radius: int) -> str:
    """(id, r, c, n, e, n0, e0, d, h, floor_agl): the least visible height above ground of each cell around each site (id, n0, e0, a0)."""
    radials = max(8, -int(-(2 * 3.141592653589793 * radius / 50) // 1))
    steps, k = -(-radius // 25), radius // 50 + 2
    turn = 2 * 3.141592653589793 / radials
    rel = f"(SELECT id, n0, e0, {T.height('n0', 'e0')} + a0 AS eye FROM {site_rows} s0 WHERE {T.covered('n0', 'e0')})"
    rays = f"(SELECT s.*, a.i AS k, b.i + 1 AS s, (b.i + 1) * 25e0 AS d, s.n0 + (b.i + 1) * 25e0 * cos(a.i * {num(turn)}) AS n, s.e0 + (b.i + 1) * 25e0 * sin(a.i * {num(turn)}) AS e FROM {rel} s, {{seq:{radials}}} a, {{seq:{steps}}} b)"
    slope = f"(SELECT id, k, s, CASE WHEN d <= 1000e0 THEN CASE WHEN {T.covered('n', 'e')} THEN ({T.height('n', 'e')} - 0.00005e0 - eye) / d END ELSE ({raster('n', 'e')} - eye) / d END AS slope FROM {rays} y)"
    steep = f"(SELECT id, k, s, max(slope) OVER (PARTITION BY id, k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS steep FROM {slope} z)"
    grid = f"(SELECT s.*, CAST(floor(s.n0 / 50e0) AS BIGINT) - {k} + a.i AS r, CAST(floor(s.e0 / 50e0) AS BIGINT) - {k} + b.i AS c FROM {rel} s, {{seq:{2 * k + 1}}} a, {{seq:{2 * k + 1}}} b)"
    near = f"(SELECT *, r * 50 + 25e0 AS n, c * 50 + 25e0 AS e FROM {grid} g)"
    far = "sqrt((n - n0) * (n - n0) + (e - e0) * (e - e0))"
    cells = f"(SELECT *, {far} AS d, {G.bearing('(n - n0)', '(e - e0)')} AS b, floor({T.height('n', 'e')} + 0.5e0) AS h FROM {near} m WHERE (n - n0) * (n - n0) + (e - e0) * (e - e0) <= {num(radius * radius)} AND {T.covered('n', 'e')})"
    keyed = f"(SELECT *, CAST(floor(b / {num(turn * 180 / 3.141592653589793)} + 0.5e0) AS BIGINT) % {radials} AS k, CAST(greatest(ceil(d / 25e0), 1e0) AS BIGINT) - 1 AS s FROM {cells} o)"
    return f"(SELECT x.id, x.r, x.c, x.n, x.e, x.n0, x.e0, x.d, x.h, CASE WHEN x.s = 0 OR t.steep IS NULL THEN 0e0 ELSE greatest(0e0, x.eye + t.steep * x.d - x.h) END AS floor_agl FROM {keyed} x LEFT JOIN {steep} t ON x.id = t.id AND x.k = t.k AND x.s = t.s)"


def line(pairs: str) -> str:
    """(id, visible, clearance) of pairs (id, n1, e1, a1, n2, e2, a2): gaps every 6.25 m, the ground straight between."""
    ends = f"(SELECT *, {T.height('n1', 'e1')} + a1 AS y1, {T.height('n2', 'e2')} + a2 AS y2, greatest(ceil(sqrt((n2 - n1) * (n2 - n1) + (e2 - e1) * (e2 - e1)) / 6.25e0), 1e0) AS m FROM {pairs} p)"
    at = f"(SELECT *, k / m AS t FROM {ends} x {{each:m:k}})"
    gap = f"(SELECT id, y1 + (y2 - y1) * t - {T.height('(n1 + (n2 - n1) * t)', '(e1 + (e2 - e1) * t)')} AS gap FROM {at} y)"
    return f"SELECT id, min(gap) >= -0.0001e0 AS visible, round(min(gap), 3) AS clearance FROM {gap} z GROUP BY id"


def nearest(asked: str, features: str, n: int, extra: str = "what") -> str:
    """The n nearest of features (fn, fe, tie, ...), every point with every feature."""
    return f"""SELECT id, rnk, {extra}, round(sqrt(d2), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, tie) AS rnk FROM (
      SELECT p.id, f.*, (p.n - f.fn) * (p.n - f.fn) + (p.e - f.fe) * (p.e - f.fe) AS d2 FROM {asked} p, {features} f) x) y WHERE rnk <= {n}"""


def snapped(asked: str, n: str, e: str, rail: bool = False) -> str:
    """(id, edge_id, at_n, at_e, distance) of the nearest point on an axis-parallel edge; ties to the first edge."""
    on = f"least(greatest(p.{n}, f.n0), f.n1)", f"least(greatest(p.{e}, f.e0), f.e1)"
    return f"""(SELECT id, edge_id, at_n, at_e, sqrt(d2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, edge_id) AS rnk FROM (SELECT *, (pn - at_n) * (pn - at_n) + (pe - at_e) * (pe - at_e) AS d2 FROM (
      SELECT p.id, p.{n} AS pn, p.{e} AS pe, f.edge_id, {on[0]} AS at_n, {on[1]} AS at_e FROM {asked} p, {edges(rail)} f) a) b) c WHERE rnk = 1)"""


def closure(rail: bool = False) -> str:
    """CTEs ending in d4: the least distance between any two nodes, by squaring in the min-plus product."""
    both = f"(SELECT a, b, length AS d FROM {edges(rail)} x UNION ALL SELECT b, a, length FROM {edges(rail)} y UNION ALL SELECT a, a, 0e0 FROM {edges(rail)} z UNION ALL SELECT b, b, 0e0 FROM {edges(rail)} w)"
    steps = [f"d0 AS (SELECT a, b, min(d) AS d FROM {both} q GROUP BY a, b)"]
    steps += [f"d{k + 1} AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON x.b = y.a GROUP BY x.a, y.b)" for k in range(4)]
    return ",\n".join(steps)


def routes(pairs: str) -> str:
    """Length between the snapped ends of pairs (id, n1, e1, n2, e2): along one edge, or over the ends of both."""
    place = lambda at: f"(SELECT s.*, f.a, f.b, (s.at_n - f.n0) + (s.at_e - f.e0) AS before, f.length FROM {at} s JOIN {edges()} f ON s.edge_id = f.edge_id)"
    leave = lambda at: f"(SELECT id, edge_id, before, a AS node, before AS d FROM {place(at)} l UNION ALL SELECT id, edge_id, before, b, length - before FROM {place(at)} m)"
    f, t = snapped(pairs, "n1", "e1"), snapped(pairs, "n2", "e2")
    return f"""WITH {closure()}, frm AS (SELECT * FROM {leave(f)} q), til AS (SELECT * FROM {leave(t)} q),
over AS (SELECT frm.id, min(frm.d + d4.d + til.d) AS d FROM frm JOIN til ON frm.id = til.id JOIN d4 ON d4.a = frm.node AND d4.b = til.node GROUP BY frm.id),
same AS (SELECT DISTINCT frm.id, abs(frm.before - til.before) AS d FROM frm JOIN til ON frm.id = til.id AND frm.edge_id = til.edge_id)
SELECT p.id, round(least(o.d, coalesce(s.d, o.d)), 3) AS length, round(f.distance, 3) AS snap_from, round(t.distance, 3) AS snap_to FROM {pairs} p JOIN over o ON o.id = p.id LEFT JOIN same s ON s.id = p.id JOIN {f} f ON f.id = p.id JOIN {t} t ON t.id = p.id"""


def betweenness() -> str:
    """Each edge's share of the shortest paths between nodes, all of them listed; tied ones have equal parts."""
    both = f"(SELECT a, b, length FROM {edges()} x UNION ALL SELECT b, a, length FROM {edges()} y)"
    return f"""WITH RECURSIVE {closure()}, path AS (SELECT a AS x, a AS y, 0e0 AS len FROM d0 WHERE a = b UNION ALL
SELECT p.x, e.b, p.len + e.length FROM path p JOIN {both} e ON e.a = p.y JOIN d4 z ON z.a = p.x AND z.b = e.b AND abs(p.len + e.length - z.d) < 0.001e0 WHERE e.b <> p.x),
many AS (SELECT x, y, count(*) AS s FROM path GROUP BY x, y),
uses AS (SELECT e.edge_id, e.a, e.b, e.length, sum(sx.s * sy.s / CAST(sz.s AS DOUBLE)) AS part FROM {edges()} e JOIN d4 x ON x.b = e.a JOIN d4 y ON y.a = e.b JOIN d4 z ON z.a = x.a AND z.b = y.b
JOIN many sx ON sx.x = x.a AND sx.y = x.b JOIN many sy ON sy.x = y.a AND sy.y = y.b JOIN many sz ON sz.x = z.a AND sz.y = z.b
WHERE x.a <> y.b AND abs(x.d + e.length + y.d - z.d) < 0.001e0 GROUP BY e.edge_id, e.a, e.b, e.length)
SELECT edge_id, a, b, length, round(part / max(part) OVER (), 6) AS betweenness FROM uses"""


def horn(r: str, c: str) -> tuple[str, str]:
    """Rise a metre north and east of a cell by its nine cells."""
    h = {(i, j): corner(f"{r} + {i}", f"{c} + {j}") for i in (-1, 0, 1) for j in (-1, 0, 1)}
    north = f"(({h[1, -1]} + 2 * {h[1, 0]} + {h[1, 1]}) - ({h[-1, -1]} + 2 * {h[-1, 0]} + {h[-1, 1]})) / 400e0"
    east = f"(({h[-1, 1]} + 2 * {h[0, 1]} + {h[1, 1]}) - ({h[-1, -1]} + 2 * {h[0, -1]} + {h[1, -1]})) / 400e0"
    return f"CASE WHEN {h[0, 0]} IS NOT NULL THEN {north} END", f"CASE WHEN {h[0, 0]} IS NOT NULL THEN {east} END"


def grid_reference(n: str, e: str) -> str:
    """Zone 36 has the terrain's own meridian, so its metres are the grid's, moved."""
    north, east = f"({n} + {T.ORIGIN_X + G.NORTHING})", f"({e} + {T.ORIGIN_Z + G.EASTING} + 500000)"
    digits = lambda v: f"lpad(CAST(CAST(floor({v}) AS BIGINT) % 100000 AS VARCHAR), 5, '0')"
    return f"concat('36T ', substr('STUVWXYZ', CAST(floor({east} / 100000) AS INTEGER), 1), substr('ABCDEFGHJKLMNPQRSTUV', CAST((floor({north} / 100000) + 5) % 20 AS INTEGER) + 1, 1), ' ', {digits(east)}, ' ', {digits(north)})"


def point_info(asked: str) -> str:
    towns = f"(SELECT ord AS tie, name AS what, n AS fn, e AS fe FROM {T.towns()} t)"
    near = f"(SELECT id, what AS town, n - fn AS dn, e - fe AS de, sqrt(d2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, tie) AS rnk FROM (SELECT p.id, p.n, p.e, f.*, (p.n - f.fn) * (p.n - f.fn) + (p.e - f.fe) * (p.e - f.fe) AS d2 FROM {asked} p, {towns} f) x) y WHERE rnk = 1)"
    town = f"(SELECT id, town, distance, {G.bearing('dn', 'de')} AS b FROM {near} w)"
    km = "CAST(CAST(floor(t.distance / 1000e0 + 0.5e0) AS BIGINT) AS VARCHAR)"
    metres = "CAST(CAST(floor(t.distance / 100e0 + 0.5e0) AS BIGINT) * 100 AS VARCHAR)"
    words = f"CASE WHEN t.distance < 50e0 THEN concat('at ', t.town) WHEN t.distance >= 950e0 THEN concat({km}, ' km ', {G.compass('t.b')}, ' of ', t.town) ELSE concat({metres}, ' m ', {G.compass('t.b')}, ' of ', t.town) END"
    gn, ge = horn("floor(n / 50e0)", "floor(e / 50e0)")
    on = T.covered("g.n", "g.e")
    rel = f"(SELECT id, n, e, n + {T.ORIGIN_X} AS x, e + {T.ORIGIN_Z} AS z, {gn} AS gn, {ge} AS ge FROM {asked} p)"
    sl = "degrees(atan(sqrt(gn * gn + ge * ge)))"
    az = "degrees(atan2(-ge, -gn))"
    return f"""SELECT g.id, CASE WHEN {on} THEN round({T.height('g.n', 'g.e')}, 3) END AS height, CASE WHEN {on} THEN {T.water('g.n', 'g.e')} END AS water, CASE WHEN {on} THEN {T.cover('g.n', 'g.e')} END AS cover,
      round({sl}, 4) AS slope, round(CASE WHEN {sl} >= 0.5e0 THEN CASE WHEN {az} < 0e0 THEN {az} + 360e0 ELSE {az} END END, 4) + 0e0 AS aspect,
      round(g.lat, 6) AS lat, round(g.lon, 6) AS lon, {grid_reference('g.n', 'g.e')} AS mgrs, t.town, round(t.distance, 3) AS town_distance, round(t.b, 3) AS town_bearing, {words} AS description,
      round(s.distance, 3) AS road_distance, round(sqrt((g.n - {T.RUNWAY['north']}) * (g.n - {T.RUNWAY['north']}) + (g.e - {T.RUNWAY['east']}) * (g.e - {T.RUNWAY['east']})), 3) AS airdrome_distance
      FROM {G.to_latlon(rel)} g JOIN {town} t ON g.id = t.id JOIN {snapped(asked, 'n', 'e')} s ON s.id = g.id"""


def spectrum(site_rows: str, radius: int, alts: tuple[int, ...], step_deg: int, least: int) -> str:
    """Each bearing marched inward over the floor every 25 m."""
    steps, count = radius // 25, 360 // step_deg
    f = f"(SELECT id, r, c, round(floor_agl, 3) AS f FROM {sweep(site_rows, radius)} q)"
    march = f"(SELECT s.id, a.i AS k, (b.i + 1) * 25e0 AS d, CAST(floor((s.n0 + (b.i + 1) * 25e0 * cos(radians(a.i * {step_deg}e0))) / 50e0) AS BIGINT) AS r, CAST(floor((s.e0 + (b.i + 1) * 25e0 * sin(radians(a.i * {step_deg}e0))) / 50e0) AS BIGINT) AS c FROM {site_rows} s, {{seq:{count}}} a, {{seq:{steps}}} b)"
    bands = values([(float(a),) for a in alts], "alt_agl")
    return f"""SELECT id, alt_agl, k * {step_deg}e0 AS bearing_deg, max(CASE WHEN f <= alt_agl THEN d END) AS unmask_dist, round(avg(CASE WHEN f <= alt_agl THEN 0e0 ELSE 1e0 END), 6) AS masked_fraction,
      coalesce(max(CASE WHEN f <= alt_agl THEN d END) < {least}, TRUE) AS blind FROM (SELECT m.id, m.k, m.d, f.f, h.alt_agl FROM {march} m JOIN {f} f ON f.id = m.id AND f.r = m.r AND f.c = m.c, {bands} h) x GROUP BY id, alt_agl, k"""


def unmask(asked: str, step: int) -> str:
    """Runs of seen and masked samples of a straight leg (id, n, e, a, n1, e1, a1, n2, e2, a2) from a site."""
    size = f"(SELECT *, sqrt((n2 - n1) * (n2 - n1) + (e2 - e1) * (e2 - e1)) AS size FROM {asked} q)"
    at = f"(SELECT *, least(k * {step}e0, size) AS along FROM {size} s {{each:ceil(size / {step}e0 - 0.000001e0):k}})"
    pairs = f"(SELECT id * 1000000 + k AS id, n AS n1, e AS e1, a AS a1, n1 + (n2 - n1) * along / size AS n2, e1 + (e2 - e1) * along / size AS e2, a1 + (a2 - a1) * along / size AS a2, along FROM {at} t)"
    seen = f"(SELECT p.id // 1000000 AS id, p.id % 1000000 AS k, p.along, v.visible FROM {pairs} p JOIN ({line(pairs)}) v ON v.id = p.id)"
    marked = f"(SELECT *, CASE WHEN visible = lag(visible) OVER (PARTITION BY id ORDER BY k) THEN 0 ELSE 1 END AS turn FROM {seen} s)"
    runs = f"(SELECT *, CAST(sum(turn) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM {marked} m)"
    return f"SELECT id, run, visible, count(*) AS samples, round(min(along), 3) AS from_m, round(max(along), 3) AS to_m FROM {runs} r GROUP BY id, run, visible"


def horizon(hr: tuple[int, int], hc: tuple[int, int], reach: int) -> str:
    """Codes of the highest angle along 32 bearings of horizon cells, from samples every 25 m between four cells each."""
    cells = f"(SELECT hr, hc, (hr * 4 + 2) * 50e0 AS n0, (hc * 4 + 2) * 50e0 AS e0 FROM (SELECT a.i + {hr[0]} AS hr, b.i + {hc[0]} AS hc FROM {{seq:{hr[1] - hr[0] + 1}}} a, {{seq:{hc[1] - hc[0] + 1}}} b) q)"
    eyes = f"(SELECT *, {raster('n0', 'e0')} + 2e0 AS eye FROM {cells} x)"
    rays = f"(SELECT s.*, a.i AS bin, (b.i + 1) * 25e0 AS d, n0 + (b.i + 1) * 25e0 * cos(a.i * {num(2 * 3.141592653589793 / 32)}) AS n, e0 + (b.i + 1) * 25e0 * sin(a.i * {num(2 * 3.141592653589793 / 32)}) AS e FROM {eyes} s, {{seq:32}} a, {{seq:{reach // 25}}} b)"
    best = f"(SELECT hr, hc, bin, max(({raster('n', 'e')} - eye) / d) AS best FROM {rays} y GROUP BY hr, hc, bin)"
    code = "least(greatest(floor((greatest(degrees(atan(best)), -10e0) + 10e0) / 0.25e0 + 0.5e0), 0e0), 254e0) * 0.25e0 - 10e0"
    return f"SELECT hr, hc, bin, {code} AS angle FROM {best} z"


def tree_density(row: int, rows: int, col: int, cols: int) -> str:
    """Trees a hectare in 300 m: three at every wooded centre, counted cell by cell."""
    disk = "(SELECT a.i - 6 AS dr, b.i - 6 AS dc FROM {seq:13} a, {seq:13} b WHERE (a.i - 6) * (a.i - 6) + (b.i - 6) * (b.i - 6) <= 36)"
    cells = f"(SELECT g.r, g.c, (g.r + d.dr) * 50 + 25e0 AS n, (g.c + d.dc) * 50 + 25e0 AS e FROM (SELECT a.i + {row} AS r, b.i + {col} AS c FROM {{seq:{rows}}} a, {{seq:{cols}}} b) g, {disk} d)"
    return f"SELECT r, c, round(sum(CASE WHEN {T.wooded('n', 'e')} THEN 3e0 ELSE 0e0 END) / (count(*) * 0.25e0), 4) AS tree_density FROM {cells} x GROUP BY r, c"


def towns() -> str:
    s = T.scenery()
    links = f"SELECT a, b FROM ({sites.settlements()}) q"
    return f"""WITH RECURSIVE l AS ({links}), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
labels AS (SELECT a AS id, least(a, min(b)) AS label FROM reach GROUP BY a),
placed AS (SELECT l.label, s.*, class = 'building' AS counts FROM labels l JOIN {s} s USING (id))
SELECT min(id) FILTER (counts) AS place, count(*) FILTER (counts) AS buildings, round(sum(w * d * greatest(1e0, floor(tall / 3 + 0.5e0))) FILTER (counts), 3) AS floor_m2, round(avg(n) FILTER (counts), 3) AS n, round(avg(e) FILTER (counts), 3) AS e,
  count(DISTINCT row(floor(n / 100), floor(e / 100))) FILTER (counts) AS hectares, min(n) AS south, min(e) AS west, max(n) AS north, max(e) AS east,
  CASE WHEN count(*) FILTER (counts) < 50 THEN 'hamlet' WHEN count(*) FILTER (counts) < 200 THEN 'village' ELSE 'other' END AS size, 'compact' AS form
FROM placed GROUP BY label HAVING count(*) FILTER (counts) >= 3"""


def airfield_info(wide: float, long: float) -> str:
    half, n, e = T.RUNWAY["length"] / 2, T.RUNWAY["north"], T.RUNWAY["east"]
    ends = values([("09", n + T.ORIGIN_X, e - half + T.ORIGIN_Z, 90.0), ("27", n + T.ORIGIN_X, e + half + T.ORIGIN_Z, 270.0)], "designator, x, z, course_deg")
    top = f"(SELECT max({T.ground(num(n), f'({num(e - half)} + 10e0 * i)')}) AS elevation FROM {{seq:{int(2 * half / 10) + 1}}} s)"
    return f"""SELECT designator, round(lat, 6) AS lat, round(lon, 6) AS lon, course_deg, {num(2 * half)} AS length, {num(T.RUNWAY['width'])} AS width, round(elevation, 3) AS elevation,
      4 AS stands, {4 if wide <= 40 and long <= 40 else 0} AS stands_fitting, 2 AS beacons FROM {G.to_latlon(ends)} g, {top} t"""


def describe() -> str:
    k = T.SIZE // T.CELL
    cells = T.cells(0, k, 0, k)
    parts = [
        f"SELECT 'cells' AS what, count(h) AS n FROM {cells} c",
        f"SELECT concat('cover_', CAST(cover AS VARCHAR)), count(*) FROM {cells} c WHERE cover IS NOT NULL GROUP BY cover",
        f"SELECT concat('scenery_', class), count(*) FROM {T.scenery()} s GROUP BY class",
        f"SELECT 'roads', count(*) FROM {edges()} e",
        "SELECT * FROM (VALUES ('towns', 3), ('airdromes', 1), ('runways', 1), ('stands', 4), ('beacons', 2)) AS v(what, n)",
    ]
    return " UNION ALL ".join(parts)


__all__ = ["for_duckdb", "layers", "points", "sites"]
