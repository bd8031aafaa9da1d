"""Scenery in regions, placement checks, settlements by size, and site search."""

from __future__ import annotations

from . import layers
from . import terrain as T


def scenery_in(regions: str) -> str:
    """Objects by class in each circle (id, n, e, radius), edge included."""
    near = "s.n BETWEEN g.n - g.radius AND g.n + g.radius AND s.e BETWEEN g.e - g.radius AND g.e + g.radius AND (s.n - g.n) * (s.n - g.n) + (s.e - g.e) * (s.e - g.e) <= g.radius * g.radius"
    return f"SELECT g.id, 'objects' AS pool, s.class, count(*) AS objects, min(s.id) AS first_id FROM {regions} g JOIN {T.scenery()} s ON {near} GROUP BY g.id, s.class"


def validate_placements(shapes: str, shallow: float) -> str:
    """Checks of axis-parallel boxes (id, n, e, wn, we): cells, relief, covers, depth, objects met, verdict.

    A cell is covered if the box enters it by more than two microns.
    """
    low = lambda at, w: f"CAST(floor(({at} - {w} / 2e0 + 0.000002e0) / 50e0) AS BIGINT)"
    high = lambda at, w: f"CAST(floor(({at} + {w} / 2e0 - 0.000002e0) / 50e0) AS BIGINT)"
    spans = f"(SELECT *, {low('n', 'wn')} AS ra, {high('n', 'wn')} AS rb, {low('e', 'we')} AS ca, {high('e', 'we')} AS cb FROM {shapes} s)"
    rows = f"(SELECT *, ra + k AS r FROM {spans} a {{each:greatest(rb - ra, 0):k}})"
    cells = f"(SELECT id, r, ca + j AS c, CAST(r * 50 + 25 AS DOUBLE) AS cn, CAST((ca + j) * 50 + 25 AS DOUBLE) AS ce FROM {rows} b {{each:greatest(cb - ca, 0):j}})"
    on = T.covered("cn", "ce")
    known = f"(SELECT id, CASE WHEN {on} THEN CAST(floor({T.height('cn', 'ce')} + 0.5e0) AS BIGINT) END AS h, CASE WHEN {on} THEN {T.water('cn', 'ce')} END AS water, CASE WHEN {on} THEN {T.cover('cn', 'ce')} END AS cover, CASE WHEN {on} THEN {T.depth('cn', 'ce')} END AS depth, CASE WHEN {on} THEN {T.forest('cn', 'ce')} END AS wood FROM {cells} d)"
    trees = f"(SELECT n, e, 3 AS each, 6e0 AS w, 6e0 AS d FROM (SELECT (a.i + 800) * 50 + 25e0 AS n, (b.i + 1100) * 50 + 25e0 AS e FROM {{seq:80}} a, {{seq:80}} b) q WHERE {T.wooded('n', 'e')})"
    round_ = "greatest(abs(o.n - s.n) - s.wn / 2e0, 0e0) * greatest(abs(o.n - s.n) - s.wn / 2e0, 0e0) + greatest(abs(o.e - s.e) - s.we / 2e0, 0e0) * greatest(abs(o.e - s.e) - s.we / 2e0, 0e0) <= 9.000006e0"
    boxed = "abs(o.n - s.n) <= (s.wn + o.w) / 2e0 + 0.000001e0 AND abs(o.e - s.e) <= (s.we + o.d) / 2e0 + 0.000001e0"
    poles = "(SELECT 20000e0 + 200e0 * i AS n, 50025e0 AS e, 1 AS each, 1e0 AS w, 1e0 AS d FROM {seq:201} q)"
    plain = f"(SELECT n, e, 1 AS each, w, d FROM {T.scenery()} z UNION ALL SELECT * FROM {poles} y)"
    met = f"(SELECT id, sum(each) AS met FROM (SELECT s.id, o.each FROM {shapes} s JOIN {plain} o ON {boxed} UNION ALL SELECT s.id, o.each FROM {shapes} s JOIN {trees} o ON {round_}) m GROUP BY id)"
    paved = f"(abs(p.n - {T.RUNWAY['north']}) <= p.wn / 2e0 + {T.RUNWAY['width']} / 2e0 AND abs(p.e - {T.RUNWAY['east']}) <= p.we / 2e0 + {T.RUNWAY['length']} / 2e0)"
    any_ = lambda test: f"coalesce(bool_or({test}), FALSE)"
    per = f"(SELECT id, count(*) AS cells, max(h) - min(h) AS relief, count(DISTINCT cover) AS covers, min(depth) AS min_depth, bool_or(h IS NULL) AS off, {any_('water = 1')} AS lake, {any_('water = 2')} AS sea, {any_('water = 3')} AS river, {any_('wood')} AS wood FROM {known} k GROUP BY id)"
    return f"""SELECT p.id, k.cells, CAST(k.relief AS DOUBLE) AS relief, k.covers, coalesce(m.met, 0) AS objects_met, round(k.min_depth, 4) AS min_depth,
      CASE WHEN k.off THEN 'no_ground' WHEN k.lake THEN 'water_lake' WHEN k.sea THEN 'water_sea' WHEN k.river THEN 'water_river' WHEN k.wood THEN 'forest'
      WHEN k.min_depth < {T.num(shallow)} THEN 'shallow' WHEN coalesce(m.met, 0) > 0 THEN 'objects' WHEN {paved} THEN 'pavement' ELSE 'ok' END AS verdict
      FROM {shapes} p JOIN {per} k ON p.id = k.id LEFT JOIN {met} m ON p.id = m.id"""


def score_sites(row: int, rows: int, col: int, cols: int, slope_max: float = 8, road_max: float = 3000) -> str:
    """Candidates on every second cell with their criterion values, hard result and score, best first by rank.

    Criteria: valid, slope at most ``slope_max``, plain cover, distance to a road
    at most ``road_max``; the score is the sum of the terms.
    """
    s = layers.slope_layers(row, rows, col, cols, 12)
    road = layers.distance_layer(row, rows, col, cols, "surface = 4")
    at = f"(SELECT s.r, s.c, s.valid, s.slope, g.cover, d.distance FROM ({s}) s JOIN {T.cells(row, rows, col, cols)} g ON s.r = g.r AND s.c = g.c LEFT JOIN ({road}) d ON s.r = d.r AND s.c = d.c WHERE s.r % 2 = 0 AND s.c % 2 = 0)"
    unit = lambda x: f"least(greatest({x}, 0e0), 1e0)"
    terms = f"""(SELECT r, c, round(slope, 4) AS slope, least(coalesce(distance, {T.num(road_max + 50)}), {T.num(road_max + 50)}) AS distance, valid = 1 AND coalesce(slope <= {T.num(slope_max)}, FALSE) AND cover = 1 AND coalesce(distance <= {T.num(road_max)}, FALSE) AS pass,
      round(valid + coalesce({unit(f'1e0 - slope / {T.num(slope_max)}')}, 0e0) + CASE WHEN cover = 1 THEN 1e0 ELSE 0e0 END + coalesce({unit(f'({T.num(road_max)} - distance) / {T.num(road_max)}')}, 0e0), 6) AS score FROM {at} a)"""
    return f"SELECT CAST(r * 50 + 25 AS DOUBLE) AS n, CAST(c * 50 + 25 AS DOUBLE) AS e, slope, distance, pass, score FROM {terms} t"


def settlements(gap: float = 200) -> str:
    """Links (a, b) between buildings whose distance less their radii is at most the gap; single linkage joins them."""
    built = f"(SELECT id, n, e, greatest(w, d) / 2e0 AS radius, w * d * greatest(1e0, floor(tall / 3e0 + 0.5e0)) AS floor_m2 FROM {T.scenery()} s WHERE class IN ('building', 'industrial') AND w * d >= 60e0 AND tall >= 2e0)"
    return f"SELECT a.id AS a, b.id AS b FROM {built} a JOIN {built} b ON a.id < b.id AND sqrt((a.n - b.n) * (a.n - b.n) + (a.e - b.e) * (a.e - b.e)) <= {T.num(gap)} + a.radius + b.radius"
