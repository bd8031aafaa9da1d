"""Derived layers of a window of the grid (map algebra)."""

from __future__ import annotations

from . import terrain as T

CAP = 5000


def slope_layers(row: int, rows: int, col: int, cols: int, places: int = 4) -> str:
    """valid, slope, aspect and roughness by a 3 x 3 neighbourhood (Horn); undefined where any of the nine is."""
    window = T.cells(row - 1, rows + 2, col - 1, cols + 2)
    across = f"(SELECT r, c, h, water, lag(h) OVER v AS w, lead(h) OVER v AS o FROM {window} g WINDOW v AS (PARTITION BY r ORDER BY c))"
    nine = f"""(SELECT r, c, h, water, w, o, lag(w) OVER v AS sw, lag(h) OVER v AS s, lag(o) OVER v AS so, lead(w) OVER v AS nw, lead(h) OVER v AS nn, lead(o) OVER v AS no
      FROM {across} a WINDOW v AS (PARTITION BY c ORDER BY r))"""
    all_nine = "(h + w + o + sw + s + so + nw + nn + no)"
    grad = f"(SELECT *, ((nw + 2 * nn + no) - (sw + 2 * s + so)) / 400e0 AS gn, ((so + 2 * o + no) - (sw + 2 * w + nw)) / 400e0 AS ge FROM {nine} k)"
    deg = f"(SELECT *, degrees(atan(sqrt(gn * gn + ge * ge))) AS sl, degrees(atan2(-ge, -gn)) AS az FROM {grad} m)"
    return f"""SELECT r, c, CASE WHEN h IS NULL THEN 0 WHEN water = 2 THEN 0 ELSE 1 END AS valid, round(sl, {places}) AS slope,
      round(CASE WHEN sl >= 0.5e0 THEN CASE WHEN az < 0e0 THEN az + 360e0 ELSE az END END, 4) + 0e0 AS aspect,
      CASE WHEN {all_nine} IS NOT NULL THEN greatest(h, w, o, sw, s, so, nw, nn, no) - least(h, w, o, sw, s, so, nw, nn, no) END AS roughness
      FROM {deg} z WHERE r BETWEEN {row} AND {row + rows - 1} AND c BETWEEN {col} AND {col + cols - 1}"""


def disk_layers(row: int, rows: int, col: int, cols: int, radius: int = 300, position: str = "tpi_300") -> str:
    """Topographic position and cover shares in a disk, by prefix sums along rows."""
    k = radius // T.CELL
    window = T.cells(row - k, rows + 2 * k, col - k - 1, cols + 2 * k + 2)
    sums = ", ".join(f"sum(CASE WHEN cover = {code} THEN 1 ELSE 0 END) OVER v AS p{code}" for code in T.COVERS)
    prefix = f"(SELECT r, c, sum(coalesce(h, 0)) OVER v AS ph, sum(CASE WHEN h IS NULL THEN 0 ELSE 1 END) OVER v AS pn, {sums} FROM {window} g WINDOW v AS (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    half = ", ".join(f"({d}, {int((k * k - d * d) ** 0.5)})" for d in range(-k, k + 1))
    spans = f"(SELECT g.r, g.c, g.h, g.r + q.dr AS rr, g.c + q.half AS hi, g.c - q.half - 1 AS lo FROM {window} g, (SELECT * FROM (VALUES {half}) AS v(dr, half)) q WHERE g.r BETWEEN {row} AND {row + rows - 1} AND g.c BETWEEN {col} AND {col + cols - 1})"
    shares = ", ".join(f"round(sum(a.p{c} - b.p{c}) / CAST(nullif(sum(a.pn - b.pn), 0) AS DOUBLE), 6) AS share_{name}" for c, name in T.COVERS.items())
    return f"""SELECT s.r, s.c, round(max(s.h) - sum(a.ph - b.ph) / CAST(nullif(sum(a.pn - b.pn), 0) AS DOUBLE), 4) AS {position}, {shares}
      FROM {spans} s JOIN {prefix} a ON a.r = s.rr AND a.c = s.hi JOIN {prefix} b ON b.r = s.rr AND b.c = s.lo GROUP BY s.r, s.c"""


def distance_layer(row: int, rows: int, col: int, cols: int, seed: str, cap: int = CAP) -> str:
    """Exact distance between cell centres to the nearest seed cell; null beyond the cap.

    Along each column the nearest seed row comes from two windows; then every
    cell takes the least squared distance over the columns within the cap.
    """
    k = cap // T.CELL
    window = T.cells(row - k, rows + 2 * k, col - k, cols + 2 * k)
    down = f"(SELECT r, c, max(CASE WHEN {seed} THEN r END) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below, min(CASE WHEN {seed} THEN r END) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM {window} g)"
    column = f"(SELECT r, c, least(r - below, above - r) AS dr FROM {down} d WHERE r BETWEEN {row} AND {row + rows - 1} AND least(r - below, above - r) <= {k})"
    reach = f"(SELECT r, c - {k} + k AS c, dr * dr + (k - {k}) * (k - {k}) AS d2 FROM {column} x {{each:{2 * k}:k}})"
    found = f"(SELECT r, c, round(sqrt(min(d2)) * 50e0, 4) AS distance FROM {reach} y WHERE c BETWEEN {col} AND {col + cols - 1} AND d2 < {k * k} GROUP BY r, c)"
    return f"SELECT g.r, g.c, f.distance FROM (SELECT a.i + {row} AS r, b.i + {col} AS c FROM {{seq:{rows}}} a, {{seq:{cols}}} b) g LEFT JOIN {found} f ON f.r = g.r AND f.c = g.c"


def count_layer(row: int, rows: int, col: int, cols: int, kind: str, radius: int = 1000) -> str:
    """Objects of a class whose cell lies within the radius of each cell; 0 where none does."""
    k = radius // T.CELL
    seen = f"(SELECT CAST(floor(n / 50e0) AS BIGINT) AS sr, CAST(floor(e / 50e0) AS BIGINT) AS sc FROM {T.scenery()} s WHERE class = '{kind}')"
    around = f"(SELECT sr - {k} + a AS r, sc, a FROM {seen} o {{each:{2 * k}:a}})"
    disk = f"(SELECT r, sc - {k} + b AS c FROM {around} p {{each:{2 * k}:b}} WHERE (a - {k}) * (a - {k}) + (b - {k}) * (b - {k}) <= {k * k})"
    grid = f"(SELECT a.i + {row} AS r, b.i + {col} AS c FROM {{seq:{rows}}} a, {{seq:{cols}}} b)"
    return f"SELECT g.r, g.c, coalesce(t.objects, 0) AS objects FROM {grid} g LEFT JOIN (SELECT r, c, count(*) AS objects FROM {disk} d GROUP BY r, c) t ON g.r = t.r AND g.c = t.c"
