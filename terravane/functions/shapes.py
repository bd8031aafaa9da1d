"""Plane geometry: regions as column conditions, convex shapes, outlines of cells, GeoJSON."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.synthetic import CELL
from .projection import ARRAYS, latlon

Point = tuple[float, float]
#: Shapes this close touch.
TOUCH = 1e-6


# --- regions


@dataclass(frozen=True)
class Region:
    """An area of points (north, east), its edge included."""

    def bounds(self) -> tuple[float, float, float, float]:
        """South, west, north, east."""
        raise NotImplementedError

    def exact(self, n, e, m):
        """The membership test beside the bounds; None if the bounds are the region."""
        raise NotImplementedError

    def condition(self, n: Column, e: Column) -> Column:
        """The bounds come first, so a scan can prune by them."""
        s, w, t, r = self.bounds()
        box = n.between(s, t) & e.between(w, r)
        test = self.exact(n, e, F)
        return box if test is None else box & test

    def contains(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        s, w, t, r = self.bounds()
        inside = (n >= s) & (n <= t) & (e >= w) & (e <= r)
        test = self.exact(np.asarray(n, float), np.asarray(e, float), np)
        return inside if test is None else inside & test

    def meets(self, a: Point, b: Point) -> bool:
        """Whether a segment meets the region: an end inside, or a crossing of its edge."""
        if self.contains(np.array([a[0], b[0]]), np.array([a[1], b[1]])).any():
            return True
        ring = self.outline()
        return any(segments_cross(a, b, p, q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True))

    def outline(self) -> list[Point]:
        raise NotImplementedError


@dataclass(frozen=True)
class Box(Region):
    south: float
    west: float
    north: float
    east: float

    def bounds(self) -> tuple[float, float, float, float]:
        return self.south, self.west, self.north, self.east

    def exact(self, n, e, m):
        return None

    def outline(self) -> list[Point]:
        return [(self.south, self.west), (self.south, self.east), (self.north, self.east), (self.north, self.west)]


@dataclass(frozen=True)
class Circle(Region):
    n: float
    e: float
    radius: float

    def bounds(self) -> tuple[float, float, float, float]:
        return self.n - self.radius, self.e - self.radius, self.n + self.radius, self.e + self.radius

    def exact(self, n, e, m):
        return m.sqrt((n - self.n) * (n - self.n) + (e - self.e) * (e - self.e)) <= self.radius

    def meets(self, a: Point, b: Point) -> bool:
        return point_segment((self.n, self.e), a, b) <= self.radius

    def outline(self) -> list[Point]:
        return ring_of(self.n, self.e, self.radius, 64)


@dataclass(frozen=True)
class Ring(Region):
    """Points whose distance lies from ``least`` to ``most``, such as about an airfield."""

    n: float
    e: float
    least: float
    most: float

    def bounds(self) -> tuple[float, float, float, float]:
        return Circle(self.n, self.e, self.most).bounds()

    def exact(self, n, e, m):
        d = m.sqrt((n - self.n) * (n - self.n) + (e - self.e) * (e - self.e))
        return (d >= self.least) & (d <= self.most)

    def meets(self, a: Point, b: Point) -> bool:
        far = max(math.dist(a, (self.n, self.e)), math.dist(b, (self.n, self.e)))
        return point_segment((self.n, self.e), a, b) <= self.most and far >= self.least

    def outline(self) -> list[Point]:
        return ring_of(self.n, self.e, self.most, 64)


@dataclass(frozen=True)
class Polygon(Region):
    """Even-odd; ``points`` is the ring without its first point repeated."""

    points: tuple[Point, ...]

    def bounds(self) -> tuple[float, float, float, float]:
        n, e = zip(*self.points, strict=True)
        return min(n), min(e), max(n), max(e)

    def exact(self, n, e, m):
        crossings = []
        for (n0, e0), (n1, e1) in zip(self.points, self.points[1:] + self.points[:1], strict=True):
            if n0 != n1:
                crossings.append((((n < n0) != (n < n1)) & (e < e0 + (n - n0) * ((e1 - e0) / (n1 - n0)))))
        odd = reduce(lambda x, y: x != y, crossings)
        return odd

    def outline(self) -> list[Point]:
        return list(self.points)


def point_segment(p: Point, a: Point, b: Point) -> float:
    dn, de = b[0] - a[0], b[1] - a[1]
    size = dn * dn + de * de
    t = 0.0 if size == 0 else min(1.0, max(0.0, ((p[0] - a[0]) * dn + (p[1] - a[1]) * de) / size))
    return math.dist(p, (a[0] + t * dn, a[1] + t * de))


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def segments_cross(a: Point, b: Point, p: Point, q: Point) -> bool:
    d1, d2, d3, d4 = _side(p, q, a), _side(p, q, b), _side(a, b, p), _side(a, b, q)
    if ((d1 > 0) != (d2 > 0)) and ((d3 > 0) != (d4 > 0)) and d1 * d2 < 0 and d3 * d4 < 0:
        return True
    return any(abs(d) < 1e-12 and point_segment(x, y, z) < 1e-9 for d, x, y, z in ((d1, a, p, q), (d2, b, p, q), (d3, p, a, b), (d4, q, a, b)))


def ring_of(n: float, e: float, radius: float, corners: int) -> list[Point]:
    return [(n + radius * math.cos(2 * math.pi * k / corners), e + radius * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def wedge(n: float, e: float, radius: float, start: float, stop: float) -> list[Point]:
    """A sector of a disk between two bearings, its arc in steps of two degrees at most."""
    sweep = (stop - start) % 360 or 360
    steps = max(1, math.ceil(sweep / 2))
    arc = [math.radians(start + sweep * k / steps) for k in range(steps + 1)]
    return [(n, e), *((n + radius * math.cos(a), e + radius * math.sin(a)) for a in arc)]


# --- convex shapes


@dataclass(frozen=True)
class Shape:
    """A convex polygon (corners in order, one or two allowed) or, with a radius, a disk about its one corner."""

    corners: tuple[Point, ...]
    radius: float = 0.0

    def bounds(self) -> tuple[float, float, float, float]:
        n, e = zip(*self.corners, strict=True)
        return min(n) - self.radius, min(e) - self.radius, max(n) + self.radius, max(e) + self.radius

    def middle(self) -> Point:
        s, w, t, r = self.bounds()
        return (s + t) / 2, (w + r) / 2

    def moved(self, n: float, e: float) -> Shape:
        return Shape(tuple((a + n, b + e) for a, b in self.corners), self.radius)

    def sides(self) -> list[tuple[Point, Point]]:
        c = self.corners
        return [(c[0], c[0])] if len(c) == 1 else [(c[0], c[1])] if len(c) == 2 else list(zip(c, c[1:] + c[:1], strict=True))

    def holds(self, p: Point) -> bool:
        if len(self.corners) < 3:
            return False
        turns = [_side(a, b, p) for a, b in self.sides()]
        return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)

    def distance(self, other: Shape) -> float:
        """The gap between two shapes; 0 where they overlap."""
        if self.holds(other.corners[0]) or other.holds(self.corners[0]):
            return 0.0
        best = math.inf
        for a, b in self.sides():
            for p, q in other.sides():
                if a != b and p != q and segments_cross(a, b, p, q):
                    return 0.0
                best = min(best, point_segment(a, p, q), point_segment(b, p, q), point_segment(p, a, b), point_segment(q, a, b))
        return max(0.0, best - self.radius - other.radius)

    def meets(self, other: Shape) -> bool:
        return self.distance(other) <= TOUCH


def turned_box(n: float, e: float, w: float, d: float, rotation: float) -> Shape:
    """A box ``w`` along its own north and ``d`` along its own east, turned clockwise by radians; a box of no size is its position."""
    if w <= 0 and d <= 0:
        return Shape(((n, e),))
    c, s = math.cos(rotation), math.sin(rotation)
    return Shape(tuple((n + a * w / 2 * c - b * d / 2 * s, e + a * w / 2 * s + b * d / 2 * c) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))))


def covered_cells(shape: Shape) -> list[tuple[int, int]]:
    """Cells that a shape reaches into by more than a micron; at least the cell of its middle."""
    s, w, t, r = shape.bounds()
    o = shape.middle()
    i, j = np.meshgrid(np.arange(math.floor(s / CELL), math.floor(t / CELL) + 1), np.arange(math.floor(w / CELL), math.floor(r / CELL) + 1), indexing="ij")
    i, j = i.ravel(), j.ravel()
    inset = 2 * TOUCH
    low = np.stack([i * CELL - o[0] + inset, j * CELL - o[1] + inset])
    high = np.stack([(i + 1) * CELL - o[0] - inset, (j + 1) * CELL - o[1] - inset])
    at = np.array(shape.corners) - np.array(o)
    if len(at) == 1:
        gap = np.sqrt((np.maximum(np.maximum(low - at[0][:, None], at[0][:, None] - high), 0) ** 2).sum(0)) - shape.radius
    else:
        # convex shapes are apart if some side's normal or a cell's axis tells them apart
        gap = np.full(len(i), -np.inf)
        sides = np.roll(at, -1, axis=0) - at
        for n, e in [(1.0, 0.0), (0.0, 1.0), *((b / math.hypot(a, b), -a / math.hypot(a, b)) for a, b in sides.tolist() if a or b)]:
            own = at @ np.array([n, e])
            cells = np.stack([n * x[0] + e * y[1] for x in (low, high) for y in (low, high)])
            np.maximum(gap, np.maximum(cells.min(0) - own.max(), own.min() - cells.max(0)), out=gap)
        gap -= shape.radius
    out = [(int(a), int(b)) for a, b, g in zip(i, j, gap, strict=True) if g <= TOUCH]
    return out or [(math.floor(o[0] / CELL), math.floor(o[1] / CELL))]


# --- outlines of sets of cells


def outlines(cells: set[tuple[int, int]]) -> list[list[list[Point]]]:
    """Polygons of a set of cells: outer rings counter-clockwise on the map with their holes; diagonal cells stay apart."""
    leaving: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for r, c in cells:
        # the cell stays on the left of each side walked
        for (dr, dc), a, b in (((-1, 0), (r, c), (r, c + 1)), ((0, 1), (r, c + 1), (r + 1, c + 1)), ((1, 0), (r + 1, c + 1), (r + 1, c)), ((0, -1), (r + 1, c), (r, c))):
            if (r + dr, c + dc) not in cells:
                leaving[a].append(b)
    rings: list[list[tuple[int, int]]] = []
    while leaving:
        start = min(leaving)
        ring, at, came = [], start, None
        while True:
            ways = leaving[at]
            if len(ways) > 1 and came is not None:
                # at a corner shared by two cells the left turn stays with its own
                d = at[0] - came[0], at[1] - came[1]
                left = at[0] + d[1], at[1] - d[0]
                way = left if left in ways else ways[0]
            else:
                way = ways[0]
            ways.remove(way)
            if not ways:
                del leaving[at]
            if not ring or len(ring) < 2 or _side(ring[-2], ring[-1], at) != 0:
                ring.append(at)
            else:
                ring[-1] = at
            came, at = at, way
            if at == start:
                break
        while len(ring) > 3 and _side(ring[-2], ring[-1], ring[0]) == 0:
            ring.pop()
        while len(ring) > 3 and _side(ring[-1], ring[0], ring[1]) == 0:
            ring.pop(0)
        rings.append(ring)
    metres = [[(float(r * CELL), float(c * CELL)) for r, c in ring] for ring in rings]
    outer = sorted((ring for ring in metres if ring_area(ring) > 0), key=ring_area)
    holes: dict[int, list[list[Point]]] = defaultdict(list)
    for hole in (ring for ring in metres if ring_area(ring) < 0):
        middle = np.array([np.mean([hole[0][0], hole[1][0]])]), np.array([np.mean([hole[0][1], hole[1][1]])])
        i = next(i for i, ring in enumerate(outer) if Polygon(tuple(ring)).contains(*middle)[0] or tuple(hole[0]) in map(tuple, ring))
        holes[i].append(hole)
    return [[ring, *holes[i]] for i, ring in enumerate(outer)]


def ring_area(ring: list[Point]) -> float:
    """Signed area; positive where the ring runs counter-clockwise with east to the right and north up."""
    return sum(e0 * n1 - e1 * n0 for (n0, e0), (n1, e1) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def simplified(ring: list[Point], within: float) -> list[Point]:
    """A closed ring without the points nearer than ``within`` to the line kept (Douglas and Peucker, split at the farthest point)."""
    if len(ring) <= 4:
        return ring
    far = max(range(len(ring)), key=lambda i: math.dist(ring[0], ring[i]))

    def thin(line: list[Point]) -> list[Point]:
        if len(line) < 3:
            return line
        gaps = [point_segment(p, line[0], line[-1]) for p in line[1:-1]]
        k = max(range(len(gaps)), key=gaps.__getitem__) + 1
        return [line[0], line[-1]] if gaps[k - 1] <= within else thin(line[: k + 1])[:-1] + thin(line[k:])

    out = thin(ring[: far + 1])[:-1] + thin([*ring[far:], ring[0]])[:-1]
    return out if len(out) > 2 else ring


# --- GeoJSON


def coordinates(ring: list[Point], outer: bool = True) -> list[list[float]]:
    """Longitudes and latitudes to seven places, closed; outer rings counter-clockwise, holes clockwise."""
    if (ring_area(ring) > 0) != outer:
        ring = ring[::-1]
    n, e = (np.array(v) for v in zip(*[*ring, ring[0]], strict=True))
    lat, lon = latlon(n, e, m=ARRAYS)
    return [[round(float(x), 7), round(float(y), 7)] for x, y in zip(lon, lat, strict=True)]


def feature(kind: str, coords: list, **properties) -> dict:
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coords}, "properties": properties}


def polygon_feature(polygon: list[list[Point]], **properties) -> dict:
    return feature("Polygon", [coordinates(ring, i == 0) for i, ring in enumerate(polygon)], **properties)


def collection(features: list[dict]) -> str:
    return json.dumps({"type": "FeatureCollection", "features": features}, separators=(",", ":"))
