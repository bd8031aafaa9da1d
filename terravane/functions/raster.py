"""Numpy kernels over a dense block of cells: layers, sweeps, sightlines.

A block knows nothing of Spark; rows run north, columns east, and what has no
ground is NaN (heights) or -1 (codes).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..sources.synthetic import CELL, COVER, SEA, TILE, Form

#: How far the ground counts exactly in a sweep, the step of a radial, the step of an exact line.
MESH_REACH, RAY_STEP, PIECE = 1000.0, 25.0, 6.25
#: Metres by which the ground may rise over a line before it blocks.
TOLERANCE = 1e-4
DISTANCE_CAP = 5000.0
BINS, HORIZON_SPAN, HORIZON_RANGE, HORIZON_EYE = 32, 4, 40_000.0, 2.0
#: Lowest angle and step of a horizon code, degrees; the code of no ground.
CODE_FLOOR, CODE_STEP, NO_CODE = -10.0, 0.25, 255
FLAT = 0.5


@dataclass
class Block:
    """A window of cells from (row, col); ``form`` gives the exact ground where there is one."""

    row: int
    col: int
    h: np.ndarray
    water: np.ndarray
    surface: np.ndarray
    cover: np.ndarray
    form: Form | None = None
    #: Layers computed once for all that ask of this block.
    kept: dict = field(default_factory=dict)

    @classmethod
    def from_tiles(cls, tiles: list[tuple[int, int, bytes, bytes, bytes, bytes]], row: int, col: int, rows: int, cols: int, form: Form | None = None) -> Block:
        h = np.full((rows, cols), np.nan)
        codes = [np.full((rows, cols), -1, np.int16) for _ in range(3)]
        for tr, tc, *packed in tiles:
            r0, c0 = tr * TILE, tc * TILE
            a, b, c, d = max(r0, row), min(r0 + TILE, row + rows), max(c0, col), min(c0 + TILE, col + cols)
            if a >= b or c >= d:
                continue
            part = lambda raw, kind: np.frombuffer(raw, kind).reshape(TILE, TILE)[a - r0 : b - r0, c - c0 : d - c0]  # noqa: B023, E731
            v = part(packed[0], "<i2").astype(float)
            v[v == -32768] = np.nan
            h[a - row : b - row, c - col : d - col] = v
            for out, raw, none in zip(codes, packed[1:], (255, 0, 0), strict=True):
                v = part(raw, "u1").astype(np.int16)
                out[a - row : b - row, c - col : d - col] = np.where(v == none, -1, v)
        return cls(row, col, h, *codes, form)

    @property
    def shape(self) -> tuple[int, int]:
        return self.h.shape

    def slope(self) -> np.ndarray:
        if "slope" not in self.kept:
            self.kept["slope"] = slope_layers(self.h)["slope"]
        return self.kept["slope"]

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        r, c = np.meshgrid(np.arange(self.shape[0]) + self.row, np.arange(self.shape[1]) + self.col, indexing="ij")
        return r * float(CELL) + CELL / 2, c * float(CELL) + CELL / 2

    def bilinear(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The height between the four cell centres around each point; NaN where any is missing."""
        fr, fc = n / float(CELL) - 0.5, e / float(CELL) - 0.5
        r, c = np.floor(fr), np.floor(fc)
        fr, fc = fr - r, fc - c
        r, c = r.astype(np.int64) - self.row, c.astype(np.int64) - self.col
        ok = (r >= 0) & (c >= 0) & (r + 1 < self.shape[0]) & (c + 1 < self.shape[1])
        r, c = np.where(ok, r, 0), np.where(ok, c, 0)
        h = self.h
        out = h[r, c] * (1 - fr) * (1 - fc) + h[r, c + 1] * (1 - fr) * fc + h[r + 1, c] * fr * (1 - fc) + h[r + 1, c + 1] * fr * fc
        return np.where(ok, out, np.nan)

    def ground(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The exact ground where there is a closed form, else the raster's."""
        if self.form is None:
            return self.bilinear(n, e)
        return np.where(self.form.covered(n, e), self.form.height(n, e), np.nan)


# --- derived layers


def _shifted(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The value of the cell ``dr`` rows north and ``dc`` columns east; NaN beyond the block."""
    out = np.full(a.shape, np.nan)
    rows, cols = a.shape
    out[max(0, -dr) : rows - max(0, dr), max(0, -dc) : cols - max(0, dc)] = a[max(0, dr) : rows - max(0, -dr), max(0, dc) : cols - max(0, -dc)]
    return out


def slope_layers(h: np.ndarray) -> dict[str, np.ndarray]:
    """slope, aspect and roughness by Horn's 3 x 3 neighbourhood; NaN where any of the nine is missing."""
    k = {(a, b): _shifted(h, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    north = ((k[1, -1] + 2 * k[1, 0] + k[1, 1]) - (k[-1, -1] + 2 * k[-1, 0] + k[-1, 1])) / (8.0 * CELL)
    east = ((k[-1, 1] + 2 * k[0, 1] + k[1, 1]) - (k[-1, -1] + 2 * k[0, -1] + k[1, -1])) / (8.0 * CELL)
    nine = np.stack(list(k.values()))
    missing = np.isnan(nine).any(0)
    slope = np.degrees(np.arctan(np.sqrt(north * north + east * east)))
    aspect = np.degrees(np.arctan2(-east, -north))
    aspect = np.where(aspect < 0, aspect + 360.0, aspect) + 0.0
    slope[missing] = np.nan
    return {"slope": slope, "aspect": np.where(slope >= FLAT, aspect, np.nan), "roughness": np.where(missing, np.nan, nine.max(0) - nine.min(0))}


def disk_sum(a: np.ndarray, radius: float) -> np.ndarray:
    """The sum over cells whose centres lie within the radius; beyond the block counts as 0."""
    k = int(radius // CELL)
    wide = np.pad(a, k)
    run = np.concatenate([np.zeros((wide.shape[0], 1)), np.cumsum(wide, axis=1)], axis=1)
    rows, cols = a.shape
    out = np.zeros(a.shape)
    for d in range(-k, k + 1):
        half = int(math.sqrt(k * k - d * d))
        line = run[k + d : k + d + rows]
        out += line[:, k + half + 1 : k + half + 1 + cols] - line[:, k - half : k - half + cols]
    return out


def position(h: np.ndarray, radius: float) -> np.ndarray:
    """Height less the mean of the known heights in the disk."""
    known = ~np.isnan(h)
    with np.errstate(invalid="ignore", divide="ignore"):
        return h - disk_sum(np.where(known, h, 0.0), radius) / disk_sum(known.astype(float), radius)


def cover_share(cover: np.ndarray, code: int, radius: float) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return disk_sum((cover == code).astype(float), radius) / disk_sum((cover >= 0).astype(float), radius)


def distance(seeds: np.ndarray, cap: float = DISTANCE_CAP) -> np.ndarray:
    """Exact distance between cell centres to the nearest seed, ``cap`` beyond it."""
    rows, cols = seeds.shape
    k = int(math.ceil(cap / CELL))
    r = np.arange(rows)[:, None]
    below = np.maximum.accumulate(np.where(seeds, r, -(10**6)), axis=0)
    above = np.minimum.accumulate(np.where(seeds, r, 10**6)[::-1], axis=0)[::-1]
    up = np.minimum(r - below, above - r).astype(float) ** 2
    best = np.full((rows, cols), np.inf)
    for d in range(-min(k, cols - 1), min(k, cols - 1) + 1):
        a, b = max(0, -d), cols - max(0, d)
        np.minimum(best[:, a:b], up[:, a + d : b + d] + d * d, out=best[:, a:b])
    return np.minimum(np.sqrt(best) * CELL, cap)


def crossed(a: tuple[float, float], b: tuple[float, float]) -> list[tuple[int, int, float, float]]:
    """The cells a segment runs through, with the shares of it at which it enters and leaves each.

    Metres north and east.  A segment through a corner touches the two cells
    beside it with a share of no length.
    """
    (n0, e0), (n1, e1) = a, b
    ts = {0.0, 1.0}
    for x0, x1 in ((n0, n1), (e0, e1)):
        if x0 != x1:
            lo, hi = sorted((x0 / CELL, x1 / CELL))
            ts |= {t for k in range(math.ceil(lo), math.floor(hi) + 1) if 0 < (t := (k * CELL - x0) / (x1 - x0)) < 1}
    marks = sorted(ts)
    out: list[tuple[int, int, float, float]] = []
    for s, t in zip(marks, marks[1:], strict=False):
        if t - s <= 1e-12 and len(marks) > 2:
            continue
        m = (s + t) / 2
        cell = math.floor((n0 + m * (n1 - n0)) / CELL), math.floor((e0 + m * (e1 - e0)) / CELL)
        if out and abs(cell[0] - out[-1][0]) == 1 and abs(cell[1] - out[-1][1]) == 1:
            out += [(out[-1][0], cell[1], s, s), (cell[0], out[-1][1], s, s)]
        if out and out[-1][:2] == cell:
            out[-1] = (*cell, out[-1][2], t)
        else:
            out.append((*cell, s, t))
    return out or [(math.floor(n0 / CELL), math.floor(e0 / CELL), 0.0, 1.0)]


def line_cells(lines: list[np.ndarray], row: int, col: int, rows: int, cols: int) -> np.ndarray:
    """Which cells of a window a set of polylines (n, e) passes through."""
    out = np.zeros((rows, cols), bool)
    for line in lines:
        for p, q in zip(line, line[1:], strict=False):
            for r, c, s, t in crossed(tuple(p), tuple(q)):
                if t > s and row <= r < row + rows and col <= c < col + cols:
                    out[r - row, c - col] = True
    return out


def horizon_codes(block: Block, cells: np.ndarray, reach: float = HORIZON_RANGE) -> np.ndarray:
    """Codes (cells x 32) of the highest angle along each bearing, for horizon cells (hr, hc) of four by four cells."""
    half = CELL / 2
    n0 = (cells[:, 0] * HORIZON_SPAN + HORIZON_SPAN / 2) * float(CELL)
    e0 = (cells[:, 1] * HORIZON_SPAN + HORIZON_SPAN / 2) * float(CELL)
    eye = block.bilinear(n0, e0)
    out = np.full((len(cells), BINS), NO_CODE, np.int16)
    d = np.arange(1, int(reach // half) + 1) * half
    for b in range(BINS):
        turn = 2 * math.pi * b / BINS
        dn, de = math.cos(turn), math.sin(turn)
        for i in np.flatnonzero(~np.isnan(eye)):
            with np.errstate(invalid="ignore"):
                rise = (block.bilinear(n0[i] + d * dn, e0[i] + d * de) - eye[i] - HORIZON_EYE) / d
            best = np.nanmax(rise) if not np.isnan(rise).all() else -np.inf
            angle = max(math.degrees(math.atan(best)), CODE_FLOOR)
            out[i, b] = min(max(math.floor((angle - CODE_FLOOR) / CODE_STEP + 0.5), 0), NO_CODE - 1)
    return out


def code_degrees(code: np.ndarray) -> np.ndarray:
    return np.where(code == NO_CODE, np.nan, CODE_FLOOR + code * CODE_STEP)


# --- lines of sight


def exact_line(block: Block, a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[bool, float, tuple[float, float, float] | None]:
    """(seen, clearance, where it is first blocked) between two points with altitudes.

    The ground is straight over pieces of an eighth of a cell; a piece with an
    end off the ground never blocks.
    """
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    m = max(1, math.ceil(length / PIECE))
    t = np.arange(m + 1) / m
    ground = block.ground(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
    gap = a[2] + (b[2] - a[2]) * t - ground
    piece = ~np.isnan(gap[:-1]) & ~np.isnan(gap[1:])
    if not piece.any():
        return True, math.nan, None
    ends = np.zeros(m + 1, bool)
    ends[:-1] |= piece
    ends[1:] |= piece
    low = np.flatnonzero(piece & (np.minimum(gap[:-1], gap[1:]) < -TOLERANCE))
    if not len(low):
        return True, float(gap[ends].min()), None
    k = int(low[0])
    s = t[k] if gap[k] < -TOLERANCE else t[k] + (t[k + 1] - t[k]) * (gap[k] + TOLERANCE) / (gap[k] - gap[k + 1])
    at = a[0] + (b[0] - a[0]) * s, a[1] + (b[1] - a[1]) * s
    h = ground[k] + (ground[k + 1] - ground[k]) * (s - t[k]) / (t[k + 1] - t[k])
    return False, float(gap[ends].min()), (float(at[0]), float(at[1]), float(h))


def exact_floor(block: Block, a: tuple[float, float, float], b: tuple[float, float]) -> float:
    """The lowest altitude over ``b`` that is seen from ``a``, the ground of ``b`` itself aside; infinite where the eye is under ground."""
    m = max(1, math.ceil(math.hypot(b[0] - a[0], b[1] - a[1]) / PIECE))
    t = np.arange(m + 1) / m
    ground = block.ground(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
    if ground[0] - a[2] > TOLERANCE:
        return math.inf
    ok = ~np.isnan(ground)
    ok[0] = False
    if not ok.any():
        return -math.inf
    return float((a[2] + (ground[ok] - a[2] - TOLERANCE / 2) / t[ok]).max())


def walk(block: Block, a: tuple[float, float, float], b: tuple[float, float, float], step: float = RAY_STEP) -> bool:
    """Whether the raster leaves the line free at each step strictly between its ends."""
    n = math.ceil(math.hypot(b[0] - a[0], b[1] - a[1]) / step)
    t = np.arange(1, n) / max(n, 1)
    gap = a[2] + (b[2] - a[2]) * t - block.bilinear(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
    return not (gap < 0).any()


@dataclass
class Sweep:
    """Cells within a radius of a site: row, column, distance, height and least visible height above ground."""

    r: np.ndarray
    c: np.ndarray
    d: np.ndarray
    h: np.ndarray
    floor: np.ndarray


def sweep(block: Block, n: float, e: float, eye: float, radius: float) -> Sweep:
    """Running maxima of slopes along radials; a cell reads the radial nearest in bearing at the last step short of it."""
    radials, steps = max(8, math.ceil(2 * math.pi * radius / CELL)), math.ceil(radius / RAY_STEP)
    turn = 2 * math.pi / radials
    k, d = np.arange(radials)[:, None], (np.arange(steps) + 1)[None, :] * RAY_STEP
    at = n + d * np.cos(k * turn), e + d * np.sin(k * turn)
    near = int(min(steps, MESH_REACH // RAY_STEP))
    slope = np.empty((radials, steps))
    slope[:, near:] = (block.bilinear(at[0][:, near:], at[1][:, near:]) - eye) / d[:, near:]
    slope[:, :near] = (block.ground(at[0][:, :near], at[1][:, :near]) - TOLERANCE / 2 - eye) / d[:, :near]
    steepest = np.maximum.accumulate(np.where(np.isnan(slope), -np.inf, slope), axis=1)
    cn, ce = block.centres()
    off = np.sqrt((cn - n) * (cn - n) + (ce - e) * (ce - e))
    r, c = np.nonzero(((cn - n) * (cn - n) + (ce - e) * (ce - e) <= radius * radius) & ~np.isnan(block.h))
    dist, h = off[r, c], block.h[r, c]
    bearing = np.degrees(np.arctan2(ce[r, c] - e, cn[r, c] - n))
    bearing = np.where(bearing < 0, bearing + 360.0, bearing)
    ray = np.floor(bearing / math.degrees(turn) + 0.5).astype(np.int64) % radials
    last = np.maximum(np.ceil(dist / RAY_STEP), 1).astype(np.int64) - 1
    steep = np.where(last > 0, steepest[ray, np.maximum(last, 1) - 1], -np.inf)
    with np.errstate(invalid="ignore"):
        floor = np.where(np.isfinite(steep), np.maximum(0.0, eye + np.where(np.isfinite(steep), steep, 0) * dist - h), 0.0)
    return Sweep(r + block.row, c + block.col, dist, h, floor)


COVER_NAMES = {v: k for k, v in COVER.items()}
SEA_CODE = SEA
