"""Transverse Mercator, true bearings and grid references.

Every formula takes the functions it needs from ``m``, so the same text serves
Spark columns (``COLUMNS``) and numpy arrays (``ARRAYS``).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.synthetic import ORIGIN

# The ellipsoid and the scale on the meridian.
RADIUS, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
# Krueger's series, powers of the third flattening from the first one, forward and back.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
    [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
    [0, 0, 0, 0, 0, 212378941 / 319334400],
]
BACK = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
    [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680],
    [0, 0, 0, 0, 0, 20648693 / 638668800],
]
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
# Letters of the bands from 80 degrees south, of the columns by zone and of the rows.
BANDS = "CDEFGHJKLMNPQRSTUVWXX"
SQUARE_COLUMNS, SQUARE_ROWS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ"), "ABCDEFGHJKLMNPQRSTUV"

_N = FLATTENING / (2 - FLATTENING)
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
_RECTIFY = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_fold = lambda table: [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in table]
_FORWARD, _BACK = _fold(FORWARD), _fold(BACK)

_names = ("sin", "cos", "sinh", "cosh", "tanh", "atan", "atanh", "sqrt", "atan2", "degrees", "radians", "floor")
_column_functions = {k: getattr(F, k) for k in _names} | {"where": lambda c, a, b: F.when(c, a).otherwise(b)}
COLUMNS = SimpleNamespace(**_column_functions, keep=lambda x: x)
ARRAYS = SimpleNamespace(**{k: getattr(np, {"atan": "arctan", "atanh": "arctanh", "atan2": "arctan2"}.get(k, k)) for k in _names}, where=np.where, keep=lambda x: x)


class Staged(SimpleNamespace):
    """Column functions over a frame: ``keep`` makes a column of a value used many times, so that it is computed once.

    ``done`` gives the frame with the named results and without the kept columns.
    """

    def __init__(self, df: DataFrame):
        super().__init__(**_column_functions)
        self.df, self.own, self.count = df, df.columns, 0

    def keep(self, value: Column) -> Column:
        self.count += 1
        name = f"__kept_{self.count}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def done(self, **results: Column) -> DataFrame:
        return self.df.select(*(F.col(f"`{c}`") for c in self.own if c not in results), *(v.alias(k) for k, v in results.items()))


@dataclass(frozen=True)
class Mercator:
    """A transverse Mercator: map x north and z east of metres on the ground."""

    lon0: float = 33.0
    easting: float = 99517.0
    northing: float = 4998115.0

    def forward(self, lat, lon, m=COLUMNS):
        """(north, east) in map metres."""
        n, e = krueger(lat, lon - self.lon0, m)
        return n - self.northing, e - self.easting

    def back(self, x, z, m=COLUMNS):
        """(lat, lon) in degrees."""
        lat, dlon = krueger_back(x + self.northing, z + self.easting, m)
        return lat, dlon + self.lon0


def krueger(lat, dlon, m=COLUMNS):
    """Metres north of the equator and east of the meridian."""
    lam, s = m.keep(m.radians(dlon)), m.keep(m.sin(m.radians(lat)))
    psi = m.keep(m.atanh(s) - _ECC * m.atanh(_ECC * s))  # isometric latitude
    xi0, eta0 = m.keep(m.atan2(m.sinh(psi), m.cos(lam))), m.keep(m.atanh(m.sin(lam) / m.cosh(psi)))
    xi, eta = xi0, eta0
    for k, a in enumerate(_FORWARD, 1):
        xi = xi + a * m.sin(2 * k * xi0) * m.cosh(2 * k * eta0)
        eta = eta + a * m.cos(2 * k * xi0) * m.sinh(2 * k * eta0)
    return m.keep(K0 * _RECTIFY * xi), m.keep(K0 * _RECTIFY * eta)


def krueger_back(north, east, m=COLUMNS):
    """(latitude, degrees east of the meridian)."""
    xi1, eta1 = m.keep(north / (K0 * _RECTIFY)), m.keep(east / (K0 * _RECTIFY))
    xi, eta = xi1, eta1
    for k, b in enumerate(_BACK, 1):
        xi = xi - b * m.sin(2 * k * xi1) * m.cosh(2 * k * eta1)
        eta = eta - b * m.cos(2 * k * xi1) * m.sinh(2 * k * eta1)
    xi, eta = m.keep(xi), m.keep(eta)
    conformal = m.keep(m.sin(xi) / m.cosh(eta))
    psi = m.keep(m.atanh(conformal))
    # the latitude whose isometric latitude is psi: each step gains two digits and a half
    s = conformal
    for _ in range(7):
        s = m.tanh(psi + _ECC * m.atanh(_ECC * s))
    s = m.keep(s)
    return m.keep(m.degrees(m.atan(s / m.sqrt(1 - s * s)))), m.keep(m.degrees(m.atan2(m.sinh(eta), m.cos(xi))))


def latlon(n, e, crs: Mercator = Mercator(), m=COLUMNS):
    """(lat, lon) of metres from the grid's corner."""
    return crs.back(n + ORIGIN[0], e + ORIGIN[1], m)


def bearing(dn, de, m=COLUMNS):
    """Degrees clockwise from north, 0 up to 360."""
    b = m.keep(m.degrees(m.atan2(de, dn)))
    return m.where(b < 0, b + 360.0, b)


def ecef(lat, lon, m=COLUMNS):
    """Earth-centred coordinates of a point at height 0."""
    p, q = m.keep(m.radians(lat)), m.keep(m.radians(lon))
    r = RADIUS / m.sqrt(1 - _ECC**2 * m.sin(p) * m.sin(p))
    return r * m.cos(p) * m.cos(q), r * m.cos(p) * m.sin(q), r * (1 - _ECC**2) * m.sin(p)


def true_bearing(lat1, lon1, lat2, lon2, m=COLUMNS):
    """The azimuth of the normal section from one point to another."""
    a, b = ecef(lat1, lon1, m), ecef(lat2, lon2, m)
    d = [m.keep(y - x) for x, y in zip(a, b, strict=True)]
    p, q = m.keep(m.radians(lat1)), m.keep(m.radians(lon1))
    east = d[1] * m.cos(q) - d[0] * m.sin(q)
    north = d[2] * m.cos(p) - m.sin(p) * (d[0] * m.cos(q) + d[1] * m.sin(q))
    return bearing(north, east, m)


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in COMPASS)), (F.floor(degrees / 45 + 0.5) % 8 + 1).cast("int"))


# --- grid references


def _letter(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), (at + 1).cast("int"), F.lit(1))


def utm_zone(lat: Column, lon: Column) -> Column:
    """The zone, with the exceptions of south-west Norway and Svalbard."""
    plain = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    out = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
    for west, east, zone in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        out = out.when((lat >= 72) & (lat < 84) & (lon >= west) & (lon < east), zone)
    return out.otherwise(plain).cast("int")


def mgrs(lat: Column, lon: Column, m=COLUMNS) -> Column:
    """The reference to the metre, like ``31N AA 66021 00000``; null beyond 80 degrees south and 84 degrees north."""
    lon = m.keep(lon - 360 * F.floor((lon + 180) / 360))
    zone = m.keep(utm_zone(lat, lon))
    n, e = krueger(lat, lon - (zone * 6 - 183), m)
    n, e = m.keep(F.round(F.when(lat < 0, n + 10_000_000.0).otherwise(n), 6)), m.keep(F.round(e + 500_000.0, 6))
    column = F.element_at(F.array(*(F.lit(s) for s in SQUARE_COLUMNS)), ((zone - 1) % 3 + 1).cast("int"))
    column = F.substr(column, F.floor(e / 100_000).cast("int"), F.lit(1))
    row = _letter(SQUARE_ROWS, (F.floor(n / 100_000) + F.when(zone % 2 == 0, 5).otherwise(0)) % 20)
    band = _letter(BANDS, F.least(F.floor((lat + 80) / 8), F.lit(20)))
    digits = lambda v: F.lpad(F.floor(v - 100_000 * F.floor(v / 100_000)).cast("string"), 5, "0")
    text = F.concat(zone.cast("string"), band, F.lit(" "), column, row, F.lit(" "), digits(e), F.lit(" "), digits(n))
    return F.when((lat >= -80) & (lat <= 84), text)


def parse_mgrs(text: str) -> tuple[float, float, float]:
    """(lat, lon, side) of the centre of the square that a reference names; ValueError says what is wrong with it."""
    found = re.fullmatch(r"(\d{1,2})([A-Z])([A-Z])([A-Z])(\d*)", re.sub(r"\s+", "", text).upper())
    if not found:
        raise ValueError("a reference is a zone, its band, two letters and digits")
    zone, band, col, row, digits = int(found[1]), found[2], found[3], found[4], found[5]
    if not 1 <= zone <= 60 or band not in BANDS:
        raise ValueError("the zone must be 1 to 60 and the band C to X")
    if len(digits) % 2 or not 2 <= len(digits) <= 10:
        raise ValueError("two to ten digits follow, easting before northing")
    letters = SQUARE_COLUMNS[(zone - 1) % 3]
    if col not in letters or row not in SQUARE_ROWS:
        raise ValueError(f"no square {col}{row} in zone {zone}")
    half = len(digits) // 2
    side = 10.0 ** (5 - half)
    east = (letters.index(col) + 1) * 100_000 + int(digits[:half]) * side + side / 2
    north = (SQUARE_ROWS.index(row) - (5 if zone % 2 == 0 else 0)) % 20 * 100_000 + int(digits[half:]) * side + side / 2
    south = -80 + 8 * BANDS.index(band)
    top = 84 if band == "X" else south + 8
    for lap in range(10):
        n = north + 2_000_000 * lap - (10_000_000 if south < 0 else 0)
        lat, dlon = (float(v) for v in krueger_back(np.float64(n), np.float64(east - 500_000), ARRAYS))
        if south - 1e-4 <= lat < top + 1e-4 and (n >= 0) == (south >= 0):
            return lat, zone * 6 - 183 + dlon, side
    raise ValueError("the square lies outside its band")
