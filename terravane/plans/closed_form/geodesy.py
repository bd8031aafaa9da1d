"""Transverse Mercator (sixth-order Krueger series), bearings and compass names."""

from __future__ import annotations

from .terrain import num

# WGS84 and the terrain's projection.
A, F_ = 6378137.0, 1 / 298.257223563
K0, LON0, EASTING, NORTHING = 0.9996, 33, 99517, 4998115
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")

_n = F_ / (2 - F_)
#: Rectifying radius times scale.
_R = K0 * A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# Series coefficients as polynomials in the third flattening, from n^1 up to n^6.
_ALPHA = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
    [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
    [0, 0, 0, 0, 0, 212378941 / 319334400],
]
_BETA = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
    [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680],
    [0, 0, 0, 0, 0, 20648693 / 638668800],
]
_value = lambda table: [sum(c * _n ** (k + 1) for k, c in enumerate(row)) for row in table]
_ECC = (F_ * (2 - F_)) ** 0.5


def to_latlon(relation: str, x: str = "x", z: str = "z") -> str:
    """The relation with lat and lon (degrees) of x north, z east."""
    beta = _value(_BETA)
    eta = " - ".join(["eta0", *(f"{num(b)} * cos({2 * k} * xi0) * sinh({2 * k} * eta0)" for k, b in enumerate(beta, 1))])
    xi = " - ".join(["xi0", *(f"{num(b)} * sin({2 * k} * xi0) * cosh({2 * k} * eta0)" for k, b in enumerate(beta, 1))])
    # chi -> phi: fixed-point steps on tau, three are exact to a micron
    inner = f"SELECT *, sin(xi) / sqrt(sinh(eta) * sinh(eta) + cos(xi) * cos(xi)) AS taup, degrees(atan2(sinh(eta), cos(xi))) + {LON0}e0 AS lon FROM (SELECT *, {xi} AS xi, {eta} AS eta FROM (SELECT *, ({x} + {NORTHING}e0) / {num(_R)} AS xi0, ({z} + {EASTING}e0) / {num(_R)} AS eta0 FROM {relation} g0) g1) g2"
    tau = "taup"
    for k in range(4):
        sg = f"sinh({num(_ECC)} * atanh({num(_ECC)} * {tau} / sqrt(1e0 + {tau} * {tau})))"
        inner = f"SELECT *, {sg} AS sg{k} FROM ({inner}) h{k}"
        tp = f"({tau} * sqrt(1e0 + sg{k} * sg{k}) - sg{k} * sqrt(1e0 + {tau} * {tau}))"
        new = f"{tau} + (taup - {tp}) / sqrt(1e0 + {tp} * {tp}) * (1e0 + {num(1 - _ECC**2)} * {tau} * {tau}) / ({num(1 - _ECC**2)} * sqrt(1e0 + {tau} * {tau}))"
        inner = f"SELECT *, {new} AS tau{k} FROM ({inner}) k{k}"
        tau = f"tau{k}"
    return f"(SELECT *, degrees(atan({tau})) AS lat FROM ({inner}) m)"


def to_xz(relation: str, lat: str = "lat", lon: str = "lon") -> str:
    """The relation with x2 north and z2 east of lat and lon."""
    alpha = _value(_ALPHA)
    e = num(_ECC)
    phi = f"SELECT *, sin(radians({lat})) AS sp, radians({lon} - {LON0}e0) AS dl FROM {relation} p0"
    conformal = f"SELECT *, sinh(atanh(sp) - {e} * atanh({e} * sp)) AS tc FROM ({phi}) p1"
    start = f"SELECT *, atan2(tc, cos(dl)) AS xp, atanh(sin(dl) / sqrt(1e0 + tc * tc)) AS ep FROM ({conformal}) p2"
    xi = " + ".join(["xp", *(f"{num(a)} * sin({2 * k} * xp) * cosh({2 * k} * ep)" for k, a in enumerate(alpha, 1))])
    eta = " + ".join(["ep", *(f"{num(a)} * cos({2 * k} * xp) * sinh({2 * k} * ep)" for k, a in enumerate(alpha, 1))])
    return f"(SELECT *, {num(_R)} * ({xi}) - {NORTHING}e0 AS x2, {num(_R)} * ({eta}) - {EASTING}e0 AS z2 FROM ({start}) p3)"


def bearing(dn: str, de: str) -> str:
    """Degrees clockwise from north, 0 up to 360."""
    b = f"degrees(atan2({de}, {dn}))"
    return f"(CASE WHEN {b} < 0e0 THEN {b} + 360e0 ELSE {b} END)"


def compass(degrees: str) -> str:
    names = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(COMPASS))
    return f"(CASE CAST(floor({degrees} / 45e0 + 0.5e0) AS BIGINT) % 8 {names} END)"
