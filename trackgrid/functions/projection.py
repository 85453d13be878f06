"""Coordinate transforms as column expressions, for a closed list of systems.

Formulas: spherical and Mercator from Snyder, *Map Projections - A Working
Manual* (1987); transverse Mercator by the Krüger series to third order.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid and sphere constants and the parameters of the
# listed Albers systems (standard parallels, origin latitude and longitude,
# false easting and northing).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
MODIS_RADIUS = 6371007.181
ALBERS = {
    "EPSG:3005": (50.0, 58.5, 45.0, -126.0, 1_000_000.0, 0.0),
    "EPSG:3338": (55.0, 65.0, 50.0, -154.0, 0.0, 0.0),
    "EPSG:5070": (29.5, 45.5, 23.0, -96.0, 0.0, 0.0),
    "ESRI:102001": (50.0, 70.0, 40.0, -96.0, 0.0, 0.0),
    "ESRI:102008": (20.0, 60.0, 40.0, -96.0, 0.0, 0.0),
}
GEOGRAPHIC = ("EPSG:4326", "EPSG:4269", "OGC:CRS84")
MERCATOR = ("EPSG:3857", "EPSG:900913")
SINUSOIDAL = ("SR-ORG:6974", "MODIS")
WGS84 = "EPSG:4326"

_E = math.sqrt(WGS84_F * (2 - WGS84_F))


def normalise(crs: str | int | None) -> str:
    """Spelling used for comparison: ``4326`` and ``epsg:4326`` are one system."""
    if crs is None:
        return WGS84
    text = str(crs).strip().upper().replace("URN:OGC:DEF:CRS:", "").replace("::", ":")
    if text.isdigit():
        text = f"EPSG:{text}"
    return WGS84 if text in ("OGC:1.3:CRS84", "OGC:CRS84", "CRS84", "WGS84") else text


def _utm(crs: str):
    m = re.fullmatch(r"EPSG:32([67])(\d{2})", crs)
    if m and 1 <= int(m.group(2)) <= 60:
        return int(m.group(2)), m.group(1) == "7"
    return None


def reproject(x: Column, y: Column, source: str | int, target: str | int) -> tuple[Column, Column]:
    """(x, y) in ``target``; systems outside the list raise."""
    source, target = normalise(source), normalise(target)
    if source == target:
        return x, y
    lon, lat = _inverse(source, x, y)
    return _forward(target, lon, lat)


def _forward(crs: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    if crs in GEOGRAPHIC:
        return lon, lat
    if crs in MERCATOR:
        return lam * WGS84_A, F.log(F.tan(phi / 2 + math.pi / 4)) * WGS84_A
    if crs in SINUSOIDAL:
        return lam * F.cos(phi) * MODIS_RADIUS, phi * MODIS_RADIUS
    if utm := _utm(crs):
        return _krueger_forward(lam, phi, *utm)
    if crs in ALBERS:
        return _albers_forward(lam, phi, *ALBERS[crs])
    raise ValueError(f"coordinate system {crs} is not supported")


def _inverse(crs: str, x: Column, y: Column) -> tuple[Column, Column]:
    if crs in GEOGRAPHIC:
        return x, y
    if crs in MERCATOR:
        return F.degrees(x / WGS84_A), F.degrees(F.atan(F.exp(y / WGS84_A)) * 2 - math.pi / 2)
    if crs in SINUSOIDAL:
        phi = y / MODIS_RADIUS
        return F.degrees(x / (F.cos(phi) * MODIS_RADIUS)), F.degrees(phi)
    if utm := _utm(crs):
        return _krueger_inverse(x, y, *utm)
    if crs in ALBERS:
        return _albers_inverse(x, y, *ALBERS[crs])
    raise ValueError(f"coordinate system {crs} is not supported")


# Transverse Mercator --------------------------------------------------------

_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _E0, _SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _krueger_forward(lam, phi, zone, south):
    dlam = lam - math.radians(zone * 6 - 183)
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * c) * c)
    xi = F.atan(t / F.cos(dlam))
    eta = F.atanh(F.sin(dlam) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a
        north = north + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a
    scale = _K0 * _RECTIFYING
    return east * scale + _E0, north * scale + (_SOUTH if south else 0.0)


def _krueger_inverse(x, y, zone, south):
    scale = _K0 * _RECTIFYING
    xi, eta = (y - (_SOUTH if south else 0.0)) / scale, (x - _E0) / scale
    xi2, eta2 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi2 = xi2 - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b
        eta2 = eta2 - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.sin(chi * 2 * j) * d
    lam = F.atan2(F.sinh(eta2), F.cos(xi2)) + math.radians(zone * 6 - 183)
    return F.degrees(lam), F.degrees(phi)


# Albers equal area ----------------------------------------------------------


def _q(sin_phi):
    """Snyder's q for a Column or a float."""
    log = F.log if isinstance(sin_phi, Column) else math.log
    return (sin_phi / (1 - sin_phi * sin_phi * _E**2)
            - log((1 - sin_phi * _E) / (1 + sin_phi * _E)) / (2 * _E)) * (1 - _E**2)


def _albers_constants(p1, p2, p0):
    s1, s2, s0 = (math.sin(math.radians(p)) for p in (p1, p2, p0))
    m1, m2 = (math.sqrt((1 - s * s) / (1 - _E**2 * s * s)) for s in (s1, s2))
    n = (m1**2 - m2**2) / (_q(s2) - _q(s1))
    c = m1**2 + n * _q(s1)
    return n, c, WGS84_A * math.sqrt(c - n * _q(s0)) / n


def _albers_forward(lam, phi, p1, p2, p0, l0, fe, fn):
    n, c, rho0 = _albers_constants(p1, p2, p0)
    rho = F.sqrt(F.lit(c) - _q(F.sin(phi)) * n) * (WGS84_A / n)
    theta = (lam - math.radians(l0)) * n
    return rho * F.sin(theta) + fe, F.lit(rho0 + fn) - rho * F.cos(theta)


def _albers_inverse(x, y, p1, p2, p0, l0, fe, fn):
    n, c, rho0 = _albers_constants(p1, p2, p0)
    dx, dy = x - fe, F.lit(rho0 + fn) - y
    rho2 = dx * dx + dy * dy
    q = (F.lit(c) - rho2 * (n * n / WGS84_A**2)) / n
    beta = F.asin(q / _q(1.0))
    e2, e4, e6 = _E**2, _E**4, _E**6
    phi = (beta + F.sin(beta * 2) * (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040)
           + F.sin(beta * 4) * (23 * e4 / 360 + 251 * e6 / 3780) + F.sin(beta * 6) * (761 * e6 / 45360))
    return F.degrees(F.atan2(dx, dy) / n + math.radians(l0)), F.degrees(phi)


def reproject_point(x: float, y: float, source, target, spark) -> tuple[float, float]:
    """One coordinate pair, through the same expressions."""
    px, py = reproject(F.lit(float(x)), F.lit(float(y)), source, target)
    return tuple(spark.range(1).select(px, py).first())
