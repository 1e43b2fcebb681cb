"""Transverse Mercator in closed form, on the driver: longitude and latitude to metres and back."""

from __future__ import annotations

import math

from cellbasis.functions.refusals import CrsRefusal

#: Central meridian, latitude of origin, scale, false easting and northing; all on GRS 80 / WGS 84.
_PARAMETERS = {3763: (-8.133108333333334, 39.66825833333333, 1.0, 0.0, 0.0)}
_A, _F = 6378137.0, 1 / 298.257222101


def _parameters(epsg: int) -> tuple[float, float, float, float, float]:
    if epsg in _PARAMETERS:
        return _PARAMETERS[epsg]
    if 32601 <= epsg <= 32660 or 25828 <= epsg <= 25838:
        zone = epsg % 100
        return zone * 6.0 - 183.0, 0.0, 0.9996, 500000.0, 0.0
    if 32701 <= epsg <= 32760:
        return (epsg % 100) * 6.0 - 183.0, 0.0, 0.9996, 500000.0, 10000000.0
    raise CrsRefusal(f"no projection to EPSG:{epsg} is known here")


def _series() -> tuple[float, list[float], list[float]]:
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, alpha, beta


def _northing(xi: float, eta: float, alpha: list[float]) -> tuple[float, float]:
    a = xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    b = eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return a, b


def _conformal(lat: float) -> float:
    e = math.sqrt(_F * (2 - _F))
    return math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat)))


def to_metric(lon: float, lat: float, epsg: int) -> tuple[float, float]:
    """Easting and northing of a longitude and latitude in degrees."""
    lon0, lat0, k, fe, fn = _parameters(epsg)
    radius, alpha, _ = _series()
    origin, _ = _northing(math.atan(_conformal(math.radians(lat0))), 0.0, alpha)
    t, dl = _conformal(math.radians(lat)), math.radians(lon - lon0)
    xi, eta = _northing(math.atan2(t, math.cos(dl)), math.asinh(math.sin(dl) / math.hypot(t, math.cos(dl))), alpha)
    return fe + k * radius * eta, fn + k * radius * (xi - origin)


def to_degrees(x: float, y: float, epsg: int) -> tuple[float, float]:
    """Longitude and latitude of an easting and northing, by fixed-point iteration on the forward series."""
    lon0, lat0, k, fe, fn = _parameters(epsg)
    radius, alpha, beta = _series()
    origin, _ = _northing(math.atan(_conformal(math.radians(lat0))), 0.0, alpha)
    xi, eta = (y - fn) / (k * radius) + origin, (x - fe) / (k * radius)
    a = xi - sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(beta, 1))
    b = eta - sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(beta, 1))
    t = math.sin(a) / math.hypot(math.sinh(b), math.cos(a))
    e, s = math.sqrt(_F * (2 - _F)), t
    for _ in range(8):
        lat = math.atan(s)
        s = t + s - _conformal(lat)
    return lon0 + math.degrees(math.atan2(math.sinh(b), math.cos(a))), math.degrees(math.atan(s))


def degrees_box(box: tuple[float, float, float, float], epsg: int) -> tuple[float, float, float, float]:
    """The box in degrees around the four corners."""
    corners = [to_degrees(x, y, epsg) for x in (box[0], box[2]) for y in (box[1], box[3])]
    lons, lats = zip(*corners, strict=True)
    return min(lons), min(lats), max(lons), max(lats)
