"""Geography as column arithmetic: distances, boxes, polygons and the UTM projection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere; null if any coordinate is."""
    a, b = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = u * u + F.cos(a) * F.cos(b) * v * v
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def in_bbox(lon: Column, lat: Column, box: Sequence[float]) -> Column:
    """Inside or on (min_lon, min_lat, max_lon, max_lat); null if a coordinate is, which a filter takes as outside."""
    x0, y0, x1, y1 = map(float, box)
    return (lon >= x0) & (lon <= x1) & (lat >= y0) & (lat <= y1)


def in_polygon(lon: Column, lat: Column, ring: Sequence[Sequence[float]]) -> Column:
    """Even-odd rule for a simple ring of (lon, lat); its box goes first, so that it can be pushed down."""
    points = [(float(x), float(y)) for x, y in ring]
    if len(points) > 1 and points[0] == points[-1]:
        points = points[:-1]
    box = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points))
    crossings = []
    for (x1, y1), (x2, y2) in zip(points, [points[-1], *points[:-1]], strict=True):
        if y1 == y2:
            continue
        edge = (x2 - x1) * (lat - y1) / ((y2 - y1) or 1e-12) + x1
        crossings.append((((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < edge)).cast("int"))
    parity = reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1
    return in_bbox(lon, lat, box) & parity


class TransverseMercator:
    """Kruger series to the fourth order on GRS80; defaults are UTM zone 19 south."""

    def __init__(self, central_meridian: float = -69.0, false_easting: float = 500_000.0, false_northing: float = 10_000_000.0, scale: float = 0.9996, a: float = 6_378_137.0, inverse_flattening: float = 298.257222101):
        f = 1 / inverse_flattening
        n = f / (2 - f)
        self.lon0, self.e0, self.n0 = math.radians(central_meridian), false_easting, false_northing
        self.radius = scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.n = n
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        self.delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)

    def to_lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees of easting and northing in metres."""
        xi, eta = (y - self.n0) / self.radius, (x - self.e0) / self.radius
        xi1 = reduce(lambda s, k: s - F.lit(self.beta[k - 1]) * F.sin(2 * k * xi) * F.cosh(2 * k * eta), range(1, 5), xi)
        eta1 = reduce(lambda s, k: s - F.lit(self.beta[k - 1]) * F.cos(2 * k * xi) * F.sinh(2 * k * eta), range(1, 5), eta)
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        lat = reduce(lambda s, k: s + F.lit(self.delta[k - 1]) * F.sin(2 * k * chi), range(1, 5), chi)
        lon = F.atan2(F.sinh(eta1), F.cos(xi1)) + F.lit(self.lon0)
        return F.degrees(lon), F.degrees(lat)

    def to_xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing in metres of degrees."""
        phi, lam = F.radians(lat), F.radians(lon) - F.lit(self.lon0)
        e = 2 * math.sqrt(self.n) / (1 + self.n)
        t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        x = reduce(lambda s, k: s + F.lit(self.alpha[k - 1]) * F.cos(2 * k * xi) * F.sinh(2 * k * eta), range(1, 5), eta)
        y = reduce(lambda s, k: s + F.lit(self.alpha[k - 1]) * F.sin(2 * k * xi) * F.cosh(2 * k * eta), range(1, 5), xi)
        return x * F.lit(self.radius) + self.e0, y * F.lit(self.radius) + self.n0
