"""Map projection and line centroids as column expressions.

Lambert conformal conic with two standard parallels (EPSG method 9802) on an
ellipsoid, forward and inverse; the defaults are the projected system the
reference measures distances in (metres). Line centroids are length-weighted
segment midpoints, computed with higher-order array functions per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


DEG = math.pi / 180.0


@dataclass(frozen=True)
class LCC:
    # GRS80 ellipsoid and the conic parameters of the
    # reference's projected coordinate system (EPSG:3559).
    a: float = 6378137.0
    inv_f: float = 298.257222101
    lat1: float = 38.3
    lat2: float = 39.45
    lat0: float = 37.0 + 40.0 / 60.0
    lon0: float = -77.0
    false_e: float = 400000.0
    false_n: float = 0.0

    @property
    def e(self) -> float:
        f = 1.0 / self.inv_f
        return math.sqrt(2 * f - f * f)

    def _m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - self.e ** 2 * math.sin(phi) ** 2)

    def _t(self, phi: float) -> float:
        e = self.e
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)

    @property
    def constants(self) -> dict:
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        m1, m2 = self._m(p1), self._m(p2)
        t1, t2, t0 = self._t(p1), self._t(p2), self._t(p0)
        n = (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2))
        big_f = m1 / (n * t1 ** n)
        return {"n": n, "aF": self.a * big_f, "r0": self.a * big_f * t0 ** n, "e": self.e}


def lcc_forward(lon: Column, lat: Column, p: LCC = LCC()) -> tuple[Column, Column]:
    """(easting, northing) in metres from longitude / latitude in degrees."""
    c = p.constants
    e, n = c["e"], c["n"]
    phi = lat * F.lit(DEG)
    es = F.lit(e) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((F.lit(1.0) - es) / (F.lit(1.0) + es), F.lit(e / 2))
    r = F.lit(c["aF"]) * F.pow(t, F.lit(n))
    theta = F.lit(n) * ((lon - F.lit(p.lon0)) * F.lit(DEG))
    return F.lit(p.false_e) + r * F.sin(theta), F.lit(p.false_n + c["r0"]) - r * F.cos(theta)


def lcc_inverse(x: Column, y: Column, p: LCC = LCC(), iterations: int = 5) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees from easting / northing (fixed-point
    iteration for the latitude)."""
    c = p.constants
    e, n = c["e"], c["n"]
    dx = x - F.lit(p.false_e)
    dy = F.lit(c["r0"]) - (y - F.lit(p.false_n))
    r = F.sqrt(dx * dx + dy * dy) * F.lit(math.copysign(1.0, n))
    t = F.pow(r / F.lit(c["aF"]), F.lit(1.0 / n))
    theta = F.atan2(dx, dy)
    lon = F.degrees(theta / F.lit(n)) + F.lit(p.lon0)
    phi = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(t)
    for _ in range(iterations):
        es = F.lit(e) * F.sin(phi)
        phi = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(t * F.pow((F.lit(1.0) - es) / (F.lit(1.0) + es), F.lit(e / 2)))
    return lon, F.degrees(phi)


def project_line(coords: Column, p: LCC = LCC()) -> Column:
    """ARRAY<ARRAY<lon, lat>> -> ARRAY<ARRAY<x, y>> (per vertex, no explode)."""
    return F.transform(coords, lambda v: F.array(*lcc_forward(v[0], v[1], p)))


def unproject_line(coords: Column, p: LCC = LCC()) -> Column:
    return F.transform(coords, lambda v: F.array(*lcc_inverse(v[0], v[1], p)))


def line_centroid(coords: Column) -> Column:
    """Length-weighted centroid of a polyline ARRAY<ARRAY<x, y>> as a struct
    (cx, cy); a zero-length line falls back to its first vertex."""
    head = F.slice(coords, 1, F.size(coords) - 1)
    tail = F.slice(coords, 2, F.size(coords) - 1)
    segs = F.zip_with(head, tail, lambda a, b: F.struct(
        F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1])).alias("l"),
        ((a[0] + b[0]) / 2).alias("mx"), ((a[1] + b[1]) / 2).alias("my")))
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
    acc = F.aggregate(segs, zero, lambda s, g: F.struct(
        (s["l"] + g["l"]).alias("l"), (s["sx"] + g["l"] * g["mx"]).alias("sx"),
        (s["sy"] + g["l"] * g["my"]).alias("sy")))
    first = F.element_at(coords, 1)
    return F.struct(
        F.when(acc["l"] > 0, acc["sx"] / acc["l"]).otherwise(first[0]).alias("cx"),
        F.when(acc["l"] > 0, acc["sy"] / acc["l"]).otherwise(first[1]).alias("cy"))
