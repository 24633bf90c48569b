"""Geometry on the sphere as column expressions; angles are in degrees unless a name says otherwise."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from farpoint.config import RADIUS_M


def inf() -> Column:
    return F.lit(float("inf"))


def clip(x: Column, lo: float, hi: float) -> Column:
    """``x`` within the bounds; a null stays null."""
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


class Vec(NamedTuple):
    """A direction as three columns."""

    x: Column
    y: Column
    z: Column

    def __neg__(self) -> Vec:
        return Vec(-self.x, -self.y, -self.z)

    def dot(self, other: Vec) -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def distance2(self, other: Vec) -> Column:
        return (self.x - other.x) * (self.x - other.x) + (self.y - other.y) * (self.y - other.y) + (self.z - other.z) * (self.z - other.z)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def vec(prefix: str = "v") -> Vec:
    """The columns ``prefix``x, ``prefix``y, ``prefix``z."""
    return Vec(*(F.col(f"{prefix}{a}") for a in "xyz"))


def normalize_lon(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def unit(lon: Column, lat: Column) -> Vec:
    lon, lat = F.radians(lon), F.radians(lat)
    return Vec(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def lon_lat(v: Vec) -> tuple[Column, Column]:
    return F.degrees(F.atan2(v.y, v.x)), F.degrees(F.asin(clip(v.z, -1, 1)))


def separation(a: Vec, b: Vec) -> Column:
    return F.degrees(F.acos(clip(a.dot(b), -1, 1)))


def chord_length(impact_m: Column, radius: float = RADIUS_M) -> Column:
    """0 where the impact parameter is at or beyond the radius."""
    return F.when(impact_m >= radius, F.lit(0.0)).otherwise(2.0 * F.sqrt(F.lit(radius * radius) - impact_m * impact_m))


def impact_parameter(sep: Column, radius: float = RADIUS_M) -> Column:
    return radius * F.cos(F.radians(sep) / 2.0)


def chord_from_separation(sep: Column, radius: float = RADIUS_M) -> Column:
    return 2.0 * radius * F.sin(F.radians(sep) / 2.0)


def incidence(impact_m: Column, radius: float = RADIUS_M) -> Column:
    return F.degrees(F.asin(clip(impact_m / radius, 0, 1)))


def expected_ellipticity(sep: Column) -> Column:
    """1 / sin(sep / 2); infinite where the sine vanishes."""
    s = F.sin(F.radians(sep) / 2.0)
    return F.when(s > 1e-12, F.lit(1.0) / F.when(s > 1e-12, s)).when(s.isNotNull(), inf())


def incidence_from_ellipticity(e: Column) -> Column:
    return F.when(e <= 1.0, F.lit(0.0)).otherwise(F.degrees(F.acos(1.0 / F.greatest(e, F.lit(1.0)))))


def chord_from_ellipticity(e: Column, radius: float = RADIUS_M) -> Column:
    return F.when(e <= 0.0, F.lit(0.0)).otherwise(F.lit(2.0 * radius) / F.when(e > 0.0, e))


def separation_from_ellipticity(e: Column) -> Column:
    """180 below 1, else twice the arc sine of 1 / e."""
    return F.when(e < 1.0, F.lit(180.0)).otherwise(F.degrees(2.0 * F.asin(1.0 / F.greatest(e, F.lit(1.0)))))


def bearing_rad(a: Vec, b: Vec) -> Column:
    """From ``a`` to ``b``, clockwise from north."""
    lat1, lat2 = F.asin(clip(a.z, -1, 1)), F.asin(clip(b.z, -1, 1))
    turn = F.atan2(b.y, b.x) - F.atan2(a.y, a.x)
    return F.atan2(F.cos(lat2) * F.sin(turn), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(turn))


def pair_bearing(a: Vec, b: Vec) -> Column:
    """``bearing`` of unit vectors without angles: one arc tangent for a pair."""
    return F.degrees(F.atan2(a.x * b.y - a.y * b.x, b.z * (a.x * a.x + a.y * a.y) - a.z * (a.x * b.x + a.y * b.y)))


def bearing(a: Vec, b: Vec) -> Column:
    return F.degrees(bearing_rad(a, b))


def destination(v: Vec, bearing: Column, arc: Column) -> Vec:
    """Where one gets from ``v`` on the bearing after the arc, both in radians."""
    lat, lon = F.asin(clip(v.z, -1, 1)), F.atan2(v.y, v.x)
    s = clip(F.sin(lat) * F.cos(arc) + F.cos(lat) * F.sin(arc) * F.cos(bearing), -1, 1)
    to = lon + F.atan2(F.sin(bearing) * F.sin(arc) * F.cos(lat), F.cos(arc) - F.sin(lat) * s)
    c = F.sqrt(F.lit(1.0) - s * s)
    return Vec(c * F.cos(to), c * F.sin(to), s)


def bbox(lon: Column, lat: Column, span_m: Column, radius: float = RADIUS_M) -> Column:
    """struct(lon_min, lat_min, lon_max, lat_max), ``span_m`` wide; null next to a pole or across the date line."""
    c = F.cos(F.radians(lat))
    dlat, dlon = F.degrees(span_m / radius), F.degrees(span_m / (radius * F.when(c >= 1e-4, c)))
    lo, hi = lon - dlon / 2.0, lon + dlon / 2.0
    box = F.struct(lo.alias("lon_min"), F.greatest(lat - dlat / 2.0, F.lit(-90.0)).alias("lat_min"), hi.alias("lon_max"), F.least(lat + dlat / 2.0, F.lit(90.0)).alias("lat_max"))
    return F.when((c >= 1e-4) & (lo >= -180.0) & (hi <= 180.0), box)


def metres_per_pixel(box: Column, width: int, height: int, radius: float = RADIUS_M) -> tuple[Column, Column]:
    mid = F.radians((box["lat_min"] + box["lat_max"]) / 2.0)
    across = radius * F.cos(mid) * F.radians(box["lon_max"] - box["lon_min"])
    return F.abs(across) / width, F.abs(radius * F.radians(box["lat_max"] - box["lat_min"])) / height


def pixel_lon_lat(x: Column, y: Column, box: Column, width: int, height: int) -> tuple[Column, Column]:
    """Rows count downwards."""
    return box["lon_min"] + x / (width - 1) * (box["lon_max"] - box["lon_min"]), box["lat_max"] - y / (height - 1) * (box["lat_max"] - box["lat_min"])


def arc_points(a: Vec, b: Vec, n: int) -> Column:
    """Array of struct(i, lon, lat): ``n`` even steps on the great circle from ``a`` to ``b``; ``a`` throughout if they are one point."""
    w = F.acos(clip(a.dot(b), -1, 1))
    one = w < 1e-10
    safe = F.when(one, F.lit(1.0)).otherwise(w)

    def point(i: Column) -> Column:
        t = i / F.lit(float(max(n - 1, 1)))
        p, q = F.sin((1.0 - t) * safe) / F.sin(safe), F.sin(t * safe) / F.sin(safe)
        v = [F.when(one, x).otherwise(p * x + q * y) for x, y in zip(a, b, strict=True)]
        norm = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        lon, lat = lon_lat(Vec(*(x / norm for x in v)))
        return F.struct(i.alias("i"), lon.alias("lon"), lat.alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def cap_fraction(half_angle: Column) -> Column:
    return (1.0 - F.cos(F.radians(half_angle))) / 2.0


def orthographic(v: Vec, centre: Vec) -> tuple[Column, Column, Column]:
    """(right, up, depth) of ``v`` seen from above ``centre``."""
    lat, lon = F.asin(clip(centre.z, -1, 1)), F.atan2(centre.y, centre.x)
    right = -F.sin(lon) * v.x + F.cos(lon) * v.y
    up = -F.sin(lat) * F.cos(lon) * v.x - F.sin(lat) * F.sin(lon) * v.y + F.cos(lat) * v.z
    return right, up, v.dot(centre)


def cap_boundary(centre: Vec, half_angle: Column, n: int) -> Column:
    """Array of struct(i, lon, lat): ``n`` points around the cap, the first and last the same, from north clockwise."""

    def point(i: Column) -> Column:
        lon, lat = lon_lat(destination(centre, i * (2.0 * math.pi / max(n - 1, 1)), F.radians(half_angle)))
        return F.struct(i.alias("i"), lon.alias("lon"), lat.alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def grid_bin(x: Column, origin: float, size: float) -> Column:
    return F.floor((x - origin) / size)


def lon_in_range(lon: Column, lo: float, hi: float) -> Column:
    """Half open, across the date line where the bounds say so; bounds that are one meridian mean all."""
    a, b = (lo + 180.0) % 360.0 - 180.0, (hi + 180.0) % 360.0 - 180.0
    x = normalize_lon(lon)
    if abs(a - b) < 1e-12:
        return F.lit(True)
    return (x >= a) & (x < b) if a < b else (x >= a) | (x < b)
