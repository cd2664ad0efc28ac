"""Reference systems as column arithmetic: conformal and equal-area conics, transverse Mercator, and longitude and latitude."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import atan2, atanh, cos, log, pi, radians, sin, sinh, sqrt, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.operators.geometry.shapes import LONLATS

#: Half axis and flattening of GRS 80.
GRS80 = (6378137.0, 1 / 298.257222101)


def _repeated(step: Callable[[Column], Column], start: Column, times: int) -> Column:
    """``step`` applied ``times`` times from ``start``, as a loop over a short array: the expression doesn't grow with the times."""
    return F.aggregate(F.array_repeat(F.lit(0), times), start, lambda value, _: step(value))


@dataclass(frozen=True)
class Conic:
    """Lambert's conformal conic with two standard parallels."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    east0: float = 0.0
    north0: float = 0.0
    ellipsoid: tuple[float, float] = GRS80

    @property
    def _e(self) -> float:
        return sqrt(self.ellipsoid[1] * (2 - self.ellipsoid[1]))

    def _constants(self) -> tuple[float, float, float]:
        e = self._e
        t = lambda d: tan(pi / 4 - radians(d) / 2) / ((1 - e * sin(radians(d))) / (1 + e * sin(radians(d)))) ** (e / 2)
        m = lambda d: cos(radians(d)) / sqrt(1 - (e * sin(radians(d))) ** 2)
        n = (log(m(self.lat1)) - log(m(self.lat2))) / (log(t(self.lat1)) - log(t(self.lat2)))
        f = m(self.lat1) / (n * t(self.lat1) ** n) * self.ellipsoid[0]
        return n, f, f * t(self.lat0) ** n

    def project(self, p: Column) -> Column:
        (n, f, rho0), e = self._constants(), self._e
        lat, s = F.radians(p["y"]), F.sin(F.radians(p["y"]))
        t = F.tan(F.lit(pi / 4) - lat / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
        rho, theta = f * F.pow(t, F.lit(n)), n * F.radians(p["x"] - self.lon0)
        return F.struct((self.east0 + rho * F.sin(theta)).alias("x"), (self.north0 + rho0 - rho * F.cos(theta)).alias("y"))

    def unproject(self, p: Column) -> Column:
        (n, f, rho0), e = self._constants(), self._e
        x, y = p["x"] - self.east0, F.lit(rho0) - (p["y"] - self.north0)
        t = F.pow(F.sqrt(x * x + y * y) / f, F.lit(1 / n))
        nearer = lambda lat: F.lit(pi / 2) - 2 * F.atan(t * F.pow((1 - e * F.sin(lat)) / (1 + e * F.sin(lat)), F.lit(e / 2)))
        lat = _repeated(nearer, F.lit(pi / 2) - 2 * F.atan(t), 6)
        return F.struct((F.degrees(F.atan2(x, y) / n) + self.lon0).alias("x"), F.degrees(lat).alias("y"))


@dataclass(frozen=True)
class Albers:
    """Albers' equal-area conic."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    east0: float = 0.0
    north0: float = 0.0
    ellipsoid: tuple[float, float] = GRS80

    @property
    def _e(self) -> float:
        return sqrt(self.ellipsoid[1] * (2 - self.ellipsoid[1]))

    def _q(self, s: float) -> float:
        e = self._e
        return (1 - e * e) * (s / (1 - (e * s) ** 2) + atanh(e * s) / e)

    def _constants(self) -> tuple[float, float, float]:
        e = self._e
        m = lambda d: cos(radians(d)) / sqrt(1 - (e * sin(radians(d))) ** 2)
        q = lambda d: self._q(sin(radians(d)))
        n = (m(self.lat1) ** 2 - m(self.lat2) ** 2) / (q(self.lat2) - q(self.lat1)) if self.lat1 != self.lat2 else sin(radians(self.lat1))
        c = m(self.lat1) ** 2 + n * q(self.lat1)
        return n, c, self.ellipsoid[0] * sqrt(c - n * q(self.lat0)) / n

    def project(self, p: Column) -> Column:
        (n, c, rho0), e = self._constants(), self._e
        s = F.sin(F.radians(p["y"]))
        q = (1 - e * e) * (s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))
        rho, theta = self.ellipsoid[0] * F.sqrt(c - n * q) / n, n * F.radians(p["x"] - self.lon0)
        return F.struct((self.east0 + rho * F.sin(theta)).alias("x"), (self.north0 + rho0 - rho * F.cos(theta)).alias("y"))

    def unproject(self, p: Column) -> Column:
        (n, c, rho0), e = self._constants(), self._e
        x, y = p["x"] - self.east0, rho0 - (p["y"] - self.north0)
        q = (c - (x * x + y * y) * (n / self.ellipsoid[0]) ** 2) / n

        def nearer(lat: Column) -> Column:
            s = F.sin(lat)
            w = 1 - e * e * s * s
            return lat + w * w / (2 * F.cos(lat)) * (q / (1 - e * e) - s / w - F.log((1 + e * s) / (1 - e * s)) / (2 * e))

        lat = _repeated(nearer, F.asin(q / 2), 5)
        sign = F.lit(1.0 if n > 0 else -1.0)
        return F.struct((F.degrees(F.atan2(sign * x, sign * y) / n) + self.lon0).alias("x"), F.degrees(lat).alias("y"))


@dataclass(frozen=True)
class TransverseMercator:
    """Transverse Mercator by series in the third flattening, to well under a millimetre within some tens of degrees."""

    lon0: float
    lat0: float = 0.0
    scale: float = 1.0
    east0: float = 0.0
    north0: float = 0.0
    ellipsoid: tuple[float, float] = GRS80

    @property
    def _e(self) -> float:
        return sqrt(self.ellipsoid[1] * (2 - self.ellipsoid[1]))

    def _series(self) -> tuple[float, list[float], list[float]]:
        """(radius of the meridian's rectified circle, terms forwards, terms backwards)"""
        n = self.ellipsoid[1] / (2 - self.ellipsoid[1])
        radius = self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # Coefficients of the two series, by powers of the third flattening.
        forward = [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ]
        back = [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ]
        return radius * self.scale, forward, back

    def _origin(self) -> float:
        """Distance of the latitude of origin from the equator on the rectified circle."""
        s, (_, forward, _) = sin(radians(self.lat0)), self._series()
        at = atan2(sinh(atanh(s) - self._e * atanh(self._e * s)), 1.0)
        return at + sum(c * sin(2 * k * at) for k, c in enumerate(forward, 1))

    def project(self, p: Column) -> Column:
        e, (radius, forward, _) = self._e, self._series()
        s, turn = F.sin(F.radians(p["y"])), F.radians(p["x"] - self.lon0)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        along, across = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
        north = reduce(lambda total, kc: total + kc[1] * F.sin(2 * kc[0] * along) * F.cosh(2 * kc[0] * across), enumerate(forward, 1), along)
        east = reduce(lambda total, kc: total + kc[1] * F.cos(2 * kc[0] * along) * F.sinh(2 * kc[0] * across), enumerate(forward, 1), across)
        return F.struct((self.east0 + radius * east).alias("x"), (self.north0 + radius * (north - self._origin())).alias("y"))

    def unproject(self, p: Column) -> Column:
        e, (radius, _, back) = self._e, self._series()
        north, east = (p["y"] - self.north0) / radius + self._origin(), (p["x"] - self.east0) / radius
        along = reduce(lambda total, kc: total - kc[1] * F.sin(2 * kc[0] * north) * F.cosh(2 * kc[0] * east), enumerate(back, 1), north)
        across = reduce(lambda total, kc: total - kc[1] * F.cos(2 * kc[0] * north) * F.sinh(2 * kc[0] * east), enumerate(back, 1), east)
        conformal = F.asin(F.sin(along) / F.cosh(across))
        # latitude of a conformal latitude
        lat = _repeated(lambda lat: F.asin(F.tanh(F.atanh(F.sin(conformal)) + e * F.atanh(e * F.sin(lat)))), conformal, 6)
        return F.struct((F.degrees(F.atan2(F.sinh(across), F.cos(along))) + self.lon0).alias("x"), F.degrees(lat).alias("y"))


Projection = Conic | Albers | TransverseMercator

# Parameters of reference systems by EPSG code. Longitude and latitude of either datum are taken for one another.
_STATISTICAL = Conic(49, 77, 63.390675, -91.86666666666666, 6200000, 3000000)
PROJECTIONS: dict[int, Projection] = {
    3347: _STATISTICAL,
    3348: _STATISTICAL,
    3005: Albers(50, 58.5, 45, -126, 1000000, 0),
    5070: Albers(29.5, 45.5, 23, -96),
    **{first + zone: TransverseMercator(6 * zone - 183, 0, 0.9996, 500000) for first in (26900, 32600) for zone in range(1, 61) if first == 32600 or zone <= 23},
}


def _projection(srid: int) -> Projection:
    if srid not in PROJECTIONS:
        raise ValueError(f"reference system {srid} isn't known")
    return PROJECTIONS[srid]


def project_point(p: Column, srid: int) -> Column:
    """A point of longitude x and latitude y in degrees to plane metres."""
    return _projection(srid).project(p)


def unproject_point(p: Column, srid: int) -> Column:
    """The inverse of project_point (to about 1e-9 degrees)."""
    return _projection(srid).unproject(p)


def _every_point(geometry: Column, srid: int, moved: Callable[[Column], Column]) -> Column:
    polygons = F.transform(geometry["polygons"], lambda poly: F.transform(poly, lambda ring: F.transform(ring, moved)))
    return F.when(geometry.isNotNull(), F.struct(F.lit(srid).alias("srid"), polygons.alias("polygons")))


def transform(geometry: Column, source: int, target: int) -> Column:
    """A geometry column from one known reference system to another; equal ones pass."""
    if source == target:
        return geometry
    for srid in (source, target):
        if srid not in LONLATS and srid not in PROJECTIONS:
            raise ValueError(f"no way from {source} to {target}")

    def moved(p: Column) -> Column:
        q = p if source in LONLATS else unproject_point(p, source)
        return q if target in LONLATS else project_point(q, target)

    return _every_point(geometry, target, moved)


def systems(df: DataFrame) -> list[int]:
    """The reference systems of the geometries of ``df``, rising; 0 and NULL are none."""
    srid = F.coalesce(F.col("geometry.srid"), F.lit(0)).alias("srid")
    return sorted(r["srid"] for r in df.where(F.col("geometry").isNotNull()).select(srid).distinct().collect())


def to_system(df: DataFrame, target: int, found: list[int] | None = None) -> DataFrame:
    """``df`` with its geometries, of whatever known systems, in the system ``target``. ``found``: what systems(df) gives."""
    found = systems(df) if found is None else found
    ways = [(s, transform(F.col("geometry"), s, target)) for s in found if s != target]
    if not ways:
        return df
    moved = reduce(lambda chain, way: chain.when(F.col("geometry.srid") == way[0], way[1]), ways[1:], F.when(F.col("geometry.srid") == ways[0][0], ways[0][1]))
    return df.withColumn("geometry", moved.otherwise(F.col("geometry")))


def reconciled(*tables: DataFrame) -> list[DataFrame]:
    """The tables' geometries in one reference system: the smallest number that the first table with any has.

    An error where some geometries have a system and others have none, or systems that have no way to each other.
    """
    found = [systems(df) for df in tables]
    target = next((f[0] for f in found if f), 0)
    if len({s for f in found for s in f}) > 1 and any(0 in f for f in found):
        raise ValueError("some geometries have no reference system")
    return [to_system(df, target, f) for df, f in zip(tables, found, strict=True)]
