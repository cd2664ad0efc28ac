"""Polygon columns: struct(srid, polygons -> rings -> points); ring 0 of a polygon is its outline, the others are holes."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EPSG numbers of longitude and latitude, and the radius in metres that areas on the sphere are taken with.
LONLATS, EARTH_RADIUS = (4326, 4269), 6371010.0
TYPE = "struct<srid:int,polygons:array<array<array<struct<x:double,y:double>>>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(points: list[tuple[Column, Column]], srid: int = 0) -> Column:
    """One polygon without holes from its corners in either direction; it is closed here."""
    ring = F.array(*[point(x, y) for x, y in [*points, points[0]]])
    return normalized(F.struct(F.lit(srid).alias("srid"), F.array(F.array(ring)).alias("polygons")))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column, srid: int = 0) -> Column:
    return polygon([(x0, y0), (x0, y1), (x1, y1), (x1, y0)], srid)


def circle(x: Column, y: Column, radius: Column | float, sides: int = 64, srid: int = 0) -> Column:
    """A regular polygon around a point."""
    r = radius if isinstance(radius, Column) else F.lit(radius)
    turn = F.transform(F.sequence(F.lit(0), F.lit(-sides), F.lit(-1)), lambda i: point(x + r * F.cos(i * (2 * pi / sides)), y + r * F.sin(i * (2 * pi / sides))))
    return normalized(F.struct(F.lit(srid).alias("srid"), F.array(F.array(turn)).alias("polygons")))


def lonlat(geometry: Column) -> Column:
    """Whether a geometry is of longitude and latitude; false for NULL."""
    return F.coalesce(geometry["srid"].isin(*LONLATS), F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: an expression that stands in a lambda is worked out anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ring_area(ring: Column) -> Column:
    """Positive for clockwise rings; relative to the first point, for precision far from the origin. ``ring`` is a column or a lambda's variable."""
    first = F.get(ring, F.lit(0))
    steps = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    part = lambda s: (s["q"]["x"] - s["p"]["x"]) * ((s["p"]["y"] - first["y"]) + (s["q"]["y"] - first["y"])) / 2
    return F.aggregate(steps, F.lit(0.0), lambda total, s: total + part(s))


def _closed(ring: Column) -> Column:
    """``ring`` is a column or a lambda's variable: it is read several times."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when(F.size(ring) == 0, ring).when(first == last, ring).otherwise(F.concat(ring, F.array(first)))


def normalized(geometry: Column) -> Column:
    """Rings closed, outlines clockwise, holes the other way."""

    def turned(ring: Column, hole: Column) -> Column:
        return F.when((_ring_area(ring) < 0) != hole, F.reverse(ring)).otherwise(ring)

    # rings are closed first, so that a ring's area reads them and closes none
    fixed = lambda g: F.transform(g["polygons"], lambda p: F.transform(F.transform(p, _closed), lambda ring, i: turned(ring, i > 0)))
    return bound(geometry, lambda g: F.when(g.isNotNull(), F.struct(g["srid"].alias("srid"), fixed(g).alias("polygons"))))


def rings(geometry: Column) -> Column:
    return F.flatten(geometry["polygons"])


def planar_area(geometry: Column) -> Column:
    """Area of a normalized geometry in the plane of its coordinates: holes count negative."""
    return F.aggregate(rings(geometry), F.lit(0.0), lambda total, ring: total + _ring_area(ring))


def _excess(ring: Column) -> Column:
    """Area between a ring's great-circle edges and the equator on the unit sphere, positive for clockwise rings; points are degrees."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    steps = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def part(s: Column) -> Column:
        turn = F.tan(F.radians(s["q"]["x"] - s["p"]["x"]) / 2)
        one, two = (F.tan(F.radians(s[k]["y"]) / 2) for k in "pq")
        return 2 * F.atan2(turn * (one + two), 1 + one * two)

    return F.aggregate(steps, F.lit(0.0), lambda total, s: total + part(s))


def area(geometry: Column) -> Column:
    """Area of a normalized geometry, holes negative: in the plane, or for longitude and latitude (EPSG 4326) in square metres on the sphere."""
    sphere = lambda g: F.aggregate(rings(g), F.lit(0.0), lambda total, ring: total + _excess(ring)) * EARTH_RADIUS**2
    return bound(geometry, lambda g: F.when(lonlat(g), sphere(g)).otherwise(planar_area(g)))


def from_flat(polygons: Column, srid: Column) -> Column:
    """A geometry of polygons whose rings are x, y, x, y and so on; NULL stays NULL."""
    corner = lambda ring: lambda i: F.struct(F.get(ring, 2 * i).alias("x"), F.get(ring, 2 * i + 1).alias("y"))
    places = lambda ring: F.slice(F.sequence(F.lit(0), F.greatest((F.size(ring) / 2).cast("int"), F.lit(1)) - 1), 1, (F.size(ring) / 2).cast("int"))
    made = F.transform(polygons, lambda p: F.transform(p, lambda ring: F.transform(places(ring), corner(ring))))
    return F.when(polygons.isNotNull(), F.struct(srid.cast("int").alias("srid"), made.alias("polygons"))).cast(TYPE)


def sound(geometry: Column) -> Column:
    """A geometry normalized, without rings of less than three corners or of no area; polygons without an outline go with their holes."""
    good = lambda r: (F.size(r) >= 4) & (_ring_area(r) != 0)
    outlined = lambda p: F.coalesce(bound(F.get(p, F.lit(0)), good), F.lit(False))
    kept = lambda g: F.transform(F.filter(g["polygons"], outlined), lambda p: F.filter(p, good))
    return bound(normalized(geometry), lambda g: F.when(g.isNotNull(), F.struct(g["srid"].alias("srid"), kept(g).alias("polygons"))))


def clip_convex(geometry: Column, mask: Column) -> Column:
    """What of a geometry lies in a convex mask (one ring, such as a box or a circle), ring by ring and edge by edge of the mask.

    A part that the mask cuts in several pieces stays one ring that runs along the mask's border between them; its area is right. A mask
    that isn't convex is an error: see overlay.clipped for any mask.
    """
    turn = lambda e, p: (e["x2"] - e["x1"]) * (p["y"] - e["y1"]) - (e["y2"] - e["y1"]) * (p["x"] - e["x1"])

    def cut(ring: Column, e: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        steps = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q"), turn(e, p).alias("a"), turn(e, q).alias("b")))

        def kept(s: Column) -> Column:
            a, b = s["a"], s["b"]
            share = a / F.when(a != b, a - b)
            met = F.struct((s["p"]["x"] + share * (s["q"]["x"] - s["p"]["x"])).alias("x"), (s["p"]["y"] + share * (s["q"]["y"] - s["p"]["y"])).alias("y"))
            own = F.array(s["q"])
            return F.when((a <= 0) & (b <= 0), own).when(a <= 0, F.array(met)).when(b <= 0, F.array(met, s["q"])).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        return bound(F.flatten(F.transform(steps, kept)), _closed)

    def cut_out(g: Column, m: Column) -> Column:
        """A geometry cut by a mask's edges (``es``), whose rings and corners (``rs``, ``corners``) tell whether it is convex."""
        ring = lambda r: F.aggregate(m["es"], r, cut)
        polygons = F.filter(F.transform(g["polygons"], lambda p: F.filter(F.transform(p, ring), lambda r: F.size(r) >= 4)), lambda p: F.size(p) > 0)
        convex = (m["rs"] == 1) & F.forall(m["es"], lambda e: F.forall(m["corners"], lambda p: turn(e, p) <= 1e-9 * (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * (F.abs(p["x"]) + F.abs(p["y"]))))
        told = F.struct(g["srid"].alias("srid"), polygons.alias("polygons"))
        return F.when(convex, told).otherwise(F.raise_error("the mask isn't convex").cast(TYPE))

    read = lambda g: F.struct(F.size(rings(g)).alias("rs"), edges(g).alias("es"), bound(F.flatten(rings(g)), lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))).alias("corners"))
    given = lambda g, m: F.when(g.isNotNull() & m.isNotNull(), bound(read(m), lambda told: cut_out(g, told)))
    return bound(geometry, lambda g: bound(mask, lambda m: given(g, m)))


def _extent(geometry: Column, axis: str) -> Column:
    return F.transform(F.flatten(rings(geometry)), lambda p: p[axis])


def bbox(geometry: Column) -> Column:
    """struct(x0, y0, x1, y1)"""
    extents = F.struct(_extent(geometry, "x").alias("xs"), _extent(geometry, "y").alias("ys"))
    return bound(extents, lambda e: F.struct(F.array_min(e["xs"]).alias("x0"), F.array_min(e["ys"]).alias("y0"), F.array_max(e["xs"]).alias("x1"), F.array_max(e["ys"]).alias("y1")))


def arc_box(geometry: Column) -> Column:
    """bbox of a geometry of longitude and latitude whose edges are great circles: these reach beyond their ends' latitudes."""

    def peaks(e: Column) -> Column:
        turned = e["x2"] < e["x1"]
        at = lambda name, other: F.when(turned, e[other]).otherwise(e[name])
        width = F.radians(F.abs(e["x2"] - e["x1"]))
        one, two = F.tan(F.radians(at("y1", "y2"))), F.tan(F.radians(at("y2", "y1")))
        side = (two - one * F.cos(width)) / F.when(F.sin(width) != 0, F.sin(width))
        top, low = F.atan2(side, one), F.atan2(-side, -one)
        most = F.degrees(F.atan(F.sqrt(one * one + side * side)))
        return F.array(F.when((top > 0) & (top < width), most), F.when((low > 0) & (low < width), -most))

    flat, ys = bbox(geometry), F.flatten(F.transform(edges(geometry), peaks))
    # least and greatest pass over NULL
    return F.struct(flat["x0"].alias("x0"), F.least(flat["y0"], F.array_min(ys)).alias("y0"), flat["x1"].alias("x1"), F.greatest(flat["y1"], F.array_max(ys)).alias("y1"))


def edges(geometry: Column) -> Column:
    """Directed edges: array of struct(x1, y1, x2, y2)."""
    n = lambda ring: F.greatest(F.size(ring) - 1, F.lit(0))
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return F.flatten(F.transform(rings(geometry), lambda ring: F.zip_with(F.slice(ring, 1, n(ring)), F.slice(ring, 2, n(ring)), edge)))


def _folds(ring: Column) -> Column:
    """Whether a ring has corners off the line through its first two: a bow tie's lobes may cancel, but aren't of no area."""
    p, q = F.get(ring, F.lit(0)), F.get(ring, F.lit(1))
    return F.exists(ring, lambda r: (q["x"] - p["x"]) * (r["y"] - p["y"]) != (q["y"] - p["y"]) * (r["x"] - p["x"]))


def has_sound_rings(geometry: Column) -> Column:
    """True for a geometry of at least one ring, every ring closed, of four points or more and of some area; whether rings cross is overlay.with_soundness's matter."""
    good = F.forall(rings(geometry), lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1)) & ((_ring_area(r) != 0) | _folds(r)))
    return F.coalesce(geometry.isNotNull() & (F.size(rings(geometry)) > 0) & good, F.lit(False))
