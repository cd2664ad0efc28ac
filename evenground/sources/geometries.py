"""Polygons from and to text and bytes: WKT, GeoJSON and WKB columns, feature files, and what is done with them on the way in."""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.operators.geometry.shapes import TYPE, bound, from_flat, normalized, rings, sound

_RING = r"\([^()]*\)"
_RINGS = rf"\(\s*{_RING}(?:\s*,\s*{_RING})*\s*\)"


def geometry_type(wkt: Column) -> Column:
    """The type that a WKT text names, in capitals (POLYGON, MULTIPOLYGON, POINT, ...)."""
    return F.upper(F.regexp_extract(wkt, r"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*([A-Za-z]+)", 1))


def from_wkt(wkt: Column, srid: int = 0) -> Column:
    """The polygons in a WKT text (also those in a collection) as a normalized geometry; other parts are left out, "SRID=n;" in front counts.

    NULL stays NULL; a text without polygons is a geometry of none; coordinates after the second of a point are not read.
    """
    own = lambda text: F.regexp_extract(text, r"^\s*SRID\s*=\s*(\d+)\s*;", 1)
    plain = lambda text: F.regexp_replace(text, rf"(?i)MULTI(?:LINESTRING|POINT)\s*[ZM]*\s*{_RINGS}", "")

    def point(text: Column) -> Column:
        return bound(F.split(F.trim(text), r"\s+"), lambda numbers: F.struct(*[F.get(numbers, F.lit(i)).try_cast("double").alias(k) for i, k in enumerate("xy")]))

    ring = lambda text: F.transform(F.split(text, ","), point)
    polygon = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), ring)
    polygons = lambda text: F.transform(F.regexp_extract_all(plain(text), F.lit(_RINGS), F.lit(0)), polygon)
    number = lambda text: F.coalesce(own(text).try_cast("int"), F.lit(srid))
    return bound(wkt, lambda text: F.when(text.isNotNull(), normalized(F.struct(number(text).alias("srid"), polygons(text).alias("polygons")).cast(TYPE))))


def to_wkt(geometry: Column) -> Column:
    """MULTIPOLYGON text of a geometry, shortest numbers; "MULTIPOLYGON EMPTY" for one of no polygons."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    text = lambda g: F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(g["polygons"], polygon), ", "), F.lit(")"))
    return bound(geometry, lambda g: F.when(F.size(g["polygons"]) == 0, F.lit("MULTIPOLYGON EMPTY")).when(g.isNotNull(), text(g)))


def from_geojson(text: Column, srid: int = 4326) -> Column:
    """The polygons of a GeoJSON geometry (Polygon, MultiPolygon, or in a GeometryCollection) as a normalized geometry."""

    def parts(one: Column) -> Column:
        kind = F.get_json_object(one, "$.type")
        single = F.array(F.from_json(one, "coordinates array<array<array<double>>>")["coordinates"])
        several = F.from_json(one, "coordinates array<array<array<array<double>>>>")["coordinates"]
        none = F.array().cast("array<array<array<array<double>>>>")
        return F.when(kind == "Polygon", single).when(kind == "MultiPolygon", several).otherwise(none)

    members = F.coalesce(F.from_json(text, "geometries array<string>")["geometries"], F.array().cast("array<string>"))
    found = F.concat(parts(text), F.flatten(F.transform(members, parts)))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    polygons = F.transform(found, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    return F.when(text.isNotNull(), normalized(F.struct(F.lit(srid).alias("srid"), polygons.alias("polygons")).cast(TYPE)))


def read_features(spark: SparkSession, path: str, srid: int = 4326, lines: bool = False) -> DataFrame:
    """``properties`` (map of texts) and ``geometry`` of the features in GeoJSON files, each file (or, with ``lines``, line) a FeatureCollection."""
    files = spark.read.schema("features array<struct<properties:map<string,string>,geometry:string>>").option("multiLine", not lines).json(path)
    rows = files.select(F.explode("features").alias("f"))
    return rows.select("f.properties", from_geojson(F.col("f.geometry"), srid).alias("geometry"))


def read_wkt(spark: SparkSession, path: str, column: str = "geometry", srid: int = 0) -> DataFrame:
    """CSV files with headers, all text, whose ``column`` holds WKT; it becomes ``geometry``."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("_geometry", from_wkt(F.col(f"`{column}`"), srid)).drop(column).withColumnRenamed("_geometry", "geometry")


def _wkb_polygons(data: bytes) -> list[list[list[float]]]:
    """Polygons of rings (x, y, x, y and so on) of a WKB geometry; other parts are left out."""
    found: list[list[list[float]]] = []

    def read(at: int, inside: bool = True) -> int:
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5 + (4 if code & 0x20000000 else 0)  # an EWKB number of the reference system
        size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        plain = code & 0xFFFF
        kind, size = plain % 1000, max(size, (2, 3, 3, 4)[plain // 1000 % 4])

        def points(at: int, n: int) -> tuple[list[float], int]:
            numbers = struct.unpack_from(f"{order}{n * size}d", data, at)
            return [v for i in range(0, n * size, size) for v in numbers[i : i + 2]], at + 8 * n * size

        if kind == 1:
            return points(at, 1)[1]
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        if kind == 2:
            return points(at, n)[1]
        if kind == 3:
            polygon = []
            for _ in range(n):
                (k,) = struct.unpack_from(f"{order}I", data, at)
                ring, at = points(at + 4, k)
                polygon.append(ring)
            found.append(polygon)
            return at
        for _ in range(n):
            at = read(at)
        return at

    read(0)
    return found


def from_wkb(wkb: Column, srid: int = 0) -> Column:
    """The polygons in WKB bytes as a normalized geometry; NULL stays NULL."""

    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if b is None else _wkb_polygons(bytes(b)) for b in part], dtype=object)

    read.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return normalized(from_flat(F.pandas_udf(read, "array<array<array<double>>>")(wkb), F.lit(srid)))


def keep_polygonal(df: DataFrame, quiet: bool = False) -> DataFrame:
    """The rows of ``df`` whose geometry has polygons; a warning tells if others are dropped (``quiet``: they are not looked for)."""
    has = F.coalesce(F.size(rings(F.col("geometry"))) > 0, F.lit(False))
    if not quiet and not df.where(~has).isEmpty():
        warnings.warn("rows without polygons are dropped", stacklevel=2)
    return df.where(has)


def make_sound(df: DataFrame) -> DataFrame:
    """``df`` with every geometry made sound: rings closed and turned the right way, rings of less than three corners or no area left out."""
    return df.withColumn("geometry", sound(F.col("geometry")))
