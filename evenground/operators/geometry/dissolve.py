"""Union of the polygons of a group, whether they are neighbours, overlap, or share borders that only one has corners on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.operators.geometry.arrangement import bounded, polygons
from evenground.operators.geometry.shapes import edges


def dissolve(df: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the union of each group's ``geometry``; no ``by``: one row for all.

    Borders between members that are equal cancel in partial sums first. What is left is cut where it meets and loses the pieces that have
    the union on both sides, by cells and not by groups; a group gathers the outline alone, which is what its row of the result
    holds. Groups without edges have a NULL geometry. Geometries of longitude and latitude are united in the plane of their coordinates.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # tells NULLs from values, and is none itself
    parts = df.select(group.alias("_g"), F.explode(edges(F.col("geometry"))).alias("_e"))
    ends = F.expr("if((_e.x1, _e.y1) < (_e.x2, _e.y2), _e, struct(_e.x2 as x1, _e.y2 as y1, _e.x1 as x2, _e.y1 as y2))").alias("_k")
    way = F.expr("if((_e.x1, _e.y1) < (_e.x2, _e.y2), 1, -1)").alias("w")
    net = parts.select("_g", ends, way).groupBy("_g", "_k").agg(F.sum("w").alias("w")).where("w <> 0").select("_g", "_k.*", "w")
    outlines = bounded(net, ["_g"], lambda w: w != 0, ["w"])
    groups = df.groupBy(*by).agg(F.max("geometry.srid").alias("_srid")).withColumn("_g", group)
    shaped = polygons(outlines, ["_g"]).withColumnRenamed("geometry", "_shape")
    srid = F.col("_srid").cast("int").alias("srid")
    geometry = F.when(F.col("_shape").isNotNull(), F.struct(srid, F.col("_shape.polygons").alias("polygons")))
    return groups.join(shaped, "_g", "left").select(*by, geometry.alias("geometry"))
