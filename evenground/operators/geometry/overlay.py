"""Tables of polygons with crossings found and repaired, or clipped to masks of any shape, by arrangements of their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.operators.geometry.arrangement import borders, bounded, covered, exploded, lattice_step, meetings, pieces, polygons, snapped, split
from evenground.operators.geometry.crs import reconciled
from evenground.operators.geometry.dissolve import dissolve
from evenground.operators.geometry.shapes import TYPE, has_sound_rings
from evenground.runtime import lean, release, stored

_ENDS = ["x1", "y1", "x2", "y2"]


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` stored with a number per row, so that the numbers stay."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()))


def _with_shapes(numbered: DataFrame, outlines: DataFrame) -> DataFrame:
    """The rows with the geometries that their borders bound; a geometry without any has no polygons, NULL stays NULL."""
    shaped = polygons(outlines, ["_row"]).select("_row", F.col("geometry.polygons").alias("_polygons"))
    none = F.lit([]).cast("array<array<array<struct<x:double,y:double>>>>")
    made: Column = F.struct(F.col("geometry.srid").alias("srid"), F.coalesce("_polygons", none).alias("polygons")).cast(TYPE)
    joined = numbered.join(shaped, "_row", "left")
    return joined.withColumn("geometry", F.when(F.col("geometry").isNotNull(), made)).drop("_row", "_polygons")


def repaired(df: DataFrame) -> DataFrame:
    """``df`` with every ``geometry`` made valid: what an odd number of its rings surround, whichever way they run and cross.

    A bow tie becomes its two lobes; what two rings cover both, or a ring runs around twice, is outside; spikes and rings of no area
    go. Geometries that need no repair keep their shape; the order of their corners and rings may change.
    """
    numbered = _numbered(df)
    net = exploded(numbered, "_row").withColumn("w", F.lit(1))
    return _with_shapes(numbered, bounded(net, ["_row"], lambda w: F.pmod(w, F.lit(2)) == 1, ["w"]))


def with_soundness(df: DataFrame, name: str = "sound") -> DataFrame:
    """``df`` with a boolean column: whether the rings of ``geometry`` are closed, of some area, and don't cross or run along each other."""
    numbered = _numbered(df)
    net = exploded(numbered, "_row")
    step = lattice_step(net)
    placed = stored(snapped(net, step).withColumn("id", F.monotonically_increasing_id()))
    cuts, _ = meetings(placed, None, step, ("_row",), lambda es, fs: (F.size(es) > 0) & (F.size(fs) > 0) | (F.size(es) > 1) | (F.size(fs) > 1))
    ends = F.array_sort(F.array(F.struct(F.col("x1"), F.col("y1")), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))))
    twice = placed.groupBy("_row", ends.alias("_ends")).count().where("count > 1").select("_row")
    crossed = placed.join(cuts, "id", "left_semi").select("_row").union(twice).distinct().withColumn("_crossed", F.lit(True))
    joined = numbered.join(crossed, "_row", "left")
    return joined.withColumn(name, has_sound_rings(F.col("geometry")) & F.col("_crossed").isNull()).drop("_row", "_crossed")


def clipped(df: DataFrame, masks: DataFrame) -> DataFrame:
    """``df`` with every ``geometry`` cut to what of it lies in the union of ``masks``' geometries, of any shape, with holes and parts.

    Geometries are valid ones (see ``repaired``). Pieces stay apart; a geometry that has nothing in a mask has no polygons; NULL stays NULL;
    masks of another reference system are moved to the geometries'. Borders of a mask meet the geometries near them only: whether the
    others lie in it is read off the borders above them.
    """
    df, masks = reconciled(df, masks)
    numbered = _numbered(df)
    own = exploded(numbered, "_row").withColumn("w", F.lit(1))
    mask = stored(exploded(dissolve(masks, [])).withColumn("m", F.lit(1)))
    step = lattice_step(own, mask)
    own, mask = (stored(snapped(t, step).withColumn("id", F.monotonically_increasing_id())) for t in (own, mask))
    _, mask_cuts = meetings(own, mask, step, ())
    outer = stored(pieces(split(mask, mask_cuts, ["m"]), [], ["m"]).withColumn("id", F.monotonically_increasing_id()))
    # a border along the mask's is cut wherever others cut the mask there, so that equal pieces are equal
    own_cuts, _ = meetings(own, outer.select("id", *_ENDS), step, ())
    inner = stored(pieces(split(own, own_cuts, ["_row", "w"]), ["_row"], ["w"]))
    release(own, mask)
    # a valid geometry lies on one side of its borders: below those that run right, above the others
    above = lambda w: F.when(F.col(w) < 0, 1).otherwise(0).alias(f"{w}_up")
    both = lambda w, m: (w != 0) & (m != 0)
    over = covered(inner, outer, ["_row", *_ENDS], [], ["m"])
    with_mask = inner.join(over, ["_row", *_ENDS], "left").join(lean(outer.select(*_ENDS, "m"), outer), _ENDS, "left").na.fill(0, ["m", "m_up"])
    one = borders(with_mask.select("_row", *_ENDS, "w", "m", "m_up", above("w")), ["_row"], both, ["w", "m"])
    within = covered(outer, inner, _ENDS, ["_row"], ["w"]).where("w_up <> 0").join(inner.select("_row", *_ENDS), ["_row", *_ENDS], "left_anti")
    cut = within.join(lean(outer, outer), _ENDS).select("_row", *_ENDS, F.lit(0).alias("w"), "m", "w_up", above("m"))
    return _with_shapes(numbered, one.unionByName(borders(cut, ["_row"], both, ["w", "m"])))
