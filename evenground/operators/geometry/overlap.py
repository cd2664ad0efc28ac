"""Overlap of two polygon tables: candidate pairs by cells of size classes, intersection areas in closed form.

Every directed edge of a normalized polygon bounds a signed trapezoid down to a common baseline; a polygon is the signed sum of its
edges' trapezoids. The area of an intersection is therefore the sum, over pairs of edges, of the product of their signs
times the integral of the lower edge over the shared stretch of x. On longitude and latitude edges are great circles, heights are sines of
latitudes (equal areas) and the baseline is the equator, so the same sum is the area on the sphere.

Pairs of polygons with few edges sum over their edges where they are. The edges of larger ones are cut at the borders of slabs, about
one for four edges, and meet in an equi-join on pair and slab: an edge meets those that stand over the same stretch, not all. Slabs
cut the axis along which fewer edges stand over each other. The sum per pair is partial in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.operators.geometry.shapes import EARTH_RADIUS, arc_box, bbox, edges, lonlat, rings
from evenground.runtime import FEW_ROWS, materialize, stored

#: Pairs of edges that a pair of polygons compares without slabs, and edges of both that a slab is made for.
DIRECT_PAIRS, SLAB_EDGES = 1024, 4


def boxes(df: DataFrame, key: str, *more: str | Column) -> DataFrame:
    """``key``, ``box`` and ``more`` of the rows of ``df`` whose geometry has corners; great circles may reach beyond their corners."""
    box = F.when(lonlat(F.col("geometry")), arc_box(F.col("geometry"))).otherwise(bbox(F.col("geometry")))
    return df.select(F.col(key), box.alias("box"), *more).where("box.x0 is not null")


def candidate_pairs(a: DataFrame, b: DataFrame, cell: float | None = None, by: tuple[str, ...] = (), once: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of rows of ``a`` and ``b`` (from ``boxes``) whose boxes meet, each once: both sides' columns, box as ``ba`` and ``bb``.

    ``by``: columns of both, not NULL, that are equal in a pair. ``once``: both tables hold the same rows, numbered in these columns of
    ``a`` and ``b``; of two different rows only one of both orders comes, and no row with itself.

    Boxes have size classes, powers of two (``cell``: none under this size). A box lies in at most four square cells of its class's
    side, and in as few of any larger class that the other table has. Two boxes meet in the cells of the larger of their classes: once
    ``a``'s own cells are joined with those of ``b``'s boxes that are no larger, once the other way round. So a large box among
    many small ones makes few rows, and small ones meet in small cells only. Of several common cells the one that holds the
    lower left corner of what the boxes share counts. Rows of both tables with a true ``few``, which all rows of their ``by`` have in common,
    are one cell: they are few enough to meet all of each other.
    """
    flagged = "few" in a.columns

    def classed(df: DataFrame, box: str) -> DataFrame:
        side = F.greatest(F.expr("box.x1 - box.x0"), F.expr("box.y1 - box.y0"), F.lit(cell or 0.0))
        sized = df.withColumn("size", F.when(side > 0, F.ceil(F.log2(side)).cast("int"))).withColumnRenamed("box", box)
        return sized.withColumn("size", F.when(~F.col("few"), F.col("size"))) if flagged else sized

    left, right = classed(a, "ba"), classed(b, "bb")
    counts = [{r[0]: r[1] for r in d.groupBy("size").count().collect()} for d in ((left,) if once else (left, right))] * (2 if once else 1)  # powers of two: few
    classes = [sorted(k for k in c if k is not None) for c in counts]
    few = [sum(c.values()) <= FEW_ROWS for c in counts]
    least = min([*classes[0], *classes[1]], default=0)
    left, right = (d.withColumn("size", F.coalesce("size", F.lit(least))) for d in (left, right))

    def dealt(df: DataFrame, box: str, larger: list[int] | None, same: bool = False) -> DataFrame:
        """``df`` once per cell: of its own class, or of the classes ``larger`` that are (or, with ``same``, may be) above it."""
        if larger is None:
            at = df.withColumn("class", F.col("size"))
        else:
            known = F.array(*[F.lit(k) for k in larger]) if larger else F.array().cast("array<int>")
            above = F.filter(known, lambda k: (k >= F.col("size")) if same else (k > F.col("size")))
            if flagged:
                above = F.when(F.col("few"), F.array(F.col("size")) if same else F.array().cast("array<int>")).otherwise(above)
            at = df.withColumn("class", F.explode(above))
        place = lambda at: F.when(F.col("few"), 0).otherwise(at) if flagged else at
        cells = {c: F.sequence(*[place(F.floor(F.col(f"{box}.{c}{i}") / F.pow(F.lit(2.0), F.col("class")))) for i in (0, 1)]) for c in "xy"}
        if once and same:
            at = at.withColumn("below", F.col("size") < F.col("class"))
        return at.withColumn("cx", F.explode(cells["x"])).withColumn("cy", F.explode(cells["y"])).drop("size")

    def joined(one: DataFrame, two: DataFrame) -> DataFrame:
        """Few boxes go to where the others are, however these crowd in a cell; many are never gathered."""
        sides = [F.broadcast(d) if few[i] and (i or not few[1]) else d if few[i] else d.hint("merge") for i, d in enumerate((one, two))]
        return sides[0].join(sides[1].drop("few"), [*by, "class", "cx", "cy"])

    both = joined(dealt(left, "ba", None), dealt(right, "bb", sorted({*classes[0], least}), True))
    if once:  # boxes of one class: by their numbers
        both = both.where(F.col("below") | (F.col(once[0]) < F.col(once[1]))).drop("below")
    else:
        both = both.unionByName(joined(dealt(left, "ba", sorted({*classes[1], least})), dealt(right, "bb", None)))
    share = [(F.col(f"ba.{k}0") <= F.col(f"bb.{k}1")) & (F.col(f"bb.{k}0") <= F.col(f"ba.{k}1")) for k in "xy"]
    own = [F.floor(F.greatest(F.col(f"ba.{k}0"), F.col(f"bb.{k}0")) / F.pow(F.lit(2.0), F.col("class"))) == F.col(f"c{k}") for k in "xy"]
    own = (own[0] & own[1]) | F.col("few") if flagged else own[0] & own[1]
    return both.where(share[0] & share[1] & own).drop("class", "cx", "cy", "few")


def _height(edge: str, x: str) -> Column:
    """Height of an edge over x: y less the baseline, or on the sphere the tangent of the great circle's latitude."""
    share = f"({x} - {edge}.x1) / nullif({edge}.x2 - {edge}.x1, 0d)"
    arc = f"(tan(radians({edge}.y1)) * sin(radians({edge}.x2 - {x})) + tan(radians({edge}.y2)) * sin(radians({x} - {edge}.x1))) / nullif(sin(radians({edge}.x2 - {edge}.x1)), 0d)"
    return F.expr(f"if(sphere, {arc}, {edge}.y1 + {share} * ({edge}.y2 - {edge}.y1) - base)")


def _under_arc(one: str, two: str, width: str) -> str:
    """Integral of sin(latitude) under an arc ``width`` (radians) long, by the tangents of the latitudes at its ends."""
    half = [f"({t} / (1 + sqrt(1 + {t} * {t})))" for t in (one, two)]
    return f"2 * atan2(tan(({width}) / 2) * ({half[0]} + {half[1]}), 1 + {half[0]} * {half[1]})"


def _side(edge: str, x: str, y: str) -> str:
    """On which side of an edge's line, or of its great circle's plane, a point lies."""
    flat = f"({edge}.x2 - {edge}.x1) * ({y} - {edge}.y1) - ({edge}.y2 - {edge}.y1) * ({x} - {edge}.x1)"
    arc = f"tan(radians({edge}.y1)) * sin(radians({x} - {edge}.x2)) + tan(radians({edge}.y2)) * sin(radians({edge}.x1 - {x})) + tan(radians({y})) * sin(radians({edge}.x2 - {edge}.x1))"
    return f"signum(if(sphere, {arc}, {flat}))"


def _compared(met: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``sphere``, ``part`` (signed area under the lower of edges e and f between low and high), ``touch`` (whether they share a point).

    Step by step, so that no step repeats another's terms.
    """
    left, right = "greatest(least(e.x1, e.x2), least(f.x1, f.x2), low)", "least(greatest(e.x1, e.x2), greatest(f.x1, f.x2), high)"
    steps = met.select(*keys, "sphere", "base", "e", "f", F.expr(left).alias("left"), F.expr(right).alias("right"))
    sides = {"f1": _side("e", "f.x1", "f.y1"), "f2": _side("e", "f.x2", "f.y2"), "e1": _side("f", "e.x1", "e.y1"), "e2": _side("f", "e.x2", "e.y2")}
    steps = steps.withColumns({n: F.expr(x) for n, x in sides.items()} | {f"{edge}_{x}": _height(edge, x) for edge in "ef" for x in ("left", "right")})
    boxes = "(greatest(f.y1, f.y2) >= least(e.y1, e.y2) and greatest(e.y1, e.y2) >= least(f.y1, f.y2) or sphere and (e.x1 <> e.x2 or f.x1 <> f.x2))"
    touch = F.expr(f"{boxes} and f1 * f2 <= 0 and e1 * e2 <= 0").alias("touch")
    sign = F.expr("if(right > left, signum(e.x2 - e.x1) * signum(f.x2 - f.x1), 0d)").alias("sign")
    steps = steps.select(*keys, "sphere", "e", "left", "right", touch, sign, F.expr("e_left - f_left").alias("g"), F.expr("e_right - f_right").alias("h"), F.expr("least(e_left, f_left)").alias("one"), F.expr("least(e_right, f_right)").alias("two"))
    # where the edges cross: as far from the left as their gaps there and on the right say
    till = "if(sphere, atan2(abs(g) * sin(radians(right - left)), abs(g) * cos(radians(right - left)) + abs(h)), (right - left) * abs(g) / nullif(abs(g) + abs(h), 0d))"
    steps = steps.withColumn("till", F.expr(f"if(sign <> 0 and g * h < 0, {till}, null)"))
    at = "if(sphere, (tan(radians(e.y1)) * sin(radians(e.x2 - left) - till) + tan(radians(e.y2)) * sin(radians(left - e.x1) + till)) / nullif(sin(radians(e.x2 - e.x1)), 0d), null)"
    steps = steps.withColumns({"at": F.expr(at), "width": F.expr("if(sphere, radians(right - left), right - left)")})
    arcs = f"if(till is null, {_under_arc('one', 'two', 'width')}, {_under_arc('one', 'at', 'till')} + {_under_arc('at', 'two', 'width - till')})"
    # of edges on the plane the higher one takes off, from the mean of both, half the gap on the whole
    gaps = "if(till is null, (abs(g) + abs(h)) / 2, (g * g + h * h) / (2 * (abs(g) + abs(h))))"
    flat = f"width * ((2 * one + abs(g) + 2 * two + abs(h)) / 2 - {gaps}) / 2"
    return steps.select(*keys, "sphere", "touch", F.expr(f"if(sign = 0, 0d, sign * if(sphere, {arcs}, {flat}))").alias("part"))


def with_geometries(pairs: DataFrame, a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """``pairs`` with the geometries ``ga``, ``gb`` of their ids."""
    left, right = a.select(a_id, F.col("geometry").alias("ga")), b.select(b_id, F.col("geometry").alias("gb"))
    return pairs.join(left, a_id).join(right, b_id)


def _facing(geometry: str, low: str, high: str, axis: str) -> Column:
    """A geometry's edges over a stretch of an axis."""
    return F.filter(edges(F.col(geometry)), lambda e: (F.greatest(e[f"{axis}1"], e[f"{axis}2"]) >= F.col(low)) & (F.least(e[f"{axis}1"], e[f"{axis}2"]) <= F.col(high)))


def _stacked(name: str, low: str, high: str, axis: str) -> Column:
    """How many edges stand over each other on average along a stretch, times its length."""
    part = lambda e: F.least(F.greatest(e[f"{axis}1"], e[f"{axis}2"]), F.col(high)) - F.greatest(F.least(e[f"{axis}1"], e[f"{axis}2"]), F.col(low))
    return F.aggregate(F.col(name), F.lit(0.0), lambda total, e: total + F.greatest(part(e), F.lit(0.0)))


def _turned(name: str) -> Column:
    """Edges with x and y exchanged."""
    return F.transform(F.col(name), lambda e: F.struct(e["y1"].alias("x1"), e["x1"].alias("y1"), e["y2"].alias("x2"), e["x2"].alias("y2")))


def _in_slabs(based: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of edges of large polygons: those that stand in one slab."""
    upright = based.withColumns({"ey": _facing("ga", "y0", "y1", "y"), "fy": _facing("gb", "y0", "y1", "y")})
    wide, high = (F.greatest(F.col(f"{k}1") - F.col(f"{k}0"), F.lit(1e-300)) for k in "xy")
    stacks = [(_stacked(e, f"{k}0", f"{k}1", k) + _stacked(f, f"{k}0", f"{k}1", k)) / size for e, f, k, size in (("es", "fs", "x", wide), ("ey", "fy", "y", high))]
    told = upright.withColumn("turn", ~F.col("sphere") & (stacks[1] < stacks[0]))
    sides = {"es": F.when(F.col("turn"), _turned("ey")).otherwise(F.col("es")), "fs": F.when(F.col("turn"), _turned("fy")).otherwise(F.col("fs"))}
    place = {"from": F.expr("if(turn, y0, x0)"), "till": F.expr("if(turn, y1, x1)"), "base": F.expr("if(turn, least(ba.x0, bb.x0), base)")}
    sized = told.select(a_id, b_id, "sphere", *[c.alias(n) for n, c in (sides | place).items()])
    slabs = F.ceil((F.size("es") + F.size("fs")) / SLAB_EDGES)
    # a stretch of no width is one slab
    cut = stored(sized.withColumn("slabs", F.when(F.col("till") > F.col("from"), slabs).otherwise(F.lit(1).cast("long"))))
    width = F.expr("if(slabs > 1, (till - from) / slabs, 1d)")

    def dealt(name: str, edge: str) -> DataFrame:
        one = cut.select(a_id, b_id, "sphere", "base", "from", "till", "slabs", width.alias("width"), F.explode(name).alias(edge))
        at = lambda x: F.expr(f"least(greatest(floor(({x} - from) / width), 0), slabs - 1)")
        slab = F.explode(F.sequence(at(f"least({edge}.x1, {edge}.x2)"), at(f"greatest({edge}.x1, {edge}.x2)")))
        return one.withColumn("slab", slab)

    left = dealt("es", "e").withColumns({"low": F.expr("if(slab = 0, from, from + slab * width)"), "high": F.expr("if(slab = slabs - 1, till, from + (slab + 1) * width)")})
    return left.select(a_id, b_id, "slab", "sphere", "base", "low", "high", "e").join(dealt("fs", "f").select(a_id, b_id, "slab", "f"), [a_id, b_id, "slab"])


def overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float | None = None, direct: int = DIRECT_PAIRS, by: tuple[str, ...] = ()) -> DataFrame:
    """``a_id``, ``b_id``, ``overlap`` (area, at least 0) of all pairs of polygons that share area or touch; ids are unique.

    ``by``: columns of both tables, not NULL; only pairs that are equal in them are asked for, and no others are compared.

    Both tables are of one reference system (see crs.reconciled); on longitude and latitude the area is in square metres on the sphere.
    Pairs are found by their boxes alone; the geometries join those. Of either only the edges over the shared stretch are taken.
    ``direct``: the pairs of edges up to which two polygons are compared without slabs.
    """
    # what makes the geometries may be long: it is done once
    a, b = (stored(df.select(key, *by, "geometry")) for df, key in ((a, a_id), (b, b_id)))
    corners = F.size(F.flatten(rings(F.col("geometry")))).cast("long").alias("corners")
    told = [stored(boxes(df, key, *by, corners)) for df, key in ((a, a_id), (b, b_id))]
    pairs = candidate_pairs(*[t.drop("corners") for t in told], cell, by).drop(*by)
    shared = {f"{k}{i}": (F.greatest if i == 0 else F.least)(f"ba.{k}{i}", f"bb.{k}{i}") for k in "xy" for i in (0, 1)}
    sphere = lonlat(F.col("ga"))
    based = with_geometries(pairs, a, b, a_id, b_id).withColumns({**shared, "sphere": sphere, "base": F.least("ba.y0", "bb.y0")})
    based = based.withColumns({"es": _facing("ga", "x0", "x1", "x"), "fs": _facing("gb", "x0", "x1", "x")})
    few = F.size("es").cast("long") * F.size("fs") <= direct
    # stored: with the joins in front, the loop over pairs of edges would be too long to be compiled
    small = materialize(based.where(few).select(a_id, b_id, "sphere", "base", F.col("x0").alias("low"), F.col("x1").alias("high"), "es", "fs"))
    small = small.select(a_id, b_id, "sphere", "base", "low", "high", F.explode("es").alias("e"), "fs")
    met = small.select(a_id, b_id, "sphere", "base", "low", "high", "e", F.explode("fs").alias("f"))
    most = [t.agg(F.max("corners")).first()[0] or 0 for t in told]
    if most[0] * most[1] > direct:
        met = met.unionByName(_in_slabs(based.where(~few), a_id, b_id).select(met.columns))
    met = _compared(met.where("greatest(e.x1, e.x2) >= least(f.x1, f.x2) and greatest(f.x1, f.x2) >= least(e.x1, e.x2)"), [a_id, b_id])
    summed = met.groupBy(a_id, b_id).agg(F.sum("part").alias("sum"), F.sum(F.abs("part")).alias("gross"), F.bool_or("touch").alias("touch"), F.first("sphere").alias("sphere"))
    # what is left of terms that cancel is no area
    told = summed.where(F.col("touch") | (F.col("sum") > 1e-12 * F.greatest("gross", F.lit(1e-300))))
    scale = F.when(F.col("sphere"), F.lit(EARTH_RADIUS**2)).otherwise(F.lit(1.0))
    return told.select(a_id, b_id, (F.greatest("sum", F.lit(0.0)) * scale).alias("overlap"))
