"""Edges cut where they meet, and what lies on either side of each piece: unions, repairs and clips as plans on rows of edges.

Edges that may meet are found by cells of their boxes. Where two cross, or an end of one lies on the other, both are split at one and
the same point; all points are on a fine lattice, so that what is equal stays equal. Equal pieces become one with a net weight per layer. How
often each layer covers a place is the sum of the weights above it: the middle of a piece meets the pieces over its place by
cells of their size class. A piece between places of which one is wanted and the other isn't is a border of the result, and
borders are chained to rings where a result's row is put together.

"Above" is along a slightly tilted line, so that no piece stands upright.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.operators.geometry.overlap import candidate_pairs
from evenground.operators.geometry.rings import assemble, chain_rings
from evenground.operators.geometry.shapes import bound, edges, from_flat
from evenground.runtime import FEW_ROWS, lean, release, stored

#: The tilt; binary digits of the lattice below the size of all coordinates; steps of the lattice that count as no distance.
TILT, DIGITS, NEAR = 0.012345678910111, 44, 4
#: Edges of a group that meet each other without cells: as many pieces at most as the square of this.
FEW_EDGES = 48
_ENDS = ["x1", "y1", "x2", "y2"]
_XY = "array<struct<x:double,y:double>>"


def _step(sizes: list[float | None]) -> float:
    size = max((v for v in sizes if v is not None and v == v), default=0.0)
    return 2.0 ** (int(np.ceil(np.log2(size))) - DIGITS) if size > 0 else 2.0**-DIGITS


def lattice_step(*tables: DataFrame) -> float:
    """The step of the lattice for the coordinates of tables of edges: a power of two."""
    return _step([v for t in tables for v in t.agg(*[F.max(F.abs(c)) for c in _ENDS]).first()])


def _step_and_turn(net: DataFrame) -> tuple[float, bool]:
    """``lattice_step``, and whether far fewer edges stand over each other along y than along x."""
    sizes = [F.max(F.abs(c)) for c in _ENDS]
    sums = [F.sum(F.abs(F.expr(f"{k}2 - {k}1"))) for k in "xy"]
    extents = [F.max(F.greatest(f"{k}1", f"{k}2")) - F.min(F.least(f"{k}1", f"{k}2")) for k in "xy"]
    *most, x, y, wide, high = net.agg(*sizes, *sums, *extents).first()
    return _step(most), bool(wide and high and 4 * y / high < x / wide)


def turned(df: DataFrame) -> DataFrame:
    """Edges with x and y exchanged and their ends too, so that what was on their right stays there; twice: as they were."""
    return df.withColumns({c: F.col(o) for c, o in zip(_ENDS, ("y2", "x2", "y1", "x1"), strict=True)})


def snapped(df: DataFrame, step: float) -> DataFrame:
    """Edges with their ends on the lattice; those without length go."""
    on = df.withColumns({c: F.rint(F.col(c) / step) * step for c in _ENDS})
    return on.where("(x1, y1) <> (x2, y2)")


def _boxed(df: DataFrame, edge: str, more: list[str]) -> DataFrame:
    box = F.struct(F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"), F.greatest("x1", "x2").alias("x1"), F.greatest("y1", "y2").alias("y1"))
    return df.select(*more, box.alias("box"), F.struct(*_ENDS).alias(edge))


def _cuts(pairs: DataFrame, step: float, keys: list[str]) -> DataFrame:
    """``keys``, ``es``, ``fs``: points at which edges e and f of a pair are to be split."""
    near = NEAR * step
    sizes = {f"{edge}_size": F.expr(f"sqrt(({edge}.x2 - {edge}.x1) * ({edge}.x2 - {edge}.x1) + ({edge}.y2 - {edge}.y1) * ({edge}.y2 - {edge}.y1))") for edge in "ef"}
    steps = pairs.select(*keys, "e", "f").withColumns(sizes | {"turn": F.expr("nullif((e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1), 0d)")})
    on = {}
    for edge, other in (("e", "f"), ("f", "e")):
        for i in (1, 2):  # whether an end of the other lies on the edge and isn't one of its ends
            along = f"(({other}.x{i} - {edge}.x1) * ({edge}.x2 - {edge}.x1) + ({other}.y{i} - {edge}.y1) * ({edge}.y2 - {edge}.y1)) / {edge}_size"
            across = f"(({other}.x{i} - {edge}.x1) * ({edge}.y2 - {edge}.y1) - ({other}.y{i} - {edge}.y1) * ({edge}.x2 - {edge}.x1)) / {edge}_size"
            on[f"{edge}{i}"] = F.expr(f"abs({across}) <= {near!r}d and {along} > {near!r}d and {along} < {edge}_size - {near!r}d")
    share = "((f.x1 - e.x1) * (f.y2 - f.y1) - (f.y1 - e.y1) * (f.x2 - f.x1)) / turn"
    other = "((f.x1 - e.x1) * (e.y2 - e.y1) - (f.y1 - e.y1) * (e.x2 - e.x1)) / turn"
    steps = steps.withColumns(on | {"share": F.expr(share), "other": F.expr(other)})
    crossed = "share > 0 and share < 1 and other > 0 and other < 1 and not (e1 or e2 or f1 or f2)"
    steps = steps.withColumns({k: F.expr(f"if({crossed}, rint((e.{k}1 + share * (e.{k}2 - e.{k}1)) / {step!r}d) * {step!r}d, null)") for k in "xy"})
    apart = " and ".join(f"(x - {edge}.x{i}) * (x - {edge}.x{i}) + (y - {edge}.y{i}) * (y - {edge}.y{i}) > {near * near!r}d" for edge in "ef" for i in (1, 2))
    steps = steps.withColumn("cross", F.expr(f"if({apart}, struct(x, y), null)"))
    found = {f"{edge}s": F.expr(f"array_compact(array({', '.join(f'if({edge}{i}, struct({other}.x{i} as x, {other}.y{i} as y), null)' for i in (1, 2))}, cross))") for edge, other in (("e", "f"), ("f", "e"))}
    return steps.select(*keys, *[c.alias(n) for n, c in found.items()])


def meetings(one: DataFrame, two: DataFrame | None, step: float, by: tuple[str, ...], wanted: Callable[[str, str], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``cuts``) for edges of ``one``, and for those of ``two`` (None: edges of ``one`` among each other; both tables are the same then).

    ``wanted``: from the names of the cuts of two edges, whether they count (None: any cut does).
    """
    more = ["id", *by, *(["few"] if "few" in one.columns else [])]
    left = _boxed(one, "e", more)
    right = _boxed(one if two is None else two, "f", more).withColumnRenamed("id", "jd")
    pairs = candidate_pairs(left, right, by=by, once=("id", "jd") if two is None else None)
    # boxes that share one point, an end of both edges: nothing is cut
    shared = F.struct(F.greatest("ba.x0", "bb.x0"), F.greatest("ba.y0", "bb.y0"))
    point = shared == F.struct(F.least("ba.x1", "bb.x1"), F.least("ba.y1", "bb.y1"))
    ends = [(F.struct(f"{edge}.x1", f"{edge}.y1") == shared) | (F.struct(f"{edge}.x2", f"{edge}.y2") == shared) for edge in "ef"]
    pairs = pairs.where(~(point & ends[0] & ends[1])).select("id", "jd", "e", "f")
    # stored: Spark would put the cuts' terms into the loop of the join, which then is too long to be compiled, and work them out for both halves of a union
    pairs = stored(pairs)
    # stored before those without cuts go: Spark would put the whole of the cuts' terms into the filter, once for every time each is read
    found = stored(_cuts(pairs, step, ["id", "jd"])).where(wanted("es", "fs") if wanted else F.expr("size(es) + size(fs) > 0"))
    release(pairs)
    sides = [found.select(F.col(i).alias("id"), F.explode(c).alias("p")) for i, c in (("id", "es"), ("jd", "fs"))]
    gathered = [side.groupBy("id").agg(F.collect_set("p").alias("cuts")) for side in ([sides[0].union(sides[1])] * 2 if two is None else sides)]
    if found.count() <= FEW_ROWS:
        gathered = [F.broadcast(g) for g in gathered]
    return gathered[0], gathered[1]


def split(df: DataFrame, cuts: DataFrame, keep: list[str]) -> DataFrame:
    """The pieces of edges (id, ends, ``keep``) between their cuts: ``keep`` and ends; ``bent``, if kept: whether a cut is off the straight line, too."""
    joined = df.join(cuts, "id", "left")
    if "bent" in keep:
        off = F.exists("cuts", lambda p: (p["x"] - F.col("x1")) * F.expr("y2 - y1") != (p["y"] - F.col("y1")) * F.expr("x2 - x1"))
        joined = joined.withColumn("bent", F.col("bent") | F.coalesce(off, F.lit(False)))
    along = F.transform(F.coalesce("cuts", F.array().cast(_XY)), lambda p: F.struct(((p["x"] - F.col("x1")) * F.expr("x2 - x1") + (p["y"] - F.col("y1")) * F.expr("y2 - y1")).alias("t"), p["x"].alias("x"), p["y"].alias("y")))
    point = lambda i: F.array(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")))
    path = F.concat(point(1), F.transform(F.array_sort(along), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), point(2))
    piece = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    steps = bound(path, lambda at: F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), piece))
    return joined.select(*keep, F.explode(steps).alias("s")).select(*keep, "s.*").where("(x1, y1) <> (x2, y2)")


def pieces(df: DataFrame, by: list[str], layers: list[str], bent: bool = False) -> DataFrame:
    """Equal pieces as one, from left to right along the tilt, with the net weight of every layer; those of no weight go. ``bent``: with that column, true if one's is."""
    more = ["bent"] if bent else []
    u = [F.expr(f"x{i} + {TILT} * y{i}") for i in (1, 2)]
    right = (u[0] < u[1]) | (u[0] == u[1]) & (F.col("y1") < F.col("y2"))
    swap = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    turned = df.select(*by, *[F.when(right, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in swap.items()], *[F.when(right, F.col(w)).otherwise(-F.col(w)).alias(w) for w in layers], *more)
    net = turned.groupBy(*by, *_ENDS).agg(*[F.sum(w).alias(w) for w in layers], *[F.max(c).alias(c) for c in more])
    return net.where(" or ".join(f"{w} <> 0" for w in layers)).withColumns({"u1": F.expr(f"x1 + {TILT} * y1"), "u2": F.expr(f"x2 + {TILT} * y2")})


def covered(points: DataFrame, over: DataFrame, keys: list[str], by: list[str], layers: list[str]) -> DataFrame:
    """``keys``, ``by`` and for every layer ``<layer>_up``: the weight above the middle of each piece of ``points``.

    ``points`` and ``over`` are from ``pieces``; a row of ``points`` that has no piece of ``over`` at its place is left out. ``by``: columns of
    ``over`` that are told apart; where ``points`` has them too they are equal. Where ``few``, of both, is true, all pieces of a ``by`` meet.
    """
    flagged = "few" in points.columns
    few = F.col("few") if flagged else F.lit(False)
    size = F.when(~few, F.ceil(F.log2(F.expr("u2 - u1"))).cast("int"))
    sized = over.withColumn("size", size)
    classes = sorted(r["size"] for r in sized.select("size").distinct().collect() if r["size"] is not None)  # powers of two: few
    if not classes:
        classes = [0]
    cell = lambda at, k: F.floor(at / F.pow(F.lit(2.0), k))
    place = lambda at: F.when(few, 0).otherwise(at) if flagged else at
    sized = sized.withColumn("size", F.coalesce("size", F.lit(0))) if flagged else sized
    wide = sized.withColumn("cell", F.explode(F.sequence(place(cell(F.col("u1"), F.col("size"))), place(cell(F.col("u2"), F.col("size"))))))
    wide = wide.select(*by, "size", "cell", *[F.col(w).alias(f"o_{w}") for w in layers], *[F.col(c).alias(f"o_{c}") for c in ("u1", "u2", "y1", "y2")])
    shared = [c for c in by if c in points.columns]
    asked = points.select(*dict.fromkeys([*keys, *shared, *(["few"] if flagged else [])]), F.expr("(u1 + u2) / 2").alias("u"), F.expr("(y1 + y2) / 2").alias("y"), "u1", "u2", "y1", "y2")
    sizes = F.when(few, F.array(F.lit(0))).otherwise(F.lit(classes)) if flagged else F.lit(classes)
    asked = asked.withColumn("size", F.explode(sizes)).withColumn("cell", place(cell(F.col("u"), F.col("size"))))
    met = lean(asked, points).join(lean(wide, over), [*shared, "size", "cell"]).where("o_u1 <= u and u < o_u2")
    same = F.expr("o_u1 = u1 and o_u2 = u2 and o_y1 = y1 and o_y2 = y2")
    above = ~same & (F.expr("o_y1 + (u - o_u1) / (o_u2 - o_u1) * (o_y2 - o_y1)") > F.col("y"))
    return met.groupBy(*dict.fromkeys([*keys, *by])).agg(*[F.sum(F.when(above, F.col(f"o_{w}")).otherwise(0)).alias(f"{w}_up") for w in layers])


def borders(df: DataFrame, by: list[str], inside: Callable[..., Column], layers: list[str]) -> DataFrame:
    """``by`` and directed ends of the pieces that bound the wanted places, these on their right.

    ``df``: pieces with ``<layer>_up``; ``inside``: from how often each layer covers a place, whether it is wanted.
    """
    up, down = (inside(*[F.col(f"{w}_up") + (F.col(w) if side else 0) for w in layers]) for side in (0, 1))
    told = df.select(*by, *_ENDS, up.alias("up"), down.alias("down")).where("up <> down")
    swap = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    return told.select(*by, *[F.when(F.col("down"), F.col(c)).otherwise(F.col(o)).alias(c) for c, o in swap.items()])


def _chained(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        out = []
        for numbers in part:
            e = np.asarray(numbers, float).reshape(-1, 4)
            out.append(assemble(chain_rings(*e[np.lexsort(e.T)].T.tolist())))
        yield pd.Series(out, dtype=object)


_chained.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}


def polygons(df: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the ``geometry`` (of no system) that directed borders (by, ends) bound; a group gathers its borders, its row of the result."""
    grouped = df.groupBy(*by).agg(F.flatten(F.collect_list(F.array(*_ENDS))).alias("_k"))
    rings = F.pandas_udf(_chained, "array<array<array<double>>>")(F.col("_k"))
    return grouped.withColumn("_rings", rings).select(*by, from_flat(F.col("_rings"), F.lit(0)).alias("geometry"))


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the ends of every edge of ``geometry``."""
    return df.select(*keep, F.explode(edges(F.col("geometry"))).alias("_e")).select(*keep, *[F.col(f"_e.{c}").alias(c) for c in _ENDS])


def _pieces_once(df: DataFrame, cuts: DataFrame, by: list[str], flag: list[str], layers: list[str]) -> DataFrame:
    """``pieces`` of edges, stored, with an ``id`` and ``bent``: whether a cut has moved the piece off its edge."""
    marked = df if "bent" in df.columns else df.withColumn("bent", F.lit(False))
    return stored(pieces(split(marked, cuts, [*by, *flag, *layers, "bent"]), [*by, *flag], layers, bent=True).withColumn("id", F.monotonically_increasing_id()))


def _settled(found: DataFrame, by: list[str], flag: list[str], layers: list[str], step: float) -> DataFrame:
    """``found`` cut again until nothing is: a cut lies on the lattice and not always on its edge, so that the pieces beside it may meet others anew.

    Pieces that no cut has bent met each other in the first round; groups without a bent piece are done.
    """
    done, used = [], []
    while found.where("bent").limit(1).count():
        if by:
            groups = stored(found.where("bent").select(*by).distinct())
            done.append(found.join(groups, by, "left_anti"))
            found, last = stored(found.join(groups, by, "left_semi")), found
            used += [groups, last]
        ours, theirs = meetings(found.where("bent"), found, step, tuple(by))
        cuts = stored(ours.union(theirs).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts")))
        used += [cuts, found]
        found = _pieces_once(found.withColumn("bent", F.lit(False)), cuts, by, flag, layers)
    if not done:
        return found
    whole = stored(reduce(DataFrame.unionByName, done, found))
    release(*used, found)
    return whole


def bounded(net: DataFrame, by: list[str], inside: Callable[..., Column], layers: list[str]) -> DataFrame:
    """``by`` (not NULL) and the borders of what is wanted, from edges (by, ends, weights per layer), which may cross."""
    own = stored(net.withColumn("id", F.monotonically_increasing_id()))  # what makes the edges is done once
    step, turn = _step_and_turn(own)
    numbered, flag = snapped(turned(own) if turn else own, step), []
    if by:
        sizes = own.groupBy(*by).agg((F.count("*") <= FEW_EDGES).alias("few"))
        numbered, flag = stored(numbered.join(sizes, by)), ["few"]
    cuts, _ = meetings(numbered, None, step, tuple(by))
    found = _settled(_pieces_once(numbered, cuts, by, flag, layers), by, flag, layers, step)
    release(own, *([numbered] if by else []))
    # every piece meets itself: its weights come along
    told = borders(covered(found, found, [*by, *_ENDS, *layers], by, layers), by, inside, layers)
    return turned(told) if turn else told
