"""Which polygons, eroded by a tolerance, meet others; decided on rows of edges, in closed form.

The eroded polygon is what lies inside it and at least ``t`` from its outline. The points closer than ``t`` to one edge are a
capsule, which is convex: on a line it rules out one stretch, on a circle a few. What the edges near a line or circle leave of it are
its gaps, found by a running maximum over the stretches in order. Every part of an eroded polygon has a gap on its own outline: on an edge moved
inwards by ``t``, or on the circle around a reflex corner. So one point per gap (the skeleton) tells whether a polygon outlasts a
tolerance, and whether a part lies in another polygon; and where no such point does, the eroded polygon meets the other one only if
an edge of the other has a gap inside the polygon. Edges meet the lines near them by cells of size classes, so the work grows with the edges
and with how many lie within ``t`` of each other, not with the square of a polygon's corners.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.operators.geometry.overlap import candidate_pairs
from evenground.operators.geometry.shapes import bbox
from evenground.runtime import materialize, release

HALVINGS = 20
_ENDS = ["x1", "y1", "x2", "y2"]


def outlines(df: DataFrame, key: str) -> DataFrame:
    """``key``, edges with their place ``i`` in the ring and the place ``after`` of the next, from the lower left corner (``ox``, ``oy``) of their box.

    Small numbers round less. Edges without length are left out; ``wide``: the box's smaller side; ``slip``: the largest number.
    """
    shaped = df.select(key, F.col("geometry").alias("g"), bbox(F.col("geometry")).alias("box")).where("box.x0 is not null")
    rings = F.transform(F.flatten(F.col("g.polygons")), lambda ring: F.array_compact(F.transform(_steps(ring), lambda e: F.when((e["x1"] != e["x2"]) | (e["y1"] != e["y2"]), e))))
    rows = shaped.select(key, "box", F.posexplode(rings).alias("ring", "es")).select(key, "box", "ring", F.size("es").alias("n"), F.posexplode("es").alias("i", "e"))
    moved = [(F.col(f"e.{c}") - F.col(f"box.{c[0]}0")).alias(c) for c in _ENDS]
    wide, slip = F.expr("least(box.x1 - box.x0, box.y1 - box.y0)"), F.expr("greatest(box.x1 - box.x0, box.y1 - box.y0)")
    return rows.select(key, "ring", "i", ((F.col("i") + 1) % F.col("n")).alias("after"), *moved, F.col("box.x0").alias("ox"), F.col("box.y0").alias("oy"), wide.alias("wide"), slip.alias("slip"))


def _steps(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def _reach() -> Column:
    """The distance that rules out: the tolerance ``t`` less what rounding may take off."""
    return F.greatest(F.col("t") - (1e-9 * F.col("t") + 1e-12 * F.col("slip")), F.col("t") / 2)


def _near(probes: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """Each probe (key, its own columns, box within reach) with every edge ``f`` of its polygon that the box meets."""
    box = F.struct(F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"), F.greatest("x1", "x2").alias("x1"), F.greatest("y1", "y2").alias("y1"))
    return candidate_pairs(probes, sides.select(key, box.alias("box"), F.struct(*_ENDS).alias("f")), by=(key,)).drop("ba", "bb")


def _stretches(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high): places on each row's line or circle closer than r to its edge. A line starts at (px, py) and runs along (ux, uy);
    a circle of radius t around (px, py) counts angles from 0 to a full turn."""
    ends = [(w[f"x{i}"] - w["px"], w[f"y{i}"] - w["py"]) for i in (1, 2)]
    dx, dy = ends[1][0] - ends[0][0], ends[1][1] - ends[0][1]
    size = np.hypot(dx, dy)
    dx, dy = dx / size, dy / size
    along, side = -(ends[0][0] * dx + ends[0][1] * dy), ends[0][0] * dy - ends[0][1] * dx
    r, t, row, found = w["r"], w["t"], np.arange(len(size)), []
    line, full = ~w["arc"], 2 * np.pi
    # lines: of the capsule's discs and rectangle (0 < position < size, |side| < r, each linear) the outermost places
    lows, highs = [], []
    for x, y in ends:
        middle = x * w["ux"] + y * w["uy"]
        rest = r * r - (x * x + y * y - middle * middle)
        half = np.sqrt(np.where(rest > 0, rest, np.nan))
        lows.append(middle - half)
        highs.append(middle + half)
    low, high = np.full(len(size), -np.inf), np.full(len(size), np.inf)
    for value, slope, least, most in ((along, w["ux"] * dx + w["uy"] * dy, 0.0, size), (side, w["uy"] * dx - w["ux"] * dy, -r, r)):
        one, two = (least - value) / slope, (most - value) / slope
        level, within = np.abs(slope) < 1e-15, (value > least) & (value < most)
        low = np.where(level, np.where(within, low, np.inf), np.maximum(low, np.minimum(one, two)))
        high = np.where(level, np.where(within, high, -np.inf), np.minimum(high, np.maximum(one, two)))
    met = low < high
    found.append((row[line], np.fmin.reduce([*lows, np.where(met, low, np.nan)])[line], np.fmax.reduce([*highs, np.where(met, high, np.nan)])[line]))
    # circles: what each disc covers, and where one of two ranges of the side meets one of three of the position
    for x, y in ends:
        far = np.hypot(x, y)
        share = (t * t + far * far - r * r) / (2 * t * far)
        half = np.arccos(np.clip(np.where(share < 1, share, np.nan), -1, 1))
        found.append((row[~line], (np.arctan2(y, x) - half)[~line], (np.arctan2(y, x) + half)[~line]))
    bounded = lambda v: np.clip(v, -1, 1)
    a, b = np.arcsin(bounded((-r - side) / t)), np.arcsin(bounded((r - side) / t))
    first, last, way = np.arccos(bounded((size - along) / t)), np.arccos(bounded(-along / t)), np.arctan2(dy, dx)
    for one, two in ((a, b), (np.pi - b, np.pi - a)):
        for begin, end in ((first, last), (-last, -first), (full - last, full - first)):
            start, stop = np.maximum(one, begin), np.minimum(two, end)
            start = np.where(start < stop, start, np.nan)
            found.append((row[~line], (start + way)[~line], (stop + way)[~line]))
    row, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    good = low < high
    row, low, high = row[good], low[good], high[good]
    turned = w["arc"][row]
    begin = np.where(turned, np.mod(low, full), low)
    row, low, high = np.concatenate([row, row[turned]]), np.concatenate([begin, begin[turned] - full]), np.concatenate([begin + (high - low), (begin + (high - low))[turned] - full])
    return row, low, high


def _gap_points(rows: pa.Table) -> pa.RecordBatch:
    """One point in every gap that the edges of whole probes leave of places 0 to ``span``; a gap may be a point."""
    w = {c: rows[c].to_numpy() for c in rows.column_names}
    with np.errstate(divide="ignore", invalid="ignore"):
        row, low, high = _stretches(w)
    inside = (high > 0) & (low < w["span"][row])
    heads = np.flatnonzero(np.diff(w["pid"], prepend=w["pid"][0] - 1))  # a stretch without an end closes each probe
    seg = np.cumsum(np.diff(w["pid"], prepend=w["pid"][0]) != 0)
    told = pd.DataFrame({"seg": np.concatenate([seg[row[inside]], seg[heads]]), "low": np.concatenate([low[inside], w["span"][heads]]), "high": np.concatenate([high[inside], np.full(len(heads), np.inf)])})
    told = told.sort_values(["seg", "low", "high"], kind="stable")
    till = told.groupby("seg")["high"].cummax().groupby(told["seg"]).shift(1).fillna(0.0).to_numpy()
    head = heads[told["seg"].to_numpy()]
    end = np.minimum(told["low"].to_numpy(), w["span"][head])
    head, s = head[till <= end], ((till + end) / 2)[till <= end]
    x = w["px"][head] + np.where(w["arc"][head], w["t"][head] * np.cos(s), s * w["ux"][head])
    y = w["py"][head] + np.where(w["arc"][head], w["t"][head] * np.sin(s), s * w["uy"][head])
    return pa.RecordBatch.from_arrays([pa.array(w["pid"][head]), pa.array(x), pa.array(y)], ["pid", "x", "y"])


_PROBE = ["pid", "arc", "px", "py", "ux", "uy", "span", "t", "r"]


def gap_points(probes: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """``pid``, ``x``, ``y``: a point in every gap that the edges ``sides`` (key, ends) leave of the probes (key, box, columns of _PROBE), which are stored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
            if not rows.num_rows:
                continue
            pid = rows["pid"].to_numpy()
            last = int(np.searchsorted(pid, pid[-1], "left"))  # the last probe may go on
            if last:
                yield _gap_points(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None and rest.num_rows:
            yield _gap_points(rest)

    near = _near(probes.select(key, "box", *_PROBE), sides, key).select(*_PROBE, *[F.col(f"f.{c}").alias(c) for c in _ENDS])
    alone = probes.select(*_PROBE, *[F.lit(float("nan")).alias(c) for c in _ENDS])  # probes without an edge near them
    return near.unionByName(alone).repartition("pid").sortWithinPartitions("pid").mapInArrow(scan, "pid long, x double, y double")


def _probes(lines: DataFrame, key: str, *more: str) -> DataFrame:
    """Lines and circles stored with a number each and the box in which edges are within reach."""
    far = F.expr("if(arc, t, 0d)")
    ends = {"x": ("px", "px + span * ux"), "y": ("py", "py + span * uy")}
    reach = lambda k, low: F.expr(f"{'least' if low else 'greatest'}({ends[k][0]}, if(arc, {ends[k][0]}, {ends[k][1]}))") - (1 if low else -1) * (F.col("t") + far)
    box = F.struct(reach("x", True).alias("x0"), reach("y", True).alias("y0"), reach("x", False).alias("x1"), reach("y", False).alias("y1"))
    return materialize(lines.select(key, *more, *_PROBE[1:], box.alias("box")).withColumn("pid", F.monotonically_increasing_id()))


def skeleton(sides: DataFrame, key: str) -> DataFrame:
    """``key`` and points ``x``, ``y`` (as the edges' places) of the polygons eroded by ``t``: one at least of every part.

    ``sides``: from ``outlines``, with the column ``t``. Polygons run clockwise around their inside, so it is on the right of their edges.
    """
    length = F.expr("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))")
    at = sides.where("wide >= 2 * t * (1 - 1e-9)").withColumns({"r": _reach(), "span": length})
    at = materialize(at.withColumns({"ux": F.expr("x2 - x1") / F.col("span"), "uy": F.expr("y2 - y1") / F.col("span")}))
    lines = at.select(key, F.lit(False).alias("arc"), F.expr("x1 + t * uy").alias("px"), F.expr("y1 - t * ux").alias("py"), "ux", "uy", "span", "t", "r")
    # corners at which the outline turns left: the inside is wider than half a turn
    nexts = at.select(key, "ring", F.col("i").alias("after"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
    left = at.join(nexts, [key, "ring", "after"]).where("ux * vy - uy * vx > 0 or ux * vy - uy * vx = 0 and ux * vx + uy * vy < 0")
    corners = left.select(key, F.lit(True).alias("arc"), F.col("x2").alias("px"), F.col("y2").alias("py"), "ux", "uy", F.lit(2 * pi).alias("span"), "t", "r")
    probes = _probes(lines.unionByName(corners), key)
    found = materialize(gap_points(probes, at, key).join(probes.select("pid", key), "pid").select(key, "x", "y").distinct())
    release(probes)
    # at a sharp corner the end of an edge moved inwards lies outside
    return inside(found, at, key)


def kept(df: DataFrame, key: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``t``; ``key``, ``x``, ``y``), stored: the tolerance, halved until a polygon isn't eroded away, and its skeleton at that.

    Polygons without edges are left out; one that is eroded away after 20 halvings too is an error. Ids are unique.
    """
    # halvings that the box alone asks for are taken at once
    halved = F.greatest(F.lit(0), F.ceil(F.log2(2 * tolerance * (1 - 1e-9) / F.col("wide")))).cast("int")
    todo = materialize(outlines(df, key).withColumn("k", F.when(F.col("wide") > 0, halved).otherwise(HALVINGS + 1)))
    told, points = [], []
    while not todo.isEmpty():
        if not todo.where(F.col("k") > HALVINGS).isEmpty():
            raise ValueError("a polygon vanishes at every tolerance")
        now = todo.withColumn("t", F.lit(tolerance) / F.pow(F.lit(2.0), F.col("k")))
        whole = now.select(key, "ox", "oy", "t").distinct()
        found = materialize(skeleton(now, key).join(whole, key).select(key, "t", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y")))
        points.append(found.select(key, "x", "y"))
        told.append(found.select(key, "t").distinct())
        left = materialize(todo.join(told[-1].select(key), key, "left_anti").withColumn("k", F.col("k") + 1))
        release(todo)
        todo = left
    release(todo)
    if not told:
        none = df.sparkSession.range(0).select(F.lit(None).cast(df.schema[key].dataType).alias(key), *[F.lit(0.0).alias(c) for c in "txy"])
        return none.select(key, "t"), none.select(key, "x", "y")
    return tuple(reduce(DataFrame.unionByName, tables) for tables in (told, points))


def inside(points: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """The rows of ``points`` (key, x, y and more) that lie in the area which the edges ``sides`` (key, ends) of their polygon bound.

    An odd number of edges above tells. Edges meet the points over their place by cells of their size class.
    """
    wide = sides.where("x1 <> x2").select(key, F.struct(*_ENDS).alias("f"), F.ceil(F.log2(F.expr("abs(x2 - x1)"))).cast("int").alias("size"))
    classes = sorted(r["size"] for r in wide.select("size").distinct().collect())  # powers of two: few
    cell = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k))
    dealt = wide.withColumn("cell", F.explode(F.sequence(cell(F.expr("least(f.x1, f.x2)"), F.col("size")), cell(F.expr("greatest(f.x1, f.x2)"), F.col("size")))))
    asked = points.withColumn("size", F.explode(F.lit(classes or [0]))).withColumn("cell", cell(F.col("x"), F.col("size")))
    met = asked.join(dealt, [key, "size", "cell"]).where("(f.x1 > x) <> (f.x2 > x) and f.y1 + (x - f.x1) / (f.x2 - f.x1) * (f.y2 - f.y1) > y")
    return met.groupBy(*points.columns).count().where("count % 2 = 1").drop("count")


def met_skeletons(pairs: DataFrame, points: DataFrame, sides: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """The pairs (a_id, b_id) of which a point of a's skeleton (a_id, x, y) lies in b, whose edges (b_id, ends, whole places) are ``sides``."""
    asked = materialize(pairs.join(points, a_id).where("bb.x0 <= x and x <= bb.x1 and bb.y0 <= y and y <= bb.y1").select(a_id, b_id, "x", "y").distinct())
    on = _on_border(asked, sides, b_id)
    return inside(asked, sides, b_id).select(a_id, b_id).unionByName(on.select(a_id, b_id)).distinct()


def _on_border(points: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """The points that lie on an edge, but for rounding: an eroded polygon may be a line on the other's border."""
    slip = F.expr("1e-9 * (1 + abs(x) + abs(y))")
    box = F.struct((F.col("x") - slip).alias("x0"), (F.col("y") - slip).alias("y0"), (F.col("x") + slip).alias("x1"), (F.col("y") + slip).alias("y1"))
    met = _near(points.withColumn("box", box), sides, key)
    dx, dy = F.expr("f.x2 - f.x1"), F.expr("f.y2 - f.y1")
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.expr("x - f.x1") * dx + F.expr("y - f.y1") * dy) / (dx * dx + dy * dy)))
    gap = [F.col(k) - (F.col(f"f.{k}1") + along * d) for k, d in (("x", dx), ("y", dy))]
    return met.where(gap[0] * gap[0] + gap[1] * gap[1] <= 1e-24 * (1 + F.abs("x") + F.abs("y")) * (1 + F.abs("x") + F.abs("y")))


def met_edges(pairs: DataFrame, sides: DataFrame, others: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """The pairs (a_id, b_id) of which an edge of b (``others``: b_id, ends, whole places) has a gap in a (``sides``: from outlines, with ``t``)."""
    origin = sides.groupBy(a_id).agg(*[F.first(c).alias(c) for c in ("ox", "oy", "t", "slip", "wide")]).where("wide >= 2 * t * (1 - 1e-9)").withColumn("r", _reach())
    lines = pairs.select(a_id, b_id).join(origin, a_id).join(others.select(b_id, F.struct("ring", "i").alias("probe"), *_ENDS), b_id)
    for c in _ENDS:
        lines = lines.withColumn(c, F.col(c) - F.col(f"o{c[0]}"))
    # only edges that reach into a's box less the tolerance; the box of a starts at 0
    sizes = sides.groupBy(a_id).agg(F.max(F.greatest("x1", "x2")).alias("w"), F.max(F.greatest("y1", "y2")).alias("h"))
    close = "greatest(x1, x2) >= r and least(x1, x2) <= w - r and greatest(y1, y2) >= r and least(y1, y2) <= h - r"
    lines = lines.join(sizes, a_id).where(close).withColumn("span", F.expr("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"))
    lines = lines.select(a_id, b_id, F.lit(False).alias("arc"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.expr("(x2 - x1) / span").alias("ux"), F.expr("(y2 - y1) / span").alias("uy"), "span", "t", "r")
    probes = _probes(lines, a_id, b_id)
    gaps = gap_points(probes, sides, a_id).join(probes.select("pid", a_id, b_id), "pid").select(a_id, b_id, "x", "y")
    return inside(gaps.distinct(), sides, a_id).select(a_id, b_id).distinct()


def whole_edges(df: DataFrame, key: str) -> DataFrame:
    """``key``, ``ring``, ``i`` and the ends of every edge that has a length, at their own places."""
    sides = outlines(df, key)
    return sides.select(key, "ring", "i", *[(F.col(c) + F.col(f"o{c[0]}")).alias(c) for c in _ENDS])
