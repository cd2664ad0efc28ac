"""Unions, repairs and clips of polygons whose edges cross."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evenground.operators.geometry import overlay, shapes
from evenground.operators.geometry.dissolve import dissolve
from evenground.operators.geometry.overlap import overlaps
from evenground.operators.geometry.rings import assemble, chain_rings
from tests.test_geometry import HOLED, polygons, ring, square


def raw(spark, rows):
    """(id, [rings]) as they are, open or turned whichever way."""
    data = [(i, {"srid": 0, "polygons": [[ring(r) for r in rings]]}) for i, rings in rows]
    return spark.createDataFrame(data, f"id string, geometry {shapes.TYPE}")


def measures(df, *keys):
    rows = df.select(*keys, shapes.area(F.col("geometry")).alias("a"), F.size("geometry.polygons").alias("n"), F.size(shapes.rings(F.col("geometry"))).alias("r")).collect()
    return {tuple(r[k] for k in keys): (pytest.approx(r.a, abs=1e-9), r.n, r.r) for r in rows}


def star(draw, x, y, size, corners=9):
    angles = [2 * math.pi * (i + draw.uniform(0, 0.8)) / corners for i in range(corners)]
    radii = [size * draw.uniform(0.3, 1) for _ in angles]
    return [(x + r * math.cos(t), y + r * math.sin(t)) for r, t in zip(radii, angles, strict=True)]


def test_unions(spark):
    rows = [("overlap", [square(0, 0, 2)]), ("overlap", [square(1, 1, 2)]), ("three", [square(0, 0, 2)]), ("three", [[(2, 0), (4, 0), (4, 1), (2, 1)]]), ("three", [[(2, 1), (4, 1), (4, 2), (2, 2)]])]
    rows += [("within", [square(0, 0, 5)]), ("within", [square(1, 1)]), ("apart", [square(0, 0)]), ("apart", [square(3, 3)]), ("same", [square(0, 0)]), ("same", [square(0, 0)]), ("filled", HOLED), ("filled", [square(1, 1, 2)]), ("frame", HOLED), ("frame", [square(1.5, 1.5)])]
    got = measures(dissolve(polygons(spark, rows), ["id"]), "id")
    assert {k[0]: v for k, v in got.items()} == {"overlap": (7.0, 1, 1), "three": (8.0, 1, 1), "within": (25.0, 1, 1), "apart": (2.0, 2, 2), "same": (1.0, 1, 1), "filled": (16.0, 1, 1), "frame": (13.0, 2, 3)}


def test_unions_of_missing_groups_and_rows(spark):
    df = polygons(spark, [("a", [square(0, 0)]), (None, [square(0, 0)]), (None, [square(0.5, 0)])]).unionByName(spark.createDataFrame([("none", None)], f"id string, geometry {shapes.TYPE}"))
    got = {r.id: r.a for r in dissolve(df, ["id"]).select("id", shapes.area(F.col("geometry")).alias("a")).collect()}
    assert got == {"a": 1.0, None: 1.5, "none": None}
    assert dissolve(df, []).select(shapes.area(F.col("geometry"))).first()[0] == 1.5
    assert dissolve(df.where("false"), ["id"]).count() == 0


def test_a_union_has_what_its_members_have_less_what_they_share(spark):
    draw = random.Random(2)
    pairs = [(f"{k}", star(draw, 20 * k, 0, 5), star(draw, 20 * k + draw.uniform(-4, 4), draw.uniform(-4, 4), 5)) for k in range(40)]
    one, two = polygons(spark, [(k, [a]) for k, a, _ in pairs], "a"), polygons(spark, [(k, [b]) for k, _, b in pairs], "b")
    area = lambda df: {r[0]: r[1] for r in df.select(df.columns[0], shapes.area(F.col("geometry"))).collect()}
    a, b = area(one), area(two)
    shared = {r.a: r.overlap for r in overlaps(one, two, "a", "b").where("a = b").collect()}
    united = area(dissolve(one.toDF("k", "geometry").unionByName(two.toDF("k", "geometry")), ["k"]))
    assert all(united[k] == pytest.approx(a[k] + b[k] - shared.get(k, 0.0), rel=1e-9) for k in a)
    # every star clipped to all of the others' union has what it shares with its own partner
    clipped = area(overlay.clipped(one, two.toDF("k", "geometry")))
    assert all(clipped[k] == pytest.approx(shared.get(k, 0.0), abs=1e-8) for k in a)


def test_repairs(spark):
    tie = [(0, 0), (1, 1), (1, 0), (0, 1)]
    rows = [("tie", [tie]), ("good", HOLED), ("wrong way", [square(0, 0), list(reversed(square(0.25, 0.25, 0.5)))]), ("spike", [[(0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (1, 0)]]), ("flat", [[(0, 0), (1, 1), (2, 2)]]), ("twice", [square(0, 0, 2), square(1, 1, 2)])]
    df = overlay.with_soundness(raw(spark, rows), "before")
    assert {r.id: r.before for r in df.collect()} == {"tie": False, "good": True, "wrong way": True, "spike": False, "flat": False, "twice": False}
    done = overlay.repaired(df)
    got = measures(done, "id")
    assert {k[0]: v for k, v in got.items()} == {"tie": (0.5, 2, 2), "good": (12.0, 1, 2), "wrong way": (0.75, 1, 2), "spike": (1.0, 1, 1), "flat": (0.0, 0, 0), "twice": (6.0, 2, 2)}
    assert all(r.after or r.id == "flat" for r in overlay.with_soundness(done, "after").collect())


def test_clips(spark):
    ell = [(0, 0), (0, 3), (1, 3), (1, 1), (3, 1), (3, 0)]
    df = polygons(spark, [("all", [square(-1, -1, 9)]), ("own", [ell]), ("bar", [[(0.5, 2), (4, 2), (4, 2.5), (0.5, 2.5)]]), ("out", [square(1.5, 1.5)]), ("in", [square(0.25, 0.25, 0.5)]), ("far", [square(50, 50)]), ("edge", [square(1, 1)])])
    masks = polygons(spark, [("m", [ell])])
    got = measures(overlay.clipped(df.withColumn("w", F.lit("kept")), masks), "id", "w")
    assert {k[0]: v[0] for k, v in got.items()} == {"all": 5.0, "own": 5.0, "bar": 0.25, "out": 0.0, "in": 0.25, "far": 0.0, "edge": 0.0}
    comb = polygons(spark, [("comb", [[(0, 0), (0, 2), (1, 2), (1, 0.5), (2, 0.5), (2, 2), (3, 2), (3, 0)]])])
    top = measures(overlay.clipped(comb, polygons(spark, [("m", [[(-1, 1), (9, 1), (9, 9), (-1, 9)]])])), "id")
    assert top[("comb",)] == (2.0, 2, 2)  # two teeth, kept apart
    hole = measures(overlay.clipped(polygons(spark, [("s", [square(0, 0, 4)]), ("i", [square(1.5, 1.5)])]), polygons(spark, [("m", HOLED)])), "id")
    assert hole[("s",)] == (12.0, 1, 2) and hole[("i",)][0] == 0.0
    assert overlay.clipped(df, masks.where("false")).select(F.sum(shapes.area(F.col("geometry")))).first()[0] == 0.0


def edges_of(*rings):
    ends = [(*a, *b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)]
    return list(map(list, zip(*ends, strict=True)))


def test_borders_that_do_not_close_are_an_error():
    outline = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    assert assemble(chain_rings(*edges_of(outline))) == [[[0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0]]]
    with pytest.raises(ValueError):  # an edge is missing
        chain_rings(*[c[:-1] for c in edges_of(outline)])
    with pytest.raises(ValueError):  # a hole without an outline
        assemble(chain_rings(*edges_of(outline[::-1])))


def test_a_hole_that_touches_its_outline_is_a_ring_of_its_own():
    outline, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)], [(4.0, 4.0), (1.0, 2.0), (2.0, 1.0)]
    found = chain_rings(*edges_of(outline, hole))
    assert sorted(map(len, found)) == [4, 5] and [len(p) for p in assemble(found)] == [2]
    # two holes that touch each other
    holes = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)], [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0)]
    found = chain_rings(*edges_of(outline, *holes))
    assert sorted(map(len, found)) == [5, 5, 5] and [len(p) for p in assemble(found)] == [3]


def test_ways_out_that_are_nearly_one_are_told_apart():
    """Two slivers that meet in a corner where angles differ by less than a cosine can tell."""
    one, two = [(0.0, 0.0), (8.0, 4e-9), (8.0, 3e-9)], [(0.0, 0.0), (8.0, 2e-9), (8.0, 1e-9)]
    before = [(-8.0, 1.0), (0.0, 0.0), (-8.0, -1.0)]
    found = chain_rings(*edges_of(before, one, two))
    assert sorted(sorted(set(r)) for r in found) == sorted(sorted(r) for r in (before, one, two))


#: Nearly on one line: cuts move edges over corners beside them, which the first cuts didn't know of.
NEAR_A_LINE = [
    (8.236381035683019, 3.0473840553514764),
    (6.294487810273049, 2.3289604898078835),
    (3.720648999846853, 1.376640129939392),
    (2.4639675660370717, 0.9116679994341564),
    (9.280617067835262, 3.4338283150982742),
    (3.6785538162231624, 1.3610649120024632),
    (1.8623064832411518, 0.6890533987983538),
    (1.0617368472159516, 0.3928426335461413),
    (8.259327462242803, 3.0559511610291126),
    (8.888100878189704, 3.2885966454329423),
]


def test_a_repair_has_all_of_its_borders(spark):
    """Cuts are repeated until nothing meets; the area is that between the edges, worked out in fractions."""
    done = overlay.with_soundness(overlay.repaired(raw(spark, [("line", [NEAR_A_LINE])])), "after")
    row = done.select("after", shapes.area(F.col("geometry")).alias("area"), "geometry.polygons").first()
    assert row.after and row.area == pytest.approx(even_odd_area(NEAR_A_LINE), abs=1e-9)
    for polygon in row.polygons:
        for r in polygon:
            corners = [(p.x, p.y) for p in r]
            assert corners[0] == corners[-1] and len(set(corners)) == len(corners) - 1


def even_odd_area(points):
    """What an odd number of edges lie above, strip by strip between all corners and crossings."""
    points = [(Fraction(x), Fraction(y)) for x, y in points]
    lines = [(a, b) if a < b else (b, a) for a, b in zip(points, [*points[1:], points[0]], strict=True) if a[0] != b[0]]
    slope = lambda e: (e[1][1] - e[0][1]) / (e[1][0] - e[0][0])
    at = lambda e, x: e[0][1] + (x - e[0][0]) * slope(e)
    places = {x for x, _ in points}
    for e in lines:
        for f in lines:
            if slope(e) != slope(f):
                places.add(e[0][0] + (at(f, e[0][0]) - e[0][1]) / (slope(e) - slope(f)))
    total, places = Fraction(0), sorted(places)
    for low, high in zip(places, places[1:], strict=False):
        heights = sorted(at(e, (low + high) / 2) for e in lines if e[0][0] <= low and high <= e[1][0])
        total += (high - low) * sum((b - a for a, b in zip(heights[::2], heights[1::2], strict=True)), Fraction(0))
    return float(total)


def test_parts_of_a_repair_are_counted(spark, data_dir):
    """Two squares less what both have meet in corners only: two parts, and no number that is given beforehand."""
    from evenground.plans import catalogue

    rows = catalogue.queries()["repaired_crossings"](spark, data_dir).where("p_partkey % 4 = 2").select("parts").distinct().collect()
    assert [r.parts for r in rows] == [2]
