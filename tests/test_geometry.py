import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenground.operators import estimate as E
from evenground.operators.geometry import crs, shapes
from evenground.operators.geometry.dissolve import dissolve
from evenground.operators.geometry.overlap import boxes, candidate_pairs, overlaps
from evenground.plans.meta import Variable
from tests import erosion_by_hand as erosion


def ring(points):
    points = [*points, points[0]]
    return [{"x": float(x), "y": float(y)} for x, y in points]


def polygons(spark, rows, name="id"):
    """(id, [rings of points])"""
    data = [(i, {"srid": 0, "polygons": [[ring(r) for r in rings]]}) for i, rings in rows]
    raw = spark.createDataFrame(data, f"{name} string, geometry {shapes.TYPE}")
    return raw.withColumn("geometry", shapes.normalized(F.col("geometry")))


def square(x, y, side=1.0):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


HOLED = [square(0, 0, 4), square(1, 1, 2)]
CASES = [
    ([square(0, 0)], [square(0.5, 0.5)], 0.25),
    (HOLED, [square(0, 0, 4)], 12.0),
    ([[(0, 0), (0, 3), (1, 3), (1, 1), (3, 1), (3, 0)]], [[(1.5, -1), (-0.5, 1.2), (1.4, 2.7), (2.9, 0.9)]], 3.394841),
]


@pytest.mark.parametrize(("a", "b", "area"), CASES)
def test_intersection_areas(spark, a, b, area):
    one, two = polygons(spark, [("a", a)], "a"), polygons(spark, [("b", b)], "b")
    assert overlaps(one, two, "a", "b").first().overlap == pytest.approx(area, abs=1e-5)
    assert overlaps(two, one, "b", "a").first().overlap == pytest.approx(area, abs=1e-5)


def test_inside_a_hole_nothing_is_shared(spark):
    assert overlaps(polygons(spark, [("a", HOLED)], "a"), polygons(spark, [("b", [square(1.5, 1.5)])], "b"), "a", "b").count() == 0


def test_touching_counts_as_meeting(spark):
    got = overlaps(polygons(spark, [("a", [square(0, 0)])], "a"), polygons(spark, [("b", [square(1, 0)]), ("c", [square(3, 3)])], "b"), "a", "b").collect()
    assert [(r.b, r.overlap) for r in got] == [("b", 0.0)]


def test_areas_orientation_and_checks(spark):
    df = polygons(spark, [("h", HOLED), ("s", [list(reversed(square(2, 2, 3)))])])
    assert {r.id: r.a for r in df.select("id", shapes.area(F.col("geometry")).alias("a")).collect()} == {"h": 12.0, "s": 9.0}
    assert df.where(shapes.has_sound_rings(F.col("geometry"))).count() == 2
    box = df.where("id = 's'").select(shapes.bbox(F.col("geometry")).alias("b")).first().b
    assert (box.x0, box.y0, box.x1, box.y1) == (2.0, 2.0, 5.0, 5.0)


def test_dissolve_cancels_shared_borders(spark):
    grid = [(f"{i}", [square(i % 3, i // 3)]) for i in range(9) if i != 4]
    out = dissolve(polygons(spark, grid).withColumn("g", F.lit("x")), ["g"])
    row = out.select(shapes.area(F.col("geometry")).alias("a"), F.size("geometry.polygons").alias("n"), F.size(F.col("geometry.polygons")[0]).alias("rings")).first()
    assert (row.a, row.n, row.rings) == (8.0, 1, 2)


def test_estimate_conserves_totals_and_marks_the_uncovered(spark):
    source = polygons(spark, [("s", [square(0, 0, 2)])], "s").withColumn("pop", F.lit(8.0)).withColumn("mean", F.lit(3.0))
    target = polygons(spark, [("left", [[(0, 0), (1, 0), (1, 2), (0, 2)]]), ("right", [[(1, 0), (2, 0), (2, 2), (1, 2)]]), ("far", [square(9, 9)]), ("next", [square(2, 0)])], "t")
    rows = [Variable("pop", "pop"), Variable("mean", "mean", rule="Average", parent="pop")]
    got = {r.t: (r.pop, r["mean"]) for r in E.estimate(target, source, rows, "t", "s").collect()}
    assert got["left"] == got["right"] == (pytest.approx(4.0), pytest.approx(3.0))
    assert got["far"] == (None, None) and got["next"][0] == 0.0


def test_largest_overlap(spark):
    source = polygons(spark, [("s", [square(0, 0)]), ("lone", [square(50, 50)])], "s")
    target = polygons(spark, [("b", [square(0.5, 0)]), ("a", [square(-0.5, 0)]), ("c", [square(0.9, 0)])], "t")
    got = E.tag_largest_overlap(source, target, "s", "t").collect()
    assert [(r.s, r.t, r.overlap_fraction) for r in got] == [("s", "a", pytest.approx(0.5))]


def test_area_checks(spark):
    one = polygons(spark, [("A1", [square(0, 0)]), ("A2", [square(5, 5)])], "a")
    two = polygons(spark, [("B1", [square(0, 0, 2)])], "b")
    units = spark.createDataFrame([("A1", "B1", "x", "m"), ("A2", None, "y", "m")], "a string, b string, common_id string, method string")
    got = {r.common_id: r for r in E.check_areas({"one": one, "two": two}, units).collect()}
    assert got["x"].max_log_ratio == pytest.approx(math.log(4)) and got["y"].max_log_ratio is None and got["x"].method == "m"
    assert E.check_two_areas(one, two, units).first().log_ratio == pytest.approx(-math.log(4))


def test_correspondence_from_geometry(spark):
    one = polygons(spark, [(f"a{i}", [square(i * 10, 0, 10)]) for i in range(4)], "a")
    two = polygons(spark, [("b0", [[(0.2, 0), (20.2, 0), (20.2, 10), (0.2, 10)]]), ("b1", [square(20.2, 0, 10)]), ("a3", [square(30, 0, 10)])], "b")
    got = E.estimate_correspondence({"x": one, "y": two}, {"x": "a", "y": "b"}, tolerance=1.0)
    assert {(r.a, r.b, r.common_id) for r in got.collect()} == {("a0", "b0", "a0"), ("a1", "b0", "a0"), ("a2", "b1", "a2"), ("a3", "a3", "a3")}
    with_ids = E.estimate_correspondence({"x": one, "y": two}, {"x": "a", "y": "b"}, "identifier", 1.0)
    assert {(r.a, r.method) for r in with_ids.collect()} == {("a0", "estimate"), ("a1", "estimate"), ("a2", "estimate"), ("a3", "identifier")}
    with pytest.raises(ValueError):
        E.geometric_pairs(one, one, "a", "a")


def edge_array(points):
    points = [*points, points[0]]
    return np.array([(*p, *q) for p, q in zip(points, points[1:], strict=False)], float)


@settings(max_examples=60, deadline=None)
@given(st.floats(-3, 13), st.floats(-3, 13), st.floats(0.5, 6), st.floats(0.1, 4))
def test_erosion_of_squares_is_exact(x, y, side, t):
    a, b = edge_array(square(0, 0, 10)), edge_array(square(x, y, side))
    gap = max(max(x, y) - (10 - t), t - min(x + side, y + side))
    if abs(gap) > 1e-6 and t < 4.999:
        assert erosion.reaches(a, t, b) == (gap < 0)


def rectangle(x0, y0, x1, y1):
    return edge_array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


@pytest.mark.parametrize("length", [1e3, 1e5, 1e6])
def test_long_strips_are_decided_exactly(length):
    a, b = rectangle(0, 0, length, 100), rectangle(0, 50, length, 150)
    assert erosion.reaches(a, 49.99, b) and erosion.reaches(b, 49.99, a) and erosion.reaches(a, 49.9, b)
    assert erosion.reaches(a, 50, b) and not erosion.reaches(a, 50.01, b)  # the eroded strip is a line on b's border
    assert not erosion.reaches(a, 49.99, rectangle(0, 50.02, length, 150))


def star(draw, x, y, size):
    angles = np.sort(draw.uniform(0, 2 * np.pi, draw.integers(3, 13)))
    radii = size * draw.uniform(0.2, 1, len(angles))
    return edge_array([(x + r * math.cos(t), y + r * math.sin(t)) for r, t in zip(radii, angles, strict=True)])


def deepest(a, b):
    """The largest distance to a's outline among grid points in both, and the width of a grid cell's diagonal."""
    low, high = a.reshape(-1, 2).min(axis=0), a.reshape(-1, 2).max(axis=0)
    x, y = np.meshgrid(*(np.linspace(low[k], high[k], 150) for k in (0, 1)))
    points = np.stack([x.ravel(), y.ravel()], axis=1)
    points = points[erosion._inside(points, a) & (erosion._inside(points, b) if b is not None else True)]
    d = a[:, 2:] - a[:, :2]
    w = points[:, None, :] - a[None, :, :2]
    along = np.clip((w * d).sum(axis=2) / (d**2).sum(axis=1), 0, 1)
    gaps = np.sqrt(((w - along[:, :, None] * d) ** 2).sum(axis=2)).min(axis=1)
    return gaps.max(initial=0.0), float(np.hypot(*(high - low))) / 149


def test_stars_and_holes_against_a_grid():
    draw = np.random.default_rng(4)
    for k in range(60):
        a = star(draw, 0, 0, 10)
        if k % 4 == 0:
            a = np.concatenate([a, star(draw, 0, 0, 1.5)])
        for b in (star(draw, *draw.uniform(-6, 6, 2), draw.uniform(1, 8)), None):
            most, cell = deepest(a, b)
            for t in (most * 0.3, most * 0.9, most * 1.2 + cell, most * 2 + cell):
                if 0 < t <= most or t > most + cell:
                    assert erosion.reaches(a, t, b) == (t <= most)


def rings_of(edges):
    """An edge array of closed rings as rings of points."""
    rings, start = [], 0
    for i in range(len(edges)):
        if i + 1 == len(edges) or tuple(edges[i, 2:]) != tuple(edges[i + 1, :2]):
            rings.append([tuple(e[:2]) for e in edges[start : i + 1]])
            start = i + 1
    return rings


def test_eroded_polygons_meet_as_by_hand(spark):
    draw = np.random.default_rng(8)
    one, two, want = [], [], set()
    for k in range(70):
        a = star(draw, 0, 0, 10)
        if k % 4 == 0:
            a = np.concatenate([a, star(draw, 0, 0, 1.0)[::-1][:, [2, 3, 0, 1]]])
        b = star(draw, *draw.uniform(-9, 9, 2), draw.uniform(1, 8))
        place = np.tile([1000.0 * (k % 10), 1000.0 * (k // 10)], 2)
        one.append((f"a{k}", rings_of(a + place)))
        two.append((f"b{k}", rings_of(b + place)))
        if any(erosion.reaches(x, erosion.effective_tolerance(x, 1.5), y) for x, y in ((a, b), (b, a))):
            want.add((f"a{k}", f"b{k}"))
    got = E.geometric_pairs(polygons(spark, one, "a"), polygons(spark, two, "b"), "a", "b", 1.5)
    assert {(r.a, r.b) for r in got.collect()} == want and 10 < len(want) < 65


def test_strips_meet_by_hundredths(spark):
    one = polygons(spark, [(f"a{k}", [[(0, y), (length, y), (length, y + 100), (0, y + 100)]]) for k, (y, length) in enumerate([(0, 1e3), (1000, 1e6), (2000, 1e6)])], "a")
    two = polygons(spark, [(f"b{k}", [[(0, y), (1e6, y), (1e6, y + 100), (0, y + 100)]]) for k, y in enumerate([50, 1050, 2050.02])], "b")
    for tolerance, want in ((49.99, {("a0", "b0"), ("a1", "b1")}), (50.0, {("a0", "b0"), ("a1", "b1")}), (49.9, {("a0", "b0"), ("a1", "b1"), ("a2", "b2")})):
        assert {(r.a, r.b) for r in E.geometric_pairs(one, two, "a", "b", tolerance).collect()} == want


def round_shape(corners, size, x=0.0, y=0.0, bumps=0.0):
    t = 2 * math.pi * np.arange(corners) / corners
    r = size * (1 + bumps * np.cos(60 * t))
    return [(float(x + a * math.cos(b)), float(y + a * math.sin(b))) for a, b in zip(r, t, strict=True)]


def test_polygons_of_ten_thousand_corners(spark):
    n = 10_000
    one = polygons(spark, [("a", [round_shape(n, 100.0, bumps=0.05)]), ("c", [round_shape(n, 100.0, 500.0)])], "a")
    two = polygons(spark, [("b", [round_shape(n, 100.0, 197.0, bumps=0.05)]), ("d", [round_shape(n, 50.0, 500.0)])], "b")
    area = n / 2 * math.sin(2 * math.pi / n)
    shared = {(r.a, r.b): r.overlap for r in overlaps(one, two, "a", "b").collect()}
    assert shared["c", "d"] == pytest.approx(2500 * area, rel=1e-9)
    assert shared["a", "b"] == pytest.approx(overlaps(two, one, "b", "a").where("a = 'a'").first().overlap, rel=1e-9)
    few = lambda df, key: df.where(f"{key} in ('a', 'b')")
    from evenground.operators.geometry import overlap as module

    based = module.with_geometries(candidate_pairs(boxes(few(one, "a"), "a"), boxes(few(two, "b"), "b")), one, two, "a", "b")
    based = based.withColumns({f"{k}{i}": (F.greatest if i == 0 else F.least)(f"ba.{k}{i}", f"bb.{k}{i}") for k in "xy" for i in (0, 1)})
    based = based.withColumns({"sphere": F.lit(False), "base": F.least("ba.y0", "bb.y0"), "es": module._facing("ga", "x0", "x1", "x"), "fs": module._facing("gb", "x0", "x1", "x")})
    assert module._in_slabs(based, "a", "b").count() < 40 * n
    assert {(r.a, r.b) for r in E.geometric_pairs(one, two, "a", "b", 4.0).collect()} == {("a", "b"), ("c", "d")}
    assert {(r.a, r.b) for r in E.geometric_pairs(one, two, "a", "b", 12.0).collect()} == {("c", "d")}


def test_stacked_edges_are_swept_along_the_other_axis(spark):
    teeth = 300
    left = [(0.0, 0.0), *[p for i in range(teeth) for p in ((100.0, i + 0.25), (1.0, i + 0.75))], (0.0, float(teeth))]
    right = [(101.0, 0.0), *[p for i in range(teeth) for p in ((1.5, i + 0.5), (100.0, i + 1.0))], (101.0, float(teeth))]
    one, two = polygons(spark, [("a", [left])], "a"), polygons(spark, [("b", [right])], "b")
    straight = overlaps(one, two, "a", "b", direct=10**9).first().overlap
    assert overlaps(one, two, "a", "b").first().overlap == pytest.approx(straight, rel=1e-9) and straight > 0


def test_touching_without_a_tolerance():
    assert erosion.reaches(rectangle(0, 0, 1, 1), 0.0, rectangle(1, 0, 2, 1)) and not erosion.reaches(rectangle(0, 0, 1, 1), 0.0, rectangle(1.01, 0, 2, 1))
    assert erosion.reaches(rectangle(0, 0, 9, 9), 0.0, rectangle(4, 4, 5, 5)) and erosion.reaches(rectangle(4, 4, 5, 5), 0.0, rectangle(0, 0, 9, 9))


def test_a_huge_polygon_among_small_ones_makes_few_rows(spark):
    small = [(f"s{i}", [square(i % 50 * 3, i // 50 * 3)]) for i in range(1000)]
    one = polygons(spark, [*small, ("huge", [square(-1e6, -1e6, 2e6)])], "a")
    two = polygons(spark, [*small, ("point", [square(7.5, 7.5, 1e-7)])], "b")
    pairs = candidate_pairs(boxes(one, "a"), boxes(two, "b")).select("a", "b").collect()
    assert len(pairs) == len(set(pairs)) == 2001
    assert {p.a for p in pairs if p.b == "point"} == {"huge"}
    got = {(r.a, r.b): r.overlap for r in overlaps(one, two, "a", "b").collect()}
    assert got[("huge", "s999")] == pytest.approx(1.0, rel=1e-3)


def test_sound_clipped_and_spherical(spark):
    df = polygons(spark, [("h", HOLED)])
    mask = shapes.rectangle(F.lit(2.0), F.lit(-1.0), F.lit(9.0), F.lit(9.0))
    assert df.select(shapes.area(shapes.clip_convex(F.col("geometry"), mask))).first()[0] == pytest.approx(6.0)
    far = shapes.rectangle(F.lit(50.0), F.lit(50.0), F.lit(51.0), F.lit(51.0))
    assert df.select(shapes.area(shapes.clip_convex(F.col("geometry"), far))).first()[0] == 0.0
    ell = shapes.polygon([(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (0, 3), (1, 3), (1, 1), (3, 1), (3, 0))])
    with pytest.raises(Exception, match="isn't convex"):
        df.select(shapes.area(shapes.clip_convex(F.col("geometry"), ell))).collect()
    octant = shapes.polygon([(F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(90.0)), (F.lit(90.0), F.lit(0.0))], shapes.LONLATS[0])
    assert spark.range(1).select(shapes.area(octant)).first()[0] == pytest.approx(math.pi / 2 * shapes.EARTH_RADIUS**2)


def test_tolerance_is_halved_until_something_is_left():
    assert erosion.effective_tolerance(edge_array(square(0, 0, 1)), 3.0) == 0.375


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(-123.1, 49.25), (-63.6, 44.6)], "x double, y double").select(F.struct("x", "y").alias("p"))
    got = df.select("p", crs.project_point(F.col("p"), 3347).alias("q")).select("p", "q", crs.unproject_point(F.col("q"), 3347).alias("r")).collect()
    for row in got:
        assert row.r.x == pytest.approx(row.p.x, abs=1e-8) and row.r.y == pytest.approx(row.p.y, abs=1e-8)
    origin = spark.range(1).select(crs.project_point(shapes.point(F.lit(-91.86666666666666), F.lit(63.390675)), 3347).alias("q")).first().q
    assert (origin.x, origin.y) == (pytest.approx(6200000), pytest.approx(3000000))


def test_published_points(spark):
    clarke, airy = (6378206.4, 1 / 294.9786982), (6377563.396, 1 / 299.3249646)
    cases = [
        (crs.Albers(29.5, 45.5, 23, -96, ellipsoid=clarke), (-75, 35), (1885472.7, 1535925.0), 0.06),
        (crs.TransverseMercator(-75, 0, 0.9996, 500000, 0, clarke), (-73.5, 40.5), (500000 + 127106.5, 4484124.4), 0.06),
        (crs.TransverseMercator(-2, 49, 0.9996012717, 400000, -100000, airy), (0.5, 50.5), (577274.98, 69740.49), 0.006),
        (crs.Conic(33, 45, 23, -96, ellipsoid=clarke), (-75, 35), (1894410.9, 1564649.5), 0.06),
    ]
    for system, (lon, lat), (x, y), miss in cases:
        q = system.project(shapes.point(F.lit(float(lon)), F.lit(float(lat))))
        row = spark.range(1).select(q.alias("q")).select("q", system.unproject(F.col("q")).alias("p")).first()
        assert (row.q.x, row.q.y) == (pytest.approx(x, abs=miss), pytest.approx(y, abs=miss))
        assert (row.p.x, row.p.y) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))


def test_systems_are_reconciled_or_refused(spark):
    x, y = F.lit(6200000.0), F.lit(3000000.0)
    one = spark.range(1).select(F.lit("a").alias("a"), shapes.rectangle(x, y, x + 100, y + 100, 3347).alias("geometry"))
    two = spark.range(1).select(F.lit("b").alias("b"), crs.transform(shapes.rectangle(x + 40, y, x + 140, y + 100, 3347), 3347, 4326).alias("geometry"))
    moved = crs.reconciled(one, two)
    assert overlaps(*moved, "a", "b").first().overlap == pytest.approx(6000, rel=1e-6)
    assert E.tag_largest_overlap(one, two, "a", "b").first().overlap_fraction == pytest.approx(0.6, rel=1e-6)
    assert E.geometric_pairs(one, two, "a", "b", 5.0).count() == 1
    with pytest.raises(ValueError, match="no reference system"):
        crs.reconciled(one, two.withColumn("geometry", F.struct(F.lit(0).alias("srid"), F.col("geometry.polygons").alias("polygons"))))


def test_shares_on_the_sphere_add_up(spark):
    lon = lambda *p: shapes.polygon([(F.lit(float(x)), F.lit(float(y))) for x, y in p], 4326)
    quad = [(-10, 50), (-12, 62), (30, 64), (28, 51)]
    source = spark.range(1).select(F.lit("s").alias("s"), F.lit(1.0).alias("n"), lon(*quad).alias("geometry"))
    cuts = [lon(quad[0], quad[1], quad[2]).alias("a"), lon(quad[0], quad[2], quad[3]).alias("b")]
    target = spark.range(1).select(F.explode(F.array(*cuts)).alias("geometry")).withColumn("t", F.monotonically_increasing_id())
    shared = overlaps(target.select("t", "geometry"), source.select("s", "geometry"), "t", "s")
    whole = source.select(shapes.area(F.col("geometry"))).first()[0]
    parts = {r.t: r.a for r in target.select("t", shapes.area(F.col("geometry")).alias("a")).collect()}
    got = {r.t: r.overlap for r in shared.collect()}
    assert sum(got.values()) == pytest.approx(whole, rel=1e-9) and all(got[t] == pytest.approx(a, rel=1e-9) for t, a in parts.items())
    # the northern side bulges beyond its corners: a strip above them shares area
    strip = spark.range(1).select(F.lit("t").alias("t"), lon((5, 64.2), (5, 70), (12, 70), (12, 64.2)).alias("geometry"))
    assert overlaps(strip, source.select("s", "geometry"), "t", "s").first().overlap > 0


def test_translated_units(spark):
    one = polygons(spark, [("A", [[(0, 0), (2, 0), (2, 1), (0, 1)]]), ("S", [square(5, 5)])], "id")
    two = polygons(spark, [("x", [square(0, 0)]), ("y", [square(1, 0)]), ("S", [square(5, 5)])], "id").withColumn("n", F.lit(2))
    assert {(r.id, r.n) for r in E.translate_units(one, two, "id", ["n"]).collect()} == {("A", 4), ("S", 2)}
