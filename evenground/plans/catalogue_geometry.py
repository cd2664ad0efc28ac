"""Registered queries of polygon overlays, reference systems and overlaps of polygons with many corners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.operators import estimate
from evenground.operators.geometry import crs, dissolve, overlay, shapes
from evenground.operators.geometry.overlap import overlaps
from evenground.plans import meta
from evenground.runtime import read_spread, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _number(expression: str) -> Column:
    return F.expr(f"cast({expression} as double)")


# --- unions, repairs, clips ---


@_query(
    """WITH r AS (SELECT p_partkey // 12 AS g, p_partkey * 7 % 40 AS x0, p_partkey * 7 % 40 + 1 + p_size % 4 AS x1 FROM part),
    m AS (SELECT *, MAX(x1) OVER (PARTITION BY g ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    i AS (SELECT *, SUM(CASE WHEN before IS NULL OR x0 > before THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT g, island, MAX(x1) - MIN(x0) AS wide FROM i GROUP BY 1, 2)
    SELECT g, CAST(SUM(wide) * 2 AS double) AS area, CAST(COUNT(*) AS integer) AS parts FROM u GROUP BY 1"""
)
def union_of_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve rectangles of a row, which overlap, hold, touch or miss each other, as one geometry."""
    x = _number("p_partkey * 7 % 40")
    rows = read_spread(spark, sf_dir, "part").select(F.expr("p_partkey div 12").alias("g"), shapes.rectangle(x, F.lit(0.0), x + _number("1 + p_size % 4"), F.lit(2.0)).alias("geometry"))
    done = dissolve.dissolve(rows, ["g"])
    return done.select("g", F.round(shapes.area(F.col("geometry")), 9).alias("area"), F.size("geometry.polygons").alias("parts"))


@_query("SELECT s_suppkey, CAST(4.0 * (1 + s_suppkey % 3) * (1 + s_suppkey % 3) AS double) AS area, CAST(1 AS integer) AS parts FROM supplier")
def union_of_unlike_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of three parts, one of which has a corner in the middle of another's side."""
    side = _number("2 * (1 + s_suppkey % 3)")
    half, x = side / 2, _number("s_suppkey * 10")
    three = F.array(
        shapes.rectangle(x, F.lit(0.0), x + half, side), shapes.rectangle(x + half, F.lit(0.0), x + side, half), shapes.rectangle(x + half, half, x + side, side)
    )
    rows = read_spread(spark, sf_dir, "supplier").select("s_suppkey", F.explode(three).alias("geometry"))
    done = dissolve.dissolve(rows, ["s_suppkey"])
    return done.select("s_suppkey", F.round(shapes.area(F.col("geometry")), 9).alias("area"), F.size("geometry.polygons").alias("parts"))


@_query(
    """SELECT p_partkey, p_partkey % 4 = 0 AS before, true AS after, CASE p_partkey % 4 WHEN 0 THEN a * a WHEN 1 THEN a * a / 2 WHEN 2 THEN 6 * a * a ELSE a * a END AS area,
    CAST(CASE WHEN p_partkey % 4 IN (1, 2) THEN 2 ELSE 1 END AS integer) AS parts FROM (SELECT p_partkey, CAST(1 + p_size % 7 AS double) AS a FROM part)"""
)
def repaired_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares; bow ties; two squares as rings of one polygon, which overlap (what is left of them meets in corners only); squares with a spike."""
    a = _number("1 + p_size % 7")
    ring = lambda *xy: F.array(*[shapes.point(a * x, a * y) for x, y in xy])
    one = ring((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))
    tie = ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))
    pair = [ring((0, 0), (0, 2), (2, 2), (2, 0), (0, 0)), ring((1, 1), (1, 3), (3, 3), (3, 1), (1, 1))]
    spike = ring((0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (1, 0), (0, 0))
    k = F.col("p_partkey") % 4
    polygons = F.when(k == 0, F.array(F.array(one))).when(k == 1, F.array(F.array(tie))).when(k == 2, F.array(F.array(*pair))).otherwise(F.array(F.array(spike)))
    raw = read_spread(spark, sf_dir, "part").select("p_partkey", F.struct(F.lit(0).alias("srid"), polygons.alias("polygons")).alias("geometry"))
    done = overlay.with_soundness(overlay.repaired(overlay.with_soundness(raw, "before")), "after")
    return done.select("p_partkey", "before", "after", F.round(shapes.area(F.col("geometry")), 9).alias("area"), F.size("geometry.polygons").alias("parts"))


@_query(
    """WITH p AS (SELECT p_partkey, CAST(p_partkey % 9 AS double) - 0.5 AS x, CAST(p_partkey // 9 % 9 AS double) - 0.25 AS y, CAST(1 + p_size % 3 AS double) AS s FROM part),
    m(x0, y0, x1, y1, w) AS (VALUES (0, 0, 7, 2, 1), (0, 2, 2, 7, 1), (0.5, 0.5, 1.5, 1.5, -1))
    SELECT p_partkey, ROUND(SUM(w * GREATEST(0, LEAST(x + s, x1) - GREATEST(x, x0)) * GREATEST(0, LEAST(y + s, y1) - GREATEST(y, y0))), 6) AS area FROM p CROSS JOIN m GROUP BY 1"""
)
def clip_to_any_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares clipped to an L with a hole."""
    x, y, s = _number("p_partkey % 9") - 0.5, _number("p_partkey div 9 % 9") - 0.25, _number("1 + p_size % 3")
    rows = read_spread(spark, sf_dir, "part").select("p_partkey", shapes.rectangle(x, y, x + s, y + s).alias("geometry"))
    ring = lambda *xy: F.array(*[shapes.point(F.lit(float(x)), F.lit(float(y))) for x, y in xy])
    corners = ring((0, 0), (0, 7), (2, 7), (2, 2), (7, 2), (7, 0), (0, 0)), ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5))
    # as many rows as regions, which are one mask when united
    masks = read_table(spark, sf_dir, "region").select(F.struct(F.lit(0).alias("srid"), F.array(F.array(*corners)).alias("polygons")).alias("geometry"))
    done = overlay.clipped(rows, masks)
    return done.select("p_partkey", F.round(shapes.area(F.col("geometry")), 6).alias("area"))


# --- polygons of many corners ---


def _wave(heights: Callable[[str], list[str]]) -> Column:
    """The polygon between the x axis and a line through ``teeth`` teeth; ``heights``: (x, y) texts of a tooth's corners from its number i."""
    points = F.flatten(F.transform(F.expr("sequence(0, teeth - 1)"), lambda i: F.array(*heights(i))))
    end = F.expr("cast(teeth as double)")
    ring = F.concat(F.array(shapes.point(F.lit(0.0), F.lit(0.0))), points, F.array(shapes.point(end, F.lit(1.0)), shapes.point(end, F.lit(0.0))))
    return shapes.normalized(F.struct(F.lit(0).alias("srid"), F.array(F.array(ring)).alias("polygons")))


@_query("SELECT c_nationkey, CAST(COUNT(*) AS integer) AS teeth, ROUND(CAST(COUNT(*) AS double) * 0.25 + 0.125, 6) AS overlap FROM customer GROUP BY 1")
def overlap_many_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saw blades per nation, one tooth per customer, shifted by half a tooth: they cross twice in every tooth."""
    teeth = read_spread(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("int").alias("teeth"))
    down = lambda i: [shapes.point(i, F.lit(1.0)), shapes.point(i + 0.5, F.lit(0.0))]
    up = lambda i: [shapes.point(i, F.lit(0.0)), shapes.point(i + 0.5, F.lit(1.0))]
    # the second blade's last half tooth is flat at the top
    one = teeth.select(F.col("c_nationkey").alias("a"), _wave(down).alias("geometry"))
    two = teeth.select(F.col("c_nationkey").alias("b"), _wave(up).alias("geometry"))
    apart = lambda df, key: df.withColumn("geometry", F.struct(F.col("geometry.srid").alias("srid"), F.transform("geometry.polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: shapes.point(q["x"], q["y"] + F.col(key) * 10)))).alias("polygons")))
    found = overlaps(apart(one, "a"), apart(two, "b"), "a", "b").where("a = b")
    return found.join(teeth.withColumnRenamed("c_nationkey", "a"), "a").select(F.col("a").alias("c_nationkey"), "teeth", F.round("overlap", 6).alias("overlap"))


# --- longitude and latitude, and systems that differ ---

_KM2 = "CAST({e} AS double) * 6371.01 * 6371.01"


def _under(one: str, two: str, width: str) -> str:
    """Area between the equator and the great circle over two latitudes (degrees), ``width`` degrees apart, on the unit sphere."""
    t = [f"TAN(RADIANS({x}) / 2)" for x in (one, two)]
    return f"(2 * ATAN2(TAN(RADIANS({width}) / 2) * ({t[0]} + {t[1]}), 1 + {t[0]} * {t[1]}))"


_MIDDLE = "DEGREES(ATAN((TAN(RADIANS({a})) + TAN(RADIANS({b}))) / (2 * COS(RADIANS(2.5)))))"


@_query(
    f"""WITH z AS (SELECT s_suppkey, s_nationkey, CAST(s_suppkey % 20 * 2 AS double) AS low, CAST(s_suppkey % 20 * 2 + 3 AS double) AS high FROM supplier),
    h AS (SELECT *, {_MIDDLE.format(a="low", b="low + 1")} AS low_mid, {_MIDDLE.format(a="high", b="high + 1")} AS high_mid FROM z),
    w AS (SELECT *, {_under("high", "high_mid", "2.5")} - {_under("low", "low_mid", "2.5")} AS west, {_under("high_mid", "high + 1", "2.5")} - {_under("low_mid", "low + 1", "2.5")} AS east FROM h)
    SELECT s_suppkey, ROUND(100 * west / (west + east), 6) AS west, ROUND(100 * east / (west + east), 6) AS east, ROUND({_KM2.format(e="(west + east)")}, 2) AS km2 FROM w"""
)
def sphere_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of longitude and latitude, five degrees wide, shared out to their western and eastern half by areas on the sphere."""
    x, low, high = _number("s_suppkey div 20 * 5"), _number("s_suppkey % 20 * 2"), _number("s_suppkey % 20 * 2 + 3")
    ends = lambda y: [(x, y), (x + 5, y + 1)]
    zone = shapes.polygon([*ends(low), *reversed(ends(high))], 4326)
    suppliers = read_spread(spark, sf_dir, "supplier")
    source = suppliers.select("s_suppkey", F.lit(100.0).alias("people"), zone.alias("geometry"))
    middle = lambda y: F.degrees(F.atan((F.tan(F.radians(y)) + F.tan(F.radians(y + 1))) / (2 * F.cos(F.radians(F.lit(2.5))))))
    west = shapes.polygon([(x, low), (x, high), (x + 2.5, middle(high)), (x + 2.5, middle(low))], 4326)
    east = shapes.polygon([(x + 2.5, middle(low)), (x + 2.5, middle(high)), (x + 5, high + 1), (x + 5, low + 1)], 4326)
    halves = F.array(F.struct(F.lit("west").alias("half"), west.alias("geometry")), F.struct(F.lit("east").alias("half"), east.alias("geometry")))
    target = suppliers.select("s_suppkey", F.explode(halves).alias("t")).select(F.concat_ws(" ", "s_suppkey", "t.half").alias("t_id"), F.col("s_suppkey").alias("k"), "t.half", "t.geometry")
    # zones of one column overlap, so the halves take from several: what each gets of its own zone is asked for
    own = source.select("s_suppkey", F.col("s_suppkey").alias("k"), "geometry")
    shared = overlaps(target.select("t_id", "k", "geometry"), own, "t_id", "s_suppkey", by=("k",)).join(target.select("t_id", "half"), "t_id")
    areas = source.select("s_suppkey", shapes.area(F.col("geometry")).alias("area"))
    told = shared.join(areas, "s_suppkey").groupBy("s_suppkey", "area").agg(*[F.sum(F.when(F.col("half") == h, F.col("overlap"))).alias(h) for h in ("west", "east")])
    return told.select("s_suppkey", *[F.round(100 * F.col(h) / F.col("area"), 6).alias(h) for h in ("west", "east")], F.round(F.col("area") / 1e6, 2).alias("km2"))


@_query("SELECT s_suppkey, CAST(1 + s_suppkey % 9 AS double) AS people FROM supplier")
def sphere_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two halves of a zone of longitude and latitude get of it adds up to what it has."""
    x, y = _number("s_suppkey % 30 * 4"), _number("s_suppkey div 30 % 30 * 2 - 30")
    corners = [(x, y), (x + 1.5, y + 1.5), (x + 4, y + 1), (x + 2, y)]
    rows = read_spread(spark, sf_dir, "supplier").withColumn("zone", F.expr("s_suppkey div 900"))
    lane = rows.where("zone = 0").select("s_suppkey", _number("1 + s_suppkey % 9").alias("people"), shapes.polygon(corners, 4326).alias("geometry"))
    more = rows.where("zone > 0").select("s_suppkey", _number("1 + s_suppkey % 9").alias("people"))
    halves = F.array(shapes.polygon([corners[0], corners[1], corners[2]], 4326), shapes.polygon([corners[0], corners[2], corners[3]], 4326))
    target = lane.select(F.col("s_suppkey").alias("k"), F.posexplode(halves).alias("half", "geometry")).withColumn("t", F.expr("k * 2 + half"))
    got = estimate.estimate(target.select("t", "k", "geometry"), lane, meta.meta_for_additive_variables("x", {"people": "people"}), "t", "s_suppkey")
    return got.groupBy(F.col("k").alias("s_suppkey")).agg(F.round(F.sum("people"), 6).alias("people")).unionByName(more)


_MIXED = """WITH a AS (SELECT s_suppkey AS k, 'a' || CAST(s_suppkey AS varchar) AS a FROM supplier), b AS (SELECT s_suppkey AS k, 'b' || CAST(s_suppkey AS varchar) AS b FROM supplier)
    SELECT a, b FROM a JOIN b ON (a.k = b.k) OR (b.k = a.k - 1 AND a.k % 50 <> 0)"""


@_query(_MIXED)
def mixed_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of ten metres in a conic plane, and ones three metres beside them in longitude and latitude: they are moved to the first's system."""
    s = read_spread(spark, sf_dir, "supplier")
    x, y = _number("s_suppkey % 50 * 10") + 6200000.0, _number("s_suppkey div 50 * 10") + 3000000.0
    one = s.select(F.concat(F.lit("a"), "s_suppkey").alias("a"), shapes.rectangle(x, y, x + 10, y + 10, 3347).alias("geometry"))
    beside = shapes.rectangle(x + 3, y, x + 13, y + 10, 3347)
    two = s.select(F.concat(F.lit("b"), "s_suppkey").alias("b"), crs.transform(beside, 3347, 4326).alias("geometry"))
    return estimate.geometric_pairs(one, two, "a", "b", 1.0).select("a", "b")


_E = "SQRT(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101))"
_Q = "((1 - e * e) * (SIN({x}) / (1 - e * e * SIN({x}) * SIN({x})) + LN((1 + e * SIN({x})) / (1 - e * SIN({x}))) / (2 * e)))"
_M2 = "(COS({x}) * COS({x}) / (1 - e * e * SIN({x}) * SIN({x})))"
_PLACE = "RADIANS(-120.0 + c_custkey % 50) AS lon, RADIANS(25.0 + c_custkey % 24) AS lat"


@_query(
    f"""WITH c AS (SELECT c_custkey, {_PLACE}, {_E} AS e FROM customer),
    q AS (SELECT *, {_Q.format(x="lat")} AS q, {_Q.format(x="RADIANS(23.0)")} AS q0, {_Q.format(x="RADIANS(29.5)")} AS q1, {_Q.format(x="RADIANS(45.5)")} AS q2, {_M2.format(x="RADIANS(29.5)")} AS m1, {_M2.format(x="RADIANS(45.5)")} AS m2 FROM c),
    n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n FROM q), r AS (SELECT *, 6378137.0 * SQRT(m1 + n * q1 - n * q) / n AS rho, 6378137.0 * SQRT(m1 + n * q1 - n * q0) / n AS rho0 FROM n)
    SELECT c_custkey, ROUND(rho * SIN(n * (lon - RADIANS(-96.0))), 2) AS x, ROUND(rho0 - rho * COS(n * (lon - RADIANS(-96.0))), 2) AS y FROM r"""
)
def project_equal_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.point(_number("-120 + c_custkey % 50"), _number("25 + c_custkey % 24"))
    moved = read_spread(spark, sf_dir, "customer").select("c_custkey", crs.project_point(p, 5070).alias("p"))
    return moved.select("c_custkey", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


_N = "(f / (2 - f))"
# Coefficients of the series in the third flattening.
_TERMS = ("n / 2 - 2 * n * n / 3 + 5 * POW(n, 3) / 16 + 41 * POW(n, 4) / 180", "13 * n * n / 48 - 3 * POW(n, 3) / 5 + 557 * POW(n, 4) / 1440", "61 * POW(n, 3) / 240 - 103 * POW(n, 4) / 140", "49561 * POW(n, 4) / 161280")
_SINH, _COSH = "((EXP({0}) - EXP(-({0}))) / 2)", "((EXP({0}) + EXP(-({0}))) / 2)"
_TM = f"""WITH c AS (SELECT c_custkey, RADIANS(-74.5 + c_custkey % 7 * 0.5 - (-75)) AS lon, SIN(RADIANS(30.0 + c_custkey % 31)) AS s, 1 / 298.257222101 AS f FROM customer),
    k AS (SELECT *, {_N} AS n, SQRT(f * (2 - f)) AS e FROM c),
    t AS (SELECT *, 0.5 * LN((1 + s) / (1 - s)) - e * 0.5 * LN((1 + e * s) / (1 - e * s)) AS psi FROM k),
    z AS (SELECT *, ATAN2({_SINH.format("psi")}, COS(lon)) AS xi, ASINH(SIN(lon) / SQRT({_SINH.format("psi")} * {_SINH.format("psi")} + COS(lon) * COS(lon))) AS eta FROM t),
    m AS (SELECT *, 0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + POW(n, 4) / 64) AS radius FROM z)
    SELECT c_custkey, ROUND(500000 + radius * (eta + {" + ".join(f"({c}) * COS({2 * k} * xi) * {_SINH.format(f'{2 * k} * eta')}" for k, c in enumerate(_TERMS, 1))}), 3) AS x,
        ROUND(radius * (xi + {" + ".join(f"({c}) * SIN({2 * k} * xi) * {_COSH.format(f'{2 * k} * eta')}" for k, c in enumerate(_TERMS, 1))}), 3) AS y FROM m"""


@_query(_TM)
def project_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone 18."""
    p = shapes.point(_number("-74.5 + c_custkey % 7 * 0.5"), _number("30 + c_custkey % 31"))
    moved = read_spread(spark, sf_dir, "customer").select("c_custkey", crs.project_point(p, 26918).alias("p"))
    return moved.select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
