"""Plans that stay bounded on larger tables: terms worked out once, joins that gather nothing, rows dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from evenground.operators import aggregate, reshape
from evenground.operators.geometry import arrangement, overlap, shapes
from evenground.operators.geometry.overlap import boxes, candidate_pairs
from evenground.runtime import FEW_ROWS, read_spread, stored
from evenground.sources import census_us, geometries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rings_are_closed_once(spark):
    told = plan(spark.createDataFrame([], f"geometry {shapes.TYPE}").select(shapes.normalized(F.col("geometry")).alias("g")))
    assert told.count("concat(") == 1


def test_texts_and_clips_are_worked_out_once(spark):
    texts = spark.createDataFrame([("POLYGON ((0 0, 0 4, 4 4, 4 0))",)], "wkt string")
    round_trip = geometries.from_wkt(geometries.to_wkt(geometries.from_wkt(F.col("wkt"))))
    box = shapes.rectangle(F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(3.0))
    found = texts.select(shapes.area(shapes.clip_convex(round_trip, box)).alias("area"))
    assert plan(found).count("regexp_replace(") == 2
    assert found.first().area == pytest.approx(6.0)


def test_many_stored_rows_are_not_broadcast(spark):
    many = stored(spark.range(FEW_ROWS + 1).select("id", F.lit(1.0).alias("x")))
    few = stored(spark.range(10))
    assert "Broadcast" not in executed(many.join(many.select("id"), "id"))
    assert "BroadcastHashJoin" in executed(many.select("id", "x").join(F.broadcast(few), "id"))


def test_many_boxes_are_not_broadcast_and_few_are(spark):
    square = shapes.rectangle(F.col("id") % 100, F.expr("id div 100"), F.col("id") % 100 + 1, F.expr("id div 100 + 1"))
    table = lambda n, key: stored(boxes(spark.range(n).select(F.col("id").alias(key), square.alias("geometry")), key))
    many, others, few = table(FEW_ROWS + 1, "a"), table(FEW_ROWS + 1, "b"), table(3, "b")
    assert "Broadcast" not in executed(candidate_pairs(many, others))
    assert executed(candidate_pairs(many, few)).count("BroadcastHashJoin") == 2
    assert candidate_pairs(many, few).count() == 4 + 6 + 6


def test_cuts_are_not_worked_out_in_a_filter(spark):
    rows = [(0, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 1.0, 1.0, 0.0), (2, 5.0, 5.0, 6.0, 5.0)]
    crossing = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    cuts, _ = arrangement.meetings(crossing, None, 2.0**-40, ())
    assert "rint" not in plan(cuts).lower()
    assert {r.id: [tuple(p) for p in r.cuts] for r in cuts.collect()} == {0: [(0.5, 0.5)], 1: [(0.5, 0.5)]}


def test_a_small_file_of_many_rows_is_dealt_to_the_cores(spark, tmp_path):
    spark.range(30_000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spread = read_spread(spark, str(tmp_path), "part")
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread.count() == 30_000


def test_long_unit_names_are_not_shuffled_to_refuse_an_id(spark):
    rows = [("a", "1", "a:a"), ("a", "2", "a:a")]
    twice = spark.createDataFrame(rows, "a string, common_id string, common_uid string")
    df = spark.createDataFrame([("a", 1)], "a string, v int")
    with pytest.raises(ValueError):
        aggregate.join_correspondence(df, twice)
    with pytest.raises(ValueError):  # one common_id, two names
        aggregate.join_correspondence(df, spark.createDataFrame([("a", "1", "a:a"), ("a", "1", "a:b")], twice.schema))
    seen = []

    def repeated(df, keys, found=aggregate.repeated):
        seen.append(df.columns)
        return found(df, keys)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(aggregate, "repeated", repeated)
        aggregate.join_correspondence(df, spark.createDataFrame([("a", "1", "a:a")], twice.schema))
    assert seen == [["a", "common_id"], ["a", "common_id", "_uid"]]


def test_pairs_of_a_heavy_key_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(reshape, "BLOCK_ROWS", 50)
    left = spark.range(20).select(F.col("id").alias("a"), (F.col("id") % 2).alias("k"))
    right = spark.range(1000).select(F.col("id").alias("b"), (F.col("id") % 2).alias("k"))
    found = reshape.all_matches(left, right, "k")
    assert sorted(map(tuple, found.select("a", "b").collect())) == sorted((a, b) for a in range(20) for b in range(1000) if a % 2 == b % 2)
    assert "_block" in executed(found) and "Broadcast" not in executed(found)
    none = right.where("b < 0")
    assert reshape.all_matches(left, none, "k").count() == 0


def test_pieces_of_a_mask_of_few_edges_go_to_where_the_many_rows_are(spark):
    many = spark.range(FEW_ROWS + 1).selectExpr("id as _row", "cast(id % 5 as double) as x1", "0d as y1", "cast(id % 5 + 1 as double) as x2", "0d as y2", "1 as w")
    few = spark.createDataFrame([(0.0, 1.0, 6.0, 1.0, 1)], "x1 double, y1 double, x2 double, y2 double, m int")
    rows, mask = stored(arrangement.pieces(many, ["_row"], ["w"])), stored(arrangement.pieces(few, [], ["m"]))
    ends = ["x1", "y1", "x2", "y2"]
    over, under = arrangement.covered(rows, mask, ["_row", *ends], [], ["m"]), arrangement.covered(mask, rows, ends, ["_row"], ["w"])
    for found in (over, under):
        assert "BroadcastHashJoin" in executed(found) and "SortMergeJoin" not in executed(found)
    assert over.where("m_up = 1").count() == FEW_ROWS + 1
    assert under.where("w_up <> 0").count() == 0 < under.count()


def test_edges_that_share_an_end_are_not_paired(spark, monkeypatch):
    ring = [(0.0, 0.0, 0.0, 1.0), (0.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 0.0), (1.0, 0.0, 0.0, 0.0), (0.5, -1.0, 0.5, 0.5)]
    placed = spark.createDataFrame([(i, *e) for i, e in enumerate(ring)], "id long, x1 double, y1 double, x2 double, y2 double")
    seen = []

    def cuts(pairs, step, keys, found=arrangement._cuts):
        seen.extend(tuple(r) for r in pairs.select("id", "jd").collect())
        return found(pairs, step, keys)

    monkeypatch.setattr(arrangement, "_cuts", cuts)
    met, _ = arrangement.meetings(placed, None, 2.0**-40, ())
    assert [sorted(p) for p in seen] == [[3, 4]]
    assert {r.id: [tuple(p) for p in r.cuts] for r in met.collect()} == {3: [(0.5, 0.0)], 4: [(0.5, 0.0)]}


def test_pairs_of_single_links_are_not_shuffled_again(spark):
    old = [("a", "1"), ("a", "2"), ("b", "2"), ("c", "9"), ("c", "8"), ("d", None), (None, "2"), (None, "7"), ("a", "1"), ("e", "4")]
    new = [("1", "x"), ("2", "x"), ("2", "y"), (None, "z"), ("5", "w"), ("6", "w"), ("2", None), ("4", None), ("3", None), ("2", "y")]
    tables = spark.createDataFrame(old, "GEOID00 string, GEOID10 string"), spark.createDataFrame(new, "GEOID10 string, GEOID20 string")
    found = census_us.link_tracts(["dec2000", "dec2020"], *tables)
    key = lambda r: tuple(v or "" for v in r)
    joined = {(a, b) for a, i in old for j, b in new if i == j}
    joined |= {(a, None) for a, i in old if i not in {j for j, _ in new}} | {(None, b) for j, b in new if j not in {i for _, i in old}}
    assert sorted(map(tuple, found.collect()), key=key) == sorted(joined, key=key)
    ids = spark.range(1000).selectExpr("cast(id as string) as GEOID00", "cast(id % 2 as string) as GEOID10")
    many = census_us.link_tracts(["dec2000", "dec2020"], ids, ids.selectExpr("GEOID10", "GEOID00 as GEOID20"))
    assert many.count() == 500_000
    assert "_block" in executed(many)


def test_zones_are_compared_with_their_own_halves_alone(spark, monkeypatch):
    """Zones of a column overlap several neighbours' halves, which aren't asked for: no edges of such a pair meet."""
    from evenground.plans import catalogue_geometry

    seen = []

    def compared(met, keys, found=overlap._compared):
        seen.extend(tuple(r) for r in met.select(*keys).distinct().collect())
        return found(met, keys)

    monkeypatch.setattr(overlap, "_compared", compared)
    catalogue_geometry.sphere_shares(spark, "/root/testdata/sf0.001")
    assert seen and all(half.split(" ")[0] == str(zone) for half, zone in seen)
    assert len(seen) == 2 * spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()


def test_few_edges_of_a_group_meet_without_cells(spark, monkeypatch):
    """Small groups make one row per edge or piece, not one per cell and class; large ones go by cells; both give the same borders."""
    rows = [(g, x, y, x + w, y + 2.0) for g in range(6) for x, y, w in ((0.0, 0.0, 3.0), (1.5, 1.0, 0.25), (2.0, 0.5, 4.0), (6.0, 0.0, 1.0))]
    squares = spark.createDataFrame(rows, "g int, x0 double, y0 double, x1 double, y1 double").select("g", shapes.rectangle(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("geometry"))
    net = arrangement.exploded(squares, "g").withColumn("w", F.lit(1))
    seen = []

    def pairs(a, b, *more, found=arrangement.candidate_pairs, **how):
        out = found(a, b, *more, **how)
        seen.append(plan(out).count("sequence("))
        return out

    monkeypatch.setattr(arrangement, "candidate_pairs", pairs)
    ends = ["g", "x1", "y1", "x2", "y2"]
    told = {}
    for few in (48, 0, 15):
        monkeypatch.setattr(arrangement, "FEW_EDGES", few)
        told[few] = sorted(map(tuple, arrangement.bounded(net.where("g < 5 or x1 < 5"), ["g"], lambda w: w != 0, ["w"]).select(*ends).collect()))
    assert told[48] == told[0] == told[15] and len(told[0]) > 30
    assert seen and all(seen)


def test_cuts_are_not_part_of_the_join_of_edges(spark):
    """The join's loop is compiled alone: the cuts' terms would make it too long for that."""
    seen, cuts = [], arrangement._cuts

    def told(pairs, *more):
        seen.append(executed(pairs))
        return cuts(pairs, *more)

    rows = [(0, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 1.0, 1.0, 0.0)]
    crossing = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(arrangement, "_cuts", told)
        found, _ = arrangement.meetings(crossing, None, 2.0**-40, ())
    assert found.count() == 2 and len(seen) == 1 and "Join" not in seen[0]


def test_rows_of_few_are_dealt_to_one_cell(spark):
    square = lambda n: shapes.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0) * n, F.lit(1.0) * n)
    table = spark.range(1, 41).select("id", square(F.col("id") * 3).alias("geometry"), (F.col("id") % 2 == 0).alias("few"), (F.col("id") % 2).alias("k"))
    one = boxes(table, "id", "few", "k")
    found = candidate_pairs(one, one.withColumnRenamed("id", "jd"), by=("k",), once=("id", "jd"))
    pairs = [tuple(sorted(r)) for r in found.select("id", "jd").collect()]
    assert sorted(pairs) == sorted((i, j) for i in range(1, 41) for j in range(i + 1, 41) if (i - j) % 2 == 0)
    assert found.where("k = 0").count() == 190


def test_edges_are_not_compared_in_the_loop_of_a_join(spark, monkeypatch):
    """Pairs of polygons with few edges are stored with these: the loop over pairs of edges is compiled without the joins before it."""
    seen = []

    def compared(met, keys, found=overlap._compared):
        seen.append(executed(met))
        return found(met, keys)

    monkeypatch.setattr(overlap, "_compared", compared)
    square = lambda shift: shapes.rectangle(F.col("id") + shift, F.lit(0.0), F.col("id") + shift + 1, F.lit(1.0))
    one, two = (spark.range(30).select(F.col("id").alias(key), square(shift).alias("geometry")) for key, shift in (("a", 0.0), ("b", 0.25)))
    found = overlap.overlaps(one, two, "a", "b")
    assert sorted(map(tuple, found.where("overlap > 0").collect())) == sorted([(i, i, 0.75) for i in range(30)] + [(i, i - 1, 0.25) for i in range(1, 30)])
    assert len(seen) == 1 and "Join" not in seen[0]


def test_pairs_have_as_many_tasks_as_they_need(spark, monkeypatch):
    """Their number says how many, not the few bytes that are shuffled; missing keys match nothing, missing values and repeated rows stay."""
    monkeypatch.setattr(reshape, "BLOCK_ROWS", 50)
    monkeypatch.setattr(reshape, "TASK_PAIRS", 200, raising=False)
    left = spark.range(20).selectExpr("id as a", "nullif(id % 3, 2) as k")
    right = spark.range(600).selectExpr("nullif(id div 2 % 3, 2) as k", "if(id % 5 = 0, null, id div 10) as b")
    found = reshape.all_matches(left, right, "k")
    assert found.columns == ["k", "a", "b"]
    mine, theirs = left.collect(), right.collect()
    expected = [(x.k, x.a, y.b) for x in mine for y in theirs if x.k is not None and x.k == y.k]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    assert found.rdd.getNumPartitions() == len(expected) // 200
    keys = reshape.all_matches(left, right.select("k"), "k")
    assert keys.columns == ["k", "a"] and keys.count() == len(expected)
