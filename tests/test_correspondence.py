import random

import pytest

from evenground.operators import correspondence
from evenground.operators.components import connected_components
from evenground.operators.correspondence import chain_correspondences, close_correspondence, combine_correspondences, identifier_correspondence


def closed(spark, rows, schema="geo_a string, geo_b string", **more):
    return close_correspondence(spark.createDataFrame(rows, schema), **more)


def units(df):
    return df.select("common_id").distinct().count()


def test_ids_are_added_and_disjoint_rows_stay_apart(spark):
    got = closed(spark, [("A1", "B1"), ("A2", "B2")])
    assert got.columns == ["geo_a", "geo_b", "common_id", "common_uid"] and units(got) == 2


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([("A1", "B1"), ("A1", "B2")], 1),
        ([("A1", "B1"), ("A2", "B1"), ("A3", "B2")], 2),
        ([("A1", "B2"), ("A2", "B2"), ("A2", "B3"), ("A3", "B3")], 1),
        ([("A1", "B1")], 1),
    ],
)
def test_shared_ids_link(spark, rows, n):
    assert units(closed(spark, rows)) == n


def test_uid_lists_the_unit(spark):
    got = {r.geo_a: (r.common_id, r.common_uid) for r in closed(spark, [("A1", "B1"), ("A2", "B1"), ("A3", "B2")]).collect()}
    assert got["A1"] == got["A2"] == ("A1", "geo_a:A1,A2 geo_b:B1") and got["A3"] == ("A3", "geo_a:A3 geo_b:B2")


def test_all_rows_are_kept(spark):
    assert closed(spark, [("A1", "B1"), ("A1", "B2"), ("A2", "B2"), ("A3", "B3")]).count() == 4


def test_three_columns(spark):
    assert units(closed(spark, [("A1", "B1", "C1"), ("A2", "B2", "C2")], "a string, b string, c string")) == 2
    assert units(closed(spark, [("A1", "B1", "C1"), ("A2", "B2", "C1")], "a string, b string, c string")) == 1


def test_missing_ids(spark):
    rows = [(None, "B1"), (None, "B2"), ("A1", "B2"), ("A2", None), ("A3", None)]
    assert units(closed(spark, rows)) == 4
    literal = closed(spark, rows, null_ids="literal")
    assert units(literal) == 2 and literal.where("common_id = '1_NA'").count() == 3


def test_rows_without_any_id_are_of_no_unit(spark):
    got = closed(spark, [(None, None), (None, None), ("A1", None), (None, "B1")]).collect()
    assert [r.common_id for r in sorted(got, key=str)].count(None) == 2 and {r.common_id for r in got} == {None, "A1", "2_B1"}


def test_row_order_does_not_matter(spark):
    rows = [(f"A{i // 3}", f"B{i // 2}") for i in range(40)]
    one = sorted(closed(spark, rows).collect())
    random.Random(3).shuffle(rows)
    assert sorted(closed(spark, rows).collect()) == one


def test_components_of_chains_and_hubs(spark):
    n = 300
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    chain = [(ids[i], ids[i + 1]) for i in range(n - 1)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + hub + [(7, 7), (None, 3)], "x long, y long"), "x", "y").collect()}
    assert {got[i] for i in ids} == {0} and {got[1000 + i] for i in range(200)} == {1000} and len(got) == n + 200


def test_combining_and_chaining(spark):
    one = spark.createDataFrame([("A1", "B1", "m"), ("A2", "B2", "m")], "a string, b string, method string")
    two = spark.createDataFrame([("B1", "C1", "n"), ("B1", "C2", "m")], "b string, c string, method string")
    assert {tuple(r) for r in combine_correspondences([one, two]).select("a", "b", "c", "method").collect()} == {("A1", "B1", "C1", "m,n"), ("A1", "B1", "C2", "m")}
    with pytest.raises(ValueError):
        combine_correspondences([one.drop("b"), two])
    assert chain_correspondences([one.drop("method"), two.drop("method")]).count() == 3


def test_identifiers_that_all_have(spark):
    data = {"x": spark.createDataFrame([("1",), ("2",), (None,)], "p string"), "y": spark.createDataFrame([("2",), ("3",)], "q string")}
    assert [tuple(r) for r in identifier_correspondence(data, {"x": "p", "y": "q"}).collect()] == [("2", "2", "identifier")]


def test_rows_of_a_large_unit_are_dealt_over_copies_of_its_list(spark, monkeypatch):
    """No row of the list meets all rows of its unit, in whichever way Spark would join them at that size."""
    monkeypatch.setattr(correspondence, "UNIT_ROWS", 3)
    rows = [(f"{i}", None) for i in range(20)] + [("a", "b"), ("a", "c"), (None, None), (None, None)]
    done = correspondence.close_correspondence(spark.createDataFrame(rows, "x string, y string"), "literal")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [common_id" in plan and "_copy" in plan
    got = done.collect()
    assert sorted(map(str, ((r.x, r.y) for r in got))) == sorted(map(str, rows))
    assert {r.common_id for r in got if r.x != "a"} == {"0"} and {r.common_uid for r in got if r.x == "a"} == {"x:a y:b,c"}
    assert {r.common_uid for r in got if r.x != "a"} == {"x:" + ",".join(sorted(map(str, range(20)))) + " y:"}


def test_copies_of_a_list_are_not_made_at_once(spark, monkeypatch):
    """An explode holds all that it makes of a row: it makes numbers, and as many as the cores need, not one for so many rows."""
    monkeypatch.setattr(correspondence, "UNIT_ROWS", 1)
    monkeypatch.setattr(correspondence, "COPIES_PER_CORE", 2, raising=False)
    most = 2 * spark.sparkContext.defaultParallelism
    rows = [(f"{i}", None) for i in range(3 * most)] + [("a", "b"), ("a", "c"), ("a", None)]
    done = correspondence.close_correspondence(spark.createDataFrame(rows, "x string, y string"), "literal")
    made = [line for line in done._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in line]
    assert made and not any("common_uid" in line for line in made)
    got = done.collect()
    assert sorted(map(str, ((r.x, r.y) for r in got))) == sorted(map(str, rows))
    assert {r.common_uid for r in got} == {"x:" + ",".join(sorted([*map(str, range(3 * most)), "a"])) + " y:b,c"}
