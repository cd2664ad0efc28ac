import pytest

from evenground.operators.reaggregate import downsample

MATCH = {"parent_id": "parent_id"}


@pytest.fixture
def numbers(spark):
    parent = spark.createDataFrame([("P1", 1000.0, 500.0), ("P2", 2000.0, 600.0)], "parent_id string, pop double, num double")
    child = spark.createDataFrame(
        [("C1", "P1", 200.0, 100.0), ("C2", "P1", 300.0, 150.0), ("C3", "P1", 500.0, 200.0), ("C4", "P2", 2000.0, 600.0)], "child_id string, parent_id string, pop double, num double"
    )
    return parent, child


def column(df, name):
    return {r["child_id"]: r[name] for r in df.collect()}


@pytest.mark.parametrize("compat", ["intended", "literal"])
def test_exact_weights_and_totals(numbers, compat):
    parent, child = numbers
    out = downsample(child, parent, MATCH, ["num"], "pop", compat)
    assert out.columns == ["child_id", "parent_id", "pop", "num"] and out.count() == 4
    assert column(out, "num") == pytest.approx({"C1": 110, "C2": 165, "C3": 225, "C4": 600})


def test_category_that_children_lack(numbers):
    parent, child = numbers
    got = column(downsample(child.drop("num"), parent, MATCH, ["num"], "pop"), "num")
    assert got["C1"] + got["C2"] + got["C3"] == pytest.approx(500) and got["C4"] == pytest.approx(600)


def test_text_is_filled(spark):
    parent = spark.createDataFrame([("P1", 1.0, "Low"), ("P2", 1.0, "High")], "parent_id string, pop double, rank string")
    child = spark.createDataFrame([("C1", "P1", 400.0, None), ("C2", "P1", 600.0, "Medium"), ("C3", "P2", 2000.0, None)], "child_id string, parent_id string, pop double, rank string")
    assert column(downsample(child, parent, MATCH, ["rank"], "pop"), "rank") == {"C1": "Low", "C2": "Medium", "C3": "High"}
    assert column(downsample(child.drop("rank"), parent, MATCH, ["rank"], "pop"), "rank") == {"C1": "Low", "C2": "Low", "C3": "High"}


def test_mixed_types_and_odd_column_names(spark):
    parent = spark.createDataFrame([("P1", 1000.0, 500.0, "a"), ("P2", 2000.0, 600.0, "b")], "parent_id string, pop double, num double, char string")
    child = spark.createDataFrame(
        [("C1", "P1", 200.0, 100.0, "a", "x"), ("C2", "P1", 800.0, 380.0, "a", "y"), ("C3", "P2", 2000.0, 600.0, "b", "z")],
        "child_id string, parent_id string, pop double, num double, char string, `...id` string",
    )
    out = downsample(child, parent, MATCH, ["num", "char"], {"num": "pop", "char": None})
    got = column(out, "num")
    assert out.count() == 3 and "...id" in out.columns and got["C1"] + got["C2"] == pytest.approx(500)


def test_means_are_filled_and_orphans_kept(spark):
    parent = spark.createDataFrame([("P1", 5.0, 10.0)], "parent_id string, mean double, n double")
    child = spark.createDataFrame([("C1", "P1", 1.0, None, 4.0), ("C2", "P1", 1.0, 7.0, 4.0), ("C3", None, 1.0, None, 3.0)], "child_id string, parent_id string, pop double, mean double, n double")
    out = downsample(child, parent, MATCH, ["mean", "n"], {"mean": None, "n": "pop"})
    assert column(out, "mean") == {"C1": 5.0, "C2": 7.0, "C3": None} and column(out, "n") == {"C1": 5.0, "C2": 5.0, "C3": 3.0}
    literal = downsample(child, parent, MATCH, ["n"], "pop", "literal")
    assert column(literal, "n")["C3"] == 0.0


def test_errors(numbers, spark):
    parent, child = numbers
    with pytest.raises(ValueError, match="base"):
        downsample(child, parent, MATCH, ["num"], {"other": "pop"})
    with pytest.raises(ValueError, match="twice"):
        downsample(child, parent.union(parent), MATCH, ["num"], "pop")
    with pytest.raises(ValueError, match="lacks"):
        downsample(child, parent, MATCH, ["none"], "pop")
