import math

import pytest
from pyspark.sql import functions as F

from evenground.functions.semantics import annual_rate, divide, log, natural_join, strict_max, strict_min, total
from evenground.operators.aggregate import aggregate_with_meta, harmonize, post_scale, pre_scale, rename_with_meta
from evenground.operators.correspondence import close_correspondence
from evenground.plans import meta
from evenground.plans.meta import Variable


def rule(variable, rule="Additive", parent=None, units=None):
    return Variable(variable, variable, "test", rule, rule, units, rule, parent, "test")


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_additive_sums(spark):
    df = spark.createDataFrame([("A", 100), ("A", 200), ("B", 150), ("B", 50)], "group string, pop int")
    assert values(aggregate_with_meta(df, [rule("pop")], ["group"]), "group", "pop") == {"A": 300, "B": 200}


def test_missing_values_dropped_or_kept(spark):
    df = spark.createDataFrame([("A", 100), ("A", None), ("B", 50)], "group string, pop int")
    assert values(aggregate_with_meta(df, [rule("pop")], ["group"]), "group", "pop") == {"A": 100, "B": 50}
    assert values(aggregate_with_meta(df, [rule("pop")], ["group"], na_rm=False), "group", "pop") == {"A": None, "B": 50}


def test_absent_variable_is_ignored(spark):
    df = spark.createDataFrame([("A", 100), ("B", 200)], "group string, pop int")
    out = aggregate_with_meta(df, [rule("pop"), rule("missing_var")], ["group"])
    assert out.columns == ["group", "pop"]


def test_average_is_weighted(spark):
    df = spark.createDataFrame([("A", 100.0, 50000.0), ("A", 200.0, 60000.0), ("B", 150.0, 40000.0), ("B", 50.0, 70000.0)], "group string, pop double, income double")
    got = values(aggregate_with_meta(df, [rule("pop"), rule("income", "Average", "pop")], ["group"]), "group", "income")
    assert got["A"] == pytest.approx(56666.667, abs=1e-2) and got["B"] == pytest.approx(47500)


def test_median_is_treated_as_average_with_a_warning(spark):
    df = spark.createDataFrame([("A", 100.0, 40000.0), ("A", 200.0, 60000.0), ("B", 300.0, 50000.0)], "group string, pop double, med double")
    with pytest.warns(UserWarning, match="averages"):
        got = values(aggregate_with_meta(df, [rule("pop"), rule("med", "Median", "pop")], ["group"]), "group", "med")
    assert got["A"] == pytest.approx(160000 / 3) and got["B"] == 50000


def test_scaling_there_and_back(spark):
    df = spark.createDataFrame([(100.0, 50000.0), (200.0, 60000.0)], "pop double, income double")
    scaled = pre_scale(df, [("income", "pop")])
    assert [r.income for r in scaled.collect()] == [5e6, 12e6]
    assert [r.income for r in post_scale(scaled, [("income", "pop")]).collect()] == [50000.0, 60000.0]
    assert pre_scale(df, []).collect() == df.collect()


def test_average_to_keeps_its_base(spark):
    df = spark.createDataFrame([("A", 120.0, 0.2), ("A", 110.0, 0.1)], "group string, now double, growth double")
    got = aggregate_with_meta(df, [rule("now"), rule("growth", "AverageTo", "now", meta.RATIO_UNITS)], ["group"]).first()
    assert got.base_now == pytest.approx(200) and got.growth == pytest.approx(0.15)


def test_parent_must_be_known(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "group string, x double, p double")
    with pytest.raises(ValueError, match="p"):
        aggregate_with_meta(df, [rule("x", "Average", "p")], ["group"])


def test_nan_is_missing_and_division_never_raises(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 1.0), (float("nan"), 2.0)], "a double, b double")
    got = [r[0] for r in df.select(divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == -math.inf and got[3] is None and math.isnan(got[4])
    summed = aggregate_with_meta(df.withColumn("g", F.lit(1)), [rule("a")], ["g"]).first().a
    assert summed == 0.0
    assert df.where("a is null").agg(total(F.col("a"), True)).first()[0] == 0


def test_row_wise_extremes_and_log(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [tuple(r) for r in df.select(strict_max(F.col("a"), F.col("b")), strict_min(F.col("a"), F.col("b"))).collect()] == [(2.0, 1.0), (None, None)]
    assert df.limit(1).select(log(F.lit(0.0)), log(F.lit(1.0))).first()[0] == -math.inf
    assert df.limit(1).select(annual_rate(F.lit(-0.5), 5)).first()[0] == pytest.approx(-(1.5 ** (1 / 5) - 1))


def test_missing_ids_join_missing_ids(spark):
    a, b = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int"), spark.createDataFrame([(None, 3), ("y", 4)], "k string, w int")
    assert sorted(natural_join(a, b, ["k"]).collect(), key=str) == [(None, 1, 3)]
    assert natural_join(a, b, ["k"], "full").count() == 3


def test_harmonize_labels_and_drops_extras(spark):
    one = spark.createDataFrame([("A1", 10), ("A2", 20), ("A3", 5)], "geo_a string, pop int")
    two = spark.createDataFrame([("B1", 7), ("B2", 9), ("B3", 11)], "geo_b string, pop int")
    closed = close_correspondence(spark.createDataFrame([("A1", "B1"), ("A2", "B1"), ("A3", "B2")], "geo_a string, geo_b string"))
    rows = [Variable("pop", "pop_one", "one", geo_dataset="one"), Variable("pop", "pop_two", "two", type="Extra", geo_dataset="two")]
    out = harmonize({"one": one, "two": two}, closed, rows)
    assert out.columns == ["common_id", "common_uid", "pop_one"]
    assert values(out, "common_id", "pop_one") == {"A1": 30, "A3": 5}
    with pytest.raises(ValueError, match="labels"):
        harmonize({"one": one, "two": two}, closed, [Variable("pop", "pop", "one", geo_dataset="one"), Variable("pop", "pop", "two", geo_dataset="two")])
    bad = closed.union(closed.selectExpr("geo_a", "geo_b", "concat(common_id, 'x')", "common_uid"))
    with pytest.raises(ValueError, match="more than one"):
        harmonize({"one": one}, bad, rows)


def test_rename_refuses_two_labels(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert rename_with_meta(df, [Variable("x", "y", geo_dataset="d")], "d").columns == ["y"]
    with pytest.raises(ValueError):
        rename_with_meta(df, [Variable("x", "y"), Variable("x", "z")])


CATALOG = [
    {"dataset": "CA16", "description": "2016 Canada Census", "geo_dataset": "CA16"},
    {"dataset": "CA11", "description": "2011 Canada Census and NHS", "geo_dataset": "CA11"},
]


def test_census_metadata():
    vectors = [{"vector": "v_CA16_2", "aggregation": "Average of v_CA16_1", "units": "Number"}, {"vector": "v_CA16_3", "aggregation": "Additive", "units": "Number"}]
    got = meta.meta_for_census_vectors({"income": "v_CA16_2", "": "v_CA16_3"}, vectors, CATALOG)
    assert [(m.variable, m.label, m.rule, m.parent, m.type, m.year) for m in got] == [
        ("v_CA16_2", "income", "Average", "v_CA16_1", "Original", 2016),
        ("v_CA16_3", "v_CA16_3", "Additive", None, "Original", 2016),
        ("v_CA16_1", "v_CA16_1", "Additive", None, "Extra", 2016),
    ]
    assert [m.variable for m in meta.add_base_variables(got)][3:] == ["Population", "Dwellings", "Households"]
    assert meta.parse_aggregation("Average to v_1") == ("AverageTo", "v_1") and meta.parse_aggregation("0") == ("0", None)
    assert meta.normalize_datasets(["2006", "CA11"]) == ["CA06", "CA11"]
    assert (meta.geo_dataset_of("CA11F", CATALOG), meta.geo_dataset_of("CA11N", CATALOG), meta.year_of("CA1996"), meta.year_of("CA06")) == ("CA11", "CA11", 1996, 2006)
    assert meta.dataset_of_vector("v_2011_7", CATALOG) == "CA11"
