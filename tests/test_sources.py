import pytest
from pyspark.sql import functions as F

from evenground.operators import reshape
from evenground.operators.geometry import shapes
from evenground.plans import pipelines
from evenground.plans.meta import Variable
from evenground.sources import census_ca, census_us, elections
from evenground.sources.provider import FolderProvider
from evenground.streaming.harmonize import running_sums


def boxes(spark, rows, schema):
    """rows: (..., x, y, side)"""
    df = spark.createDataFrame(rows, schema + ", x double, y double, side double")
    x, y, s = F.col("x"), F.col("y"), F.col("side")
    return df.withColumn("geometry", shapes.rectangle(x, y, x + s, y + s)).drop("x", "y", "side")


@pytest.fixture(scope="module")
def provider(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("census"))
    schema = "GeoUID string, CT_UID string, region_UID string, Population double, Dwellings double, Households double, v_1 double"
    old = [(f"1{i}", "c1" if i < 2 else "c2", "r", 10.0 * (i + 1), 4.0, 3.0, 100.0, 10.0 * i, 0.0, 10.0) for i in range(4)]
    new = [("20", "c1", "r", 40.0, 9.0, 6.0, 7.0, 0.0, 0.0, 20.0), ("21", "c2", "r", 50.0, 9.0, 6.0, 9.0, 20.0, 0.0, 20.0)]
    boxes(spark, old, schema).write.parquet(f"{root}/CA11_DA.parquet")
    boxes(spark, new, schema).write.parquet(f"{root}/CA16_DA.parquet")
    ct = "GeoUID string, Population double, Dwellings double, Households double, v_1 double"
    boxes(spark, [("c1", 30.0, 8.0, 6.0, 5.0, 0.0, 0.0, 20.0), ("c2", 70.0, 8.0, 6.0, 6.0, 20.0, 0.0, 20.0)], ct).write.parquet(f"{root}/CA11_CT.parquet")
    boxes(spark, [("c1", 40.0, 9.0, 6.0, 7.0, 0.0, 0.0, 20.0), ("c2", 50.0, 9.0, 6.0, 9.0, 20.0, 0.0, 20.0)], ct).write.parquet(f"{root}/CA16_CT.parquet")
    with open(f"{root}/datasets.csv", "w") as file:
        file.write("dataset,description,geo_dataset\nCA11,2011 Canada Census,CA11\nCA16,2016 Canada Census,CA16\n")
    with open(f"{root}/2016_DA.csv", "w") as file:
        file.write("DAUID2016,DAUID2011,DBUID2016,flag\n20,10,1,1\n20,11,2,1\n21,12,3,1\n21,13,4,1\n21,13,5,1\n")
    return FolderProvider(spark, root)


def files(provider):
    return {"2016": census_ca.relationship_file(provider.spark, f"{provider.root}/2016_DA.csv", "2016", "DA", f"{provider.root}/cache")}


META = [Variable("v_1", "v_old", "CA11", geo_dataset="CA11"), Variable("v_1", "v_new", "CA16", geo_dataset="CA16")]


def test_relationship_files_are_cleaned_and_cached(provider):
    rows = files(provider)["2016"]
    assert rows.count() == 4 and files(provider)["2016"].count() == 4
    with pytest.raises(ValueError):
        census_ca.relationship_file(provider.spark, "x", "2012", "DA")


def test_areas_by_relationship_file(provider):
    out = pipelines.common_areas(provider, None, META, files(provider))
    assert {(r.v_old, r.v_new, r.Population_CA11) for r in out.collect()} == {(200.0, 7.0, 30.0), (200.0, 9.0, 70.0)}
    assert out.where("geometry is not null").count() == 2


def test_tracts_by_their_areas_and_by_geometry(provider):
    by_file = pipelines.common_tracts_from_areas(provider, None, META, files(provider))
    by_ids = pipelines.common_tracts(provider, None, META)
    assert {(r.v_old, r.v_new) for r in by_file.collect()} == {(r.v_old, r.v_new) for r in by_ids.collect()} == {(5.0, 7.0), (6.0, 9.0)}


def test_single_census_is_labelled_and_transformed(provider):
    out = pipelines.harmonized_census(provider, {"CT": ["c1"]}, META[:1], "DA", data_transform=lambda d: d.withColumn("seen", F.lit(1)))
    assert out.count() == 2 and {"v_old", "seen"} <= set(out.columns)


def test_estimates_on_any_target(provider):
    target = boxes(provider.spark, [("t", 0.0, 0.0, 5.0)], "t string")
    rows = [Variable("v_1", "v_new", "CA16", geo_dataset="CA16", downsample="Population")]
    got = pipelines.census_estimate(provider, target, "t", rows, "CT").first()
    assert got.v_new == pytest.approx(7.0 / 16)
    fine = pipelines.census_estimate(provider, target, "t", rows, "CT", downsample_level="DA").first()
    assert fine.v_new == pytest.approx(7.0 / 16)


def test_us_tracts(spark, tmp_path):
    root = str(tmp_path)
    with open(f"{root}/t10.txt", "w") as file:
        for a, b in (("01", "11"), ("02", "11"), ("03", "12")):
            file.write(",".join(["53", "033", a, a, "5", "2", "1", "1", "1", "53", "033", b, b, "9", "4", "1", "1", "1", *["1"] * 12]) + "\n")
    with open(f"{root}/t20.txt", "w") as file:
        file.write("STATE_2010|COUNTY_2010|TRACT_2010|STATE_2020|COUNTY_2020|TRACT_2020\n|" + "|".join(["", "11", "", "", "21"]) + "\n")
    ten = census_us.tracts_2010(spark, f"{root}/t10.txt")
    assert ten.count() == 3 and dict(ten.dtypes)["POP00"] == "int"
    both = census_us.link_tracts(["dec2000", "dec2020"], ten, census_us.tracts_2020(spark, f"{root}/t20.txt").fillna("").withColumn("GEOID10", F.lit("11")).withColumn("GEOID20", F.lit("21")))
    assert {tuple(r) for r in both.collect()} == {("01", "21"), ("02", "21"), ("03", None)}
    states = spark.createDataFrame([("WA", "53"), ("WA", "53"), ("OR", "41")], "state string, state_code string")
    assert census_us.state_of(states, "53") == ("WA", "53") and census_us.tract_path("r", ("WA", "53"), "2010") == "r/wa53trf.txt"
    with pytest.raises(ValueError):
        census_us.state_of(states, "XX")
    schema = "GeoUID string, state_UID string, pop int"
    spark.createDataFrame([("01", "53", 1), ("02", "53", 2), ("03", "53", 3)], schema).write.parquet(f"{root}/dec2000_tract.parquet")
    spark.createDataFrame([("11", "53", 10), ("12", "53", 20)], schema).write.parquet(f"{root}/dec2010_tract.parquet")
    rows = [Variable("pop", "pop00", "dec2000", geo_dataset="dec2000"), Variable("pop", "pop10", "dec2010", geo_dataset="dec2010")]
    links = lambda state: census_us.link_tracts(["dec2000", "dec2010"], ten, None)
    out = pipelines.harmonized_us_census(FolderProvider(spark, root), states, {"state": ["WA"]}, rows, links)
    assert {(r.pop00, r.pop10) for r in out.collect()} == {(3, 10), (3, 20)}


def test_county_subdivisions(spark, tmp_path):
    (tmp_path / "c.csv").write_text("STATEFP10,GEOID00,GEOID10\n53,1,2\n41,3,4\n")
    assert [tuple(r) for r in census_us.county_subdivisions(spark, str(tmp_path / "c.csv"), "53").collect()] == [("1", "2")]


def test_votes(spark, tmp_path):
    names = list(elections.COLUMNS)
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.csv").write_text(",".join(names) + "\n1,,,,12A,X,,,30\n1,12,,,13,X,,,n\n1,,,,,X,,,3\n", encoding="utf-8")
    votes = elections.clean_votes(elections.read_votes(spark, str(tmp_path / "v")), 2019)
    assert {(r.PD_NUM, r.PDNUM, r.Votes, r.PD_2019) for r in votes.collect()} == {("12", "12A", 30, "1_12"), ("13", "13", None, "1_12")}
    geos = spark.createDataFrame([("1", "12", "600"), ("1", "99", "601")], "FED_NUM string, PD_NUM string, ADV_POLL string")
    got = {(r.PD_NUM, r.AP_2019, r.PD_2019) for r in elections.polling_geographies(geos, votes, 2019).collect()}
    assert got == {("12", "1_600", "1_12"), ("99", "1_601", None)}


def test_reshaping(spark):
    df = spark.createDataFrame([("d", "A", 3), ("d", "B", 3), ("e", "A", 1)], "k string, p string, v int")
    assert reshape.top(df, ["k"], "v").count() == 3 and reshape.top(df, ["k"], "v", ties=False).count() == 2
    assert {(r.k, r.p, r.v) for r in reshape.complete(df, ["k"], "p", ["A", "B"], {"v": 0}).collect()} == {("d", "A", 3), ("d", "B", 3), ("e", "A", 1), ("e", "B", 0)}
    wide = reshape.wider(df, ["k"], "p", "v", ["A", "B"])
    assert {tuple(r) for r in wide.collect()} == {("d", 3, 3), ("e", 1, None)}
    assert reshape.longer(wide, ["k"], ["A", "B"]).count() == 4
    cut = reshape.cut(F.col("v"), [0, 1, 3], ["low", "high"])
    assert [r[0] for r in df.orderBy("k", "p").select(cut).collect()] == ["high", "high", "low"]


def test_running_sums_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("A1", 2), ("A2", 3), ("A3", 5)], "a string, n int")
    rows.write.parquet(str(tmp_path / "in"))
    units = spark.createDataFrame([("A1", "u"), ("A2", "u"), ("A3", "w")], "a string, common_id string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = running_sums(stream, units, "a", ["n"]).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("select common_id, n from sums").collect()} == {("u", 5), ("w", 5)}


def write_sheet(path, rows, shared):
    """A minimal workbook of one sheet; ``shared``: texts by number, else inline."""
    import zipfile
    from xml.sax.saxutils import escape

    texts = sorted({c for r in rows for c in r if c is not None})

    def cell(c, name):
        return "" if c is None else f'<c r="{name}" t="s"><v>{texts.index(c)}</v></c>' if shared else f'<c r="{name}" t="inlineStr"><is><t>{escape(c)}</t></is></c>'

    body = "".join(f'<row r="{i}">' + "".join(cell(c, f"{'ABCDEFGH'[j]}{i}") for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>")


@pytest.mark.parametrize("shared", [True, False])
def test_spreadsheets_are_read_by_tasks(spark, tmp_path, shared):
    head = ["NAME", "STATEFP10", "GEOID00", "x", "GEOID10"]
    rows = [["a & b", "05", "o1", None, "n1"], [None, "06", "o2", "y", "n2"], ["c", "05", "o3", None, None]]
    write_sheet(str(tmp_path / "table.xlsx"), [head, *rows], shared)
    got = census_us.county_subdivisions(spark, str(tmp_path / "table.xlsx"), "05")
    assert sorted((r.GEOID00, r.GEOID10) for r in got.collect()) == [("o1", "n1"), ("o3", None)]
