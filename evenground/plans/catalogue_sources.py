"""Registered queries of the sources, pipelines and remaining operators: census folders, relationship files, geometries as text, lookups.

Files that a source reads are written first, from the tables of the session, to the shared folder.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenground.operators import aggregate, estimate, reshape
from evenground.operators.correspondence import close_correspondence
from evenground.operators.geometry import dissolve, shapes
from evenground.plans import meta, pipelines
from evenground.plans.meta import Variable
from evenground.runtime import new_folder, read_spread, read_table
from evenground.sources import census_ca, census_us, elections, examples, geometries
from evenground.sources.provider import FolderProvider, intersecting_regions, preferred

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# --- a census in a folder: units are suppliers (CA11), their pairs (CA16), tracts of four suppliers ---

_FOLDERS: dict[tuple[str, str], str] = {}


def _box(x: str, y: str, width: int) -> Column:
    left, low = F.expr(f"cast({x} as double)"), F.expr(f"cast({y} as double)")
    return shapes.rectangle(left, low, left + width, low + 1)


def _census(spark: SparkSession, sf_dir: str) -> FolderProvider:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        root = new_folder(spark)
        s = read_spread(spark, sf_dir, "supplier")
        tract, pair = F.expr("concat('c', s_suppkey div 4)"), F.expr("concat('p', s_suppkey div 2)")
        counts = [F.lit(4.0).alias("Dwellings"), F.lit(3.0).alias("Households")]
        ones = s.select(F.expr("concat('s', s_suppkey)").alias("GeoUID"), tract.alias("CT_UID"), F.expr("cast(1 + s_suppkey % 7 as double)").alias("Population"), *counts, F.col("s_acctbal").alias("v_1"), _box("s_suppkey % 100", "s_suppkey div 100", 1).alias("geometry"))
        twos = s.groupBy(F.expr("s_suppkey div 2").alias("k")).agg(F.sum(F.expr("cast(2 + s_suppkey % 5 as double)")).alias("Population"), F.sum("s_acctbal").alias("v_1"))
        twos = twos.select(F.expr("concat('p', k)").alias("GeoUID"), F.expr("concat('c', k div 2)").alias("CT_UID"), "Population", *counts, "v_1", _box("k * 2 % 100", "k * 2 div 100", 2).alias("geometry"))
        ones.write.parquet(f"{root}/CA11_DA.parquet")
        twos.write.parquet(f"{root}/CA16_DA.parquet")
        for name, fine in (("CA11", ones), ("CA16", twos)):
            k = F.expr("cast(substring(CT_UID, 2) as bigint)")
            tracts = fine.groupBy("CT_UID").agg(*[F.sum(c).alias(c) for c in ("Population", "Dwellings", "Households", "v_1")]).withColumn("k", k)
            tracts.select(F.col("CT_UID").alias("GeoUID"), "Population", "Dwellings", "Households", "v_1", _box("k * 4 % 100", "k * 4 div 100", 4).alias("geometry")).write.parquet(f"{root}/{name}_CT.parquet")
        catalog = [("CA11", "2011 Canada Census", "CA11"), ("CA16", "2016 Canada Census", "CA16")]
        spark.createDataFrame(catalog, "dataset string, description string, geo_dataset string").write.option("header", True).csv(f"{root}/datasets.csv")
        links = s.select(pair.alias("n"), F.expr("concat('s', s_suppkey)").alias("o"), F.lit("b").alias("d"), F.lit("1").alias("f"))
        embedded = spark.createDataFrame([("DAUID2016", "DAUID2011", "DBUID2016", "flag")], links.schema)
        links.union(embedded).union(links).write.csv(f"{root}/2016_DA.csv")
        us = s.select("s_suppkey", F.expr("cast(s_suppkey % 3 as string)").alias("state_UID"), F.expr("cast(s_suppkey % 2 as string)").alias("county_UID"), "s_nationkey")
        us.select(F.expr("concat('o', s_suppkey)").alias("GeoUID"), "state_UID", "county_UID", F.col("s_nationkey").cast("long").alias("pop")).write.parquet(f"{root}/dec2000_tract.parquet")
        us.groupBy(F.expr("s_suppkey div 6 * 3 + s_suppkey % 3").alias("k")).agg(F.max("state_UID").alias("state_UID"), F.max(F.lit("0")).alias("county_UID"), F.sum(F.lit(10)).alias("pop")).select(
            F.expr("concat('n', k)").alias("GeoUID"), "state_UID", "county_UID", "pop"
        ).write.parquet(f"{root}/dec2010_tract.parquet")
        _FOLDERS[key] = root
    return FolderProvider(spark, _FOLDERS[key])


def _file(provider: FolderProvider, cache: str | bool | None = None) -> DataFrame:
    return census_ca.relationship_file(provider.spark, f"{provider.root}/2016_DA.csv", "2016", "DA", cache)


_META = [Variable("v_1", "v_old", "CA11", geo_dataset="CA11"), Variable("v_1", "v_new", "CA16", geo_dataset="CA16")]
_LINKS = "SELECT 'p' || CAST(s_suppkey // 2 AS varchar) AS DAUID2016, 's' || CAST(s_suppkey AS varchar) AS DAUID2011, '1' AS flag FROM supplier"


@_query(_LINKS)
def source_relationship_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns, repeated rows and an embedded header; written to a cache and read back."""
    provider = _census(spark, sf_dir)
    folder = new_folder(spark)
    _file(provider, folder)
    return _file(provider, folder)


@_query("SELECT '59' || CAST(s_suppkey AS varchar) AS DAUID2021, CAST(s_suppkey AS varchar) AS DAUID2016, '0' AS flag FROM supplier")
def source_shifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2021 file loses its one shifted row."""
    path = new_folder(spark)
    rows = read_spread(spark, sf_dir, "supplier").selectExpr("concat('59', s_suppkey)", "cast(s_suppkey as string)", "'b'", "'0'")
    shifted = spark.createDataFrame([(*census_ca.SHIFTED_DA, "b", "1")], rows.schema)
    rows.union(shifted).write.csv(path)
    return census_ca.relationship_file(spark, path, "2021", "DA")


@_query("SELECT a AS GeoUIDCA11, b AS GeoUIDCA16, 'statcan' AS method, MIN(a) OVER (PARTITION BY b) AS common_id FROM (SELECT 's' || CAST(s_suppkey AS varchar) AS a, 'p' || CAST(s_suppkey // 2 AS varchar) AS b FROM supplier)")
def ca_correspondence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = _census(spark, sf_dir)
    found = census_ca.census_correspondence(provider, ["2011", "2016"], None, "DA", "statcan", {"2016": _file(provider)})
    return found.select("GeoUIDCA11", "GeoUIDCA16", "method", "common_id")


@_query("SELECT DISTINCT 'c' || CAST(s_suppkey // 4 AS varchar) AS GeoUIDCA11, 'c' || CAST(s_suppkey // 4 AS varchar) AS GeoUIDCA16, 'statcan' AS method FROM supplier")
def ca_correspondence_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracts are linked over the files of their areas."""
    provider = _census(spark, sf_dir)
    return census_ca.census_correspondence(provider, ["2011", "2016"], None, "CT", "statcan", {"2016": _file(provider)}).select("GeoUIDCA11", "GeoUIDCA16", "method")


@_query("SELECT a AS GeoUIDCA11, b AS GeoUIDCA16, 'estimate' AS method, MIN(a) OVER (PARTITION BY b) AS common_id FROM (SELECT 's' || CAST(s_suppkey AS varchar) AS a, 'p' || CAST(s_suppkey // 2 AS varchar) AS b FROM supplier)")
def ca_correspondence_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = census_ca.census_correspondence(_census(spark, sf_dir), ["CA11", "CA16"], None, "DA", "estimate", tolerance=0.1)
    return found.select("GeoUIDCA11", "GeoUIDCA16", "method", "common_id")


@_query("SELECT DISTINCT 'c' || CAST(s_suppkey // 4 AS varchar) AS GeoUIDCA11, 'c' || CAST(s_suppkey // 4 AS varchar) AS GeoUIDCA16, 'identifier' AS method FROM supplier")
def ca_correspondence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census_ca.census_correspondence(_census(spark, sf_dir), ["CA11", "CA16"], None, "CT", "identifier", tolerance=0.1).select("GeoUIDCA11", "GeoUIDCA16", "method")


_BY_UNIT = "SELECT MIN('{p}' || CAST(s_suppkey // {n} AS varchar)) AS common_id, ROUND(SUM(s_acctbal), 2) AS v_old, ROUND(SUM(s_acctbal), 2) AS v_new, CAST(SUM(1 + s_suppkey % 7) AS double) AS Population_CA11, CAST(SUM(2 + s_suppkey % 5) AS double) AS Population_CA16 FROM supplier GROUP BY s_suppkey // {g}"


def _values(df: DataFrame) -> DataFrame:
    return df.select("common_id", F.round("v_old", 2).alias("v_old"), F.round("v_new", 2).alias("v_new"), "Population_CA11", "Population_CA16")


@_query(_BY_UNIT.format(p="s", n=1, g=2))
def ca_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquire, correspond, aggregate, label; values are transformed on the way and moved back."""
    provider = _census(spark, sf_dir)
    halved = lambda d: d.withColumn("v_1", F.col("v_1") / 2)
    done = pipelines.harmonized_census(provider, None, _META, "DA", "statcan", {"2016": _file(provider)}, data_transform=halved)
    return _values(done.withColumns({"v_old": F.col("v_old") * 2, "v_new": F.col("v_new") * 2}))


@_query("SELECT 's' || CAST(MIN(s_suppkey) AS varchar) AS id, CASE WHEN SUM(CASE WHEN s_suppkey % 10 = 3 THEN 1 ELSE 0 END) = 0 THEN ROUND(SUM(s_acctbal), 2) END AS v_old FROM supplier GROUP BY s_suppkey // 2")
def ca_census_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without na_rm a missing value makes its unit's sum missing."""
    provider = _census(spark, sf_dir)
    holes = lambda d: d.withColumn("v_1", F.expr("if(GeoUID like 's%3', null, v_1)"))
    done = pipelines.harmonized_census(provider, None, _META, "DA", "statcan", {"2016": _file(provider)}, data_transform=holes, na_rm=False)
    first = F.array_min(F.transform(F.split(F.regexp_extract("common_uid", "GeoUIDCA11:([^ ]*)", 1), ","), lambda x: F.substring(x, 2, 20).cast("long")))
    return done.select(F.concat(F.lit("s"), first).alias("id"), F.round("v_old", 2).alias("v_old"))


@_query("SELECT 's' || CAST(s_suppkey AS varchar) AS GeoUID, s_acctbal AS v_old FROM supplier WHERE s_suppkey // 4 = 1")
def ca_census_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single census of one region is labelled, no more."""
    return pipelines.harmonized_census(_census(spark, sf_dir), {"CT": ["c1"]}, _META[:1], "DA").select("GeoUID", "v_old")


@_query(_BY_UNIT.format(p="c", n=4, g=4))
def ca_common_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(pipelines.common_tracts(_census(spark, sf_dir), None, _META))


@_query(_BY_UNIT.format(p="s", n=1, g=2))
def ca_common_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = _census(spark, sf_dir)
    return _values(pipelines.common_areas(provider, None, _META, {"2016": _file(provider)}))


@_query(_BY_UNIT.format(p="c", n=4, g=4))
def ca_common_tracts_from_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = _census(spark, sf_dir)
    return _values(pipelines.common_tracts_from_areas(provider, None, _META, {"2016": _file(provider)}))


def _rows_of_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 100").alias("t")).distinct().withColumn("geometry", _box("0", "t", 100))


_BY_ROW = "SELECT s_suppkey // 100 AS t, ROUND(SUM(s_acctbal), 2) AS v_new FROM supplier GROUP BY 1"


@_query(_BY_ROW)
def ca_census_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracts that the target meets, estimated on it; a row of units loses nothing."""
    done = pipelines.census_estimate(_census(spark, sf_dir), _rows_of_hundred(spark, sf_dir), "t", _META[1:], "CT", intersection_level="CT", na_rm=True)
    return done.select("t", F.round("v_new", 2).alias("v_new"))


@_query(_BY_ROW)
def ca_census_estimate_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of values pushed down to areas by their people."""
    rows = [Variable("v_1", "v_new", "CA16", geo_dataset="CA16", downsample="Population")]
    done = pipelines.census_estimate(_census(spark, sf_dir), _rows_of_hundred(spark, sf_dir), "t", rows, "CT", downsample_level="DA", na_rm=True)
    return done.select("t", F.round("v_new", 2).alias("v_new"))


@_query("SELECT DISTINCT 'c' || CAST(s_suppkey // 4 AS varchar) AS region FROM supplier WHERE s_suppkey // 100 = 0")
def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.range(1).select(shapes.rectangle(F.lit(0.5), F.lit(0.25), F.lit(99.5), F.lit(0.75)).alias("geometry"))
    return intersecting_regions(_census(spark, sf_dir), "CA11", "CT", target)


# --- United States ---


def _states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("AA", "0"), ("AA", "0"), ("BB", "1"), ("CC", "2")], "state string, state_code string")


@_query(
    """WITH n AS (SELECT UPPER(n_name[1:4]) || CAST(n_nationkey AS varchar) AS state, LPAD(CAST(n_nationkey AS varchar), 2, '0') AS state_code, n_nationkey FROM nation),
    a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN state ELSE state_code END AS asked, state, state_code FROM customer JOIN n ON n_nationkey = c_nationkey WHERE c_custkey % 7 <> 0)
    SELECT c_custkey, asked, state, state_code, 'r/' || LOWER(state) || state_code || 'trf.txt' AS path FROM a"""
)
def us_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States asked for by either name, some of them unknown, and where their files lie."""
    nation = read_table(spark, sf_dir, "nation")
    named = nation.select("n_nationkey", F.expr("concat(upper(substring(n_name, 1, 4)), n_nationkey)").alias("state"), F.expr("lpad(cast(n_nationkey as string), 2, '0')").alias("state_code"))
    customers = read_spread(spark, sf_dir, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = customers.select("c_custkey", F.expr("case when c_custkey % 7 = 0 then 'nowhere' when c_custkey % 2 = 0 then state else state_code end").alias("asked"))
    found = census_us.states_of(asked, named.union(named))
    return found.select("c_custkey", "asked", "state", "state_code", census_us.tract_path_column("r", "2010").alias("path"))


def _tract_file(spark: SparkSession, sf_dir: str, state: str | None = None) -> str:
    """The headerless file of 30 columns: suppliers to sixes of one state."""
    path = new_folder(spark)
    s = read_spread(spark, sf_dir, "supplier")
    s = s if state is None else s.where(F.expr(f"cast(s_suppkey % 3 as string) = '{state}'"))
    told = {"GEOID00": F.expr("concat('o', s_suppkey)"), "GEOID10": F.expr("concat('n', s_suppkey div 6 * 3 + s_suppkey % 3)"), "POP00": F.col("s_nationkey"), "STATE00": F.expr("cast(s_suppkey % 3 as string)")}
    s.select(*[told.get(name, F.lit("1")).cast("string").alias(name) for name, _ in census_us.TRACTS_2010]).write.csv(path)
    return path


@_query("SELECT 'o' || CAST(s_suppkey AS varchar) AS GEOID00, 'n' || CAST(s_suppkey // 6 * 3 + s_suppkey % 3 AS varchar) AS GEOID10, CAST(s_nationkey AS int) AS POP00, CAST(1 AS double) AS AREAPT FROM supplier")
def us_tracts_2010(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census_us.tracts_2010(spark, _tract_file(spark, sf_dir)).select("GEOID00", "GEOID10", "POP00", "AREAPT")


@_query("SELECT DISTINCT '0' || CAST(s_suppkey % 9 AS varchar) || CAST(s_suppkey AS varchar) AS GEOID10, '0' || CAST(s_suppkey % 9 AS varchar) || CAST(s_suppkey // 2 AS varchar) AS GEOID20 FROM supplier")
def us_tracts_2020(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    s = read_spread(spark, sf_dir, "supplier")
    parts = {"STATE": F.lit("0"), "COUNTY": F.expr("cast(s_suppkey % 9 as string)")}
    columns = [v.alias(f"{k}_20{y}") for y in ("10", "20") for k, v in parts.items()]
    rows = s.select(*columns, _text("s_suppkey").alias("TRACT_2010"), _text("s_suppkey div 2").alias("TRACT_2020"), F.lit("x").alias("NAMELSAD"))
    rows.union(rows).write.option("header", True).option("sep", "|").csv(path)
    return census_us.tracts_2020(spark, path)


def _text(expression: str) -> Column:
    return F.expr(f"cast({expression} as string)")


@_query("SELECT CAST(s_suppkey AS varchar) AS GEOID00, CAST(s_suppkey // 2 AS varchar) AS GEOID10 FROM supplier WHERE s_nationkey = 5")
def us_county_subdivisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    read_spread(spark, sf_dir, "supplier").select(_text("s_nationkey").alias("STATEFP10"), _text("s_suppkey").alias("GEOID00"), _text("s_suppkey div 2").alias("GEOID10"), F.lit("z").alias("NAME")).write.option("header", True).csv(path)
    return census_us.county_subdivisions(spark, path, "5")


@_query("SELECT MIN('o' || CAST(s_suppkey AS varchar)) AS common_id, CAST(SUM(s_nationkey) AS bigint) AS pop00, CAST(10 * COUNT(*) AS bigint) AS pop10 FROM supplier GROUP BY s_suppkey // 6 * 3 + s_suppkey % 3")
def us_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [Variable("pop", "pop00", "dec2000", geo_dataset="dec2000"), Variable("pop", "pop10", "dec2010", geo_dataset="dec2010")]
    links = lambda state: census_us.link_tracts(["dec2000", "dec2010"], census_us.tracts_2010(spark, _tract_file(spark, sf_dir, state[1])), None)
    return pipelines.harmonized_us_census(_census(spark, sf_dir), _states(spark), {"state": ["AA", "1", "CC"]}, rows, links).select("common_id", "pop00", "pop10")


# --- metadata ---


_DATASETS = [{"dataset": d, "description": f"{y} Canada Census", "geo_dataset": d} for d, y in (("CA06", 2006), ("CA11", 2011), ("CA16", 2016))] + [{"dataset": "TX2016", "description": "Taxes", "geo_dataset": "CA16"}]


@_query(
    """WITH a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(2001 + 5 * (c_custkey % 5) AS varchar) WHEN 1 THEN 'CA16' WHEN 2 THEN 'CA1996' ELSE 'TX' || CAST(c_custkey % 100 AS varchar) END AS asked FROM customer)
    SELECT c_custkey, asked, CASE WHEN c_custkey % 4 = 0 THEN 'CA' || asked[3:4] ELSE asked END AS dataset,
        CAST(CASE c_custkey % 4 WHEN 0 THEN asked WHEN 1 THEN '2016' WHEN 2 THEN '1996' ELSE CAST(2000 + c_custkey % 100 AS varchar) END AS integer) AS year FROM a"""
)
def meta_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of datasets from census years, and the years in the names."""
    text = "case c_custkey % 4 when 0 then cast(2001 + 5 * (c_custkey % 5) as string) when 1 then 'CA16' when 2 then 'CA1996' else concat('TX', c_custkey % 100) end"
    asked = read_spread(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("asked")).withColumn("dataset", meta.dataset_column(F.col("asked")))
    return asked.withColumn("year", meta.years_column(F.col("dataset")))


_DATASET_SQL = "(VALUES ('CA06', 2006, 'CA06'), ('CA11', 2011, 'CA11'), ('CA16', 2016, 'CA16'), ('CA11F', 2011, 'CA11')) d(dataset, year, geo_dataset)"


@_query(
    f"""WITH v AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CA16' WHEN 1 THEN 'CA11F' ELSE 'CA06' END AS dataset, CASE p_partkey % 3 WHEN 0 THEN 'v_CA16_' WHEN 1 THEN 'v_CA11F_' ELSE 'v_2006_' END AS stem FROM part),
    o AS (SELECT stem || CAST(p_partkey AS varchar) AS variable, CASE WHEN p_partkey % 2 = 0 THEN 'label ' || CAST(p_partkey AS varchar) ELSE stem || CAST(p_partkey AS varchar) END AS label, dataset, 'Original' AS type,
        CASE p_partkey % 5 WHEN 0 THEN 'Average' WHEN 1 THEN 'Additive' WHEN 2 THEN 'Median' WHEN 3 THEN 'Not additive' ELSE '0' END AS rule, CASE WHEN p_partkey % 5 IN (0, 2) THEN stem || 'base' || CAST(p_partkey % 7 AS varchar) END AS parent FROM v),
    e AS (SELECT DISTINCT parent AS variable, parent AS label, dataset, 'Extra' AS type, 'Additive' AS rule, CAST(NULL AS varchar) AS parent FROM o WHERE parent IS NOT NULL)
    SELECT variable, label, dataset, type, rule, parent, geo_dataset, year FROM (SELECT * FROM o UNION ALL SELECT * FROM e) JOIN {_DATASET_SQL} USING (dataset)"""
)
def meta_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and parents from aggregation texts, extras for parents, datasets and geographies from the catalog, for a vector per part."""
    stem = "case p_partkey % 3 when 0 then 'v_CA16_' when 1 then 'v_CA11F_' else 'v_2006_' end"
    vectors = read_spread(spark, sf_dir, "part").select("p_partkey", F.expr(f"concat({stem}, p_partkey)").alias("variable"), F.expr("if(p_partkey % 2 = 0, concat('label ', p_partkey), '')").alias("label"), F.expr(stem).alias("stem"))
    text = "case p_partkey % 5 when 0 then concat('Average of ', stem, 'base', p_partkey % 7) when 1 then 'Additive' when 2 then concat('Median of ', stem, 'base', p_partkey % 7) when 3 then 'Not additive' end"
    catalog = vectors.select(F.col("variable").alias("vector"), F.expr(text).alias("aggregation")).where("aggregation is not null")
    datasets = spark.createDataFrame([tuple(d.values()) for d in _DATASETS], "dataset string, description string, geo_dataset string")
    made = meta.vector_columns(vectors, catalog, datasets)
    return made.select("variable", "label", "dataset", "type", "rule", "parent", "geo_dataset", "year")


@_query(
    """WITH m AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'Population' ELSE 'v_' || CAST(s_suppkey AS varchar) END AS variable, 'label ' || CAST(s_suppkey AS varchar) AS label, 'CA' || CAST(s_suppkey // 8 AS varchar) AS geo_dataset FROM supplier),
    b AS (SELECT variable, variable || '_' || geo_dataset AS label, geo_dataset FROM (SELECT DISTINCT geo_dataset FROM m) CROSS JOIN (VALUES ('Population'), ('Dwellings'), ('Households')) v(variable))
    SELECT * FROM m UNION ALL SELECT b.* FROM b ANTI JOIN m USING (variable, geo_dataset)"""
)
def meta_base_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of people, dwellings and households that geographies lack, eight suppliers to a geography."""
    text = "if(s_suppkey % 4 = 0, 'Population', concat('v_', s_suppkey))"
    rows = read_spread(spark, sf_dir, "supplier").select(F.expr(text).alias("variable"), F.expr("concat('label ', s_suppkey)").alias("label"), F.expr("concat('CA', s_suppkey div 8)").alias("geo_dataset"))
    return meta.base_columns(rows)


@_query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'conf' || CAST(c_custkey AS varchar) WHEN c_custkey % 3 = 0 THEN 'env' WHEN c_custkey % 5 <> 0 THEN 'older' ELSE 'shared' END AS folder FROM customer"""
)
def cache_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a customer's settings names the cache folder; blank ones don't count."""
    settings = ("if(c_custkey % 2 = 0, concat('conf', c_custkey), '')", "case when c_custkey % 3 = 0 then 'env' when c_custkey % 3 = 1 then '  ' end", "if(c_custkey % 5 = 0, null, 'older')", "'shared'")
    return read_spread(spark, sf_dir, "customer").select("c_custkey", preferred(*map(F.expr, settings)).alias("folder"))


@_query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that stand in several rows: what the uniqueness assertions find."""
    return aggregate.repeated(read_table(spark, sf_dir, "orders"), ["o_custkey"])


@_query("SELECT * FROM (VALUES ('labels', true), ('parent', true), ('identifier', true), ('no key', true), ('names', true), ('level', true), ('method', true)) t(what, raised)")
def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that must be refused."""
    s = read_spread(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("a"), "s_acctbal")
    units = s.select("a", F.lit("u").alias("b"))
    twice = close_correspondence(units).union(close_correspondence(units).withColumn("common_id", F.lit("z")))
    cases: dict[str, Callable[[], object]] = {
        "labels": lambda: aggregate.rename_with_meta(s, [Variable("a", "x"), Variable("a", "y")]),
        "parent": lambda: aggregate.aggregate_with_meta(s, [Variable("s_acctbal", "x", rule=meta.AVERAGE, parent="none")], ["a"]),
        "identifier": lambda: aggregate.join_correspondence(s, twice),
        "no key": lambda: aggregate.join_correspondence(s.withColumnRenamed("a", "q"), close_correspondence(units)),
        "names": lambda: estimate.geometric_pairs(s, s, "a", "a"),
        "level": lambda: census_ca.relationship_file(spark, "none", "2016", "CT"),
        "method": lambda: census_ca.census_correspondence(_census(spark, sf_dir), ["CA11", "CA16"], None, method="guess"),
    }
    found = []
    for what, case in cases.items():
        try:
            case()
            found.append((what, False))
        except ValueError:
            found.append((what, True))
    return spark.createDataFrame(found, "what string, raised boolean")


# --- geometries ---


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of 4 by 4 with a hole of 2 by 2, and every third one with a second, whole polygon, as WKT."""
    wkt = """concat('MULTIPOLYGON (((', x, ' ', y, ', ', x + 4, ' ', y, ', ', x + 4, ' ', y + 4, ', ', x, ' ', y + 4, ', ', x, ' ', y, '), (', x + 1, ' ', y + 1, ', ', x + 1, ' ', y + 3, ', ', x + 3, ' ', y + 3, ', ',
        x + 3, ' ', y + 1, ', ', x + 1, ' ', y + 1, '))', if(p_partkey % 3 = 0, concat(', ((', x + 5, ' ', y, ', ', x + 6, ' ', y, ', ', x + 6, ' ', y + 1, ', ', x + 5, ' ', y, '))'), ''), ')')"""
    return read_spread(spark, sf_dir, "part").withColumns({"x": F.expr("p_partkey % 20 * 10"), "y": F.expr("p_partkey div 20 * 10")}).select("p_partkey", F.expr(wkt).alias("wkt"))


_SQUARES = "SELECT p_partkey, CAST(12 + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0 END AS double) AS area, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS polygons, CAST(p_partkey % 20 * 10 AS double) AS x0 FROM part"


def _measured(df: DataFrame) -> DataFrame:
    g = F.col("geometry")
    return df.select("p_partkey", shapes.area(g).alias("area"), F.size("geometry.polygons").alias("polygons"), shapes.bbox(g)["x0"].alias("x0"))


@_query(_SQUARES)
def source_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with a WKT column."""
    path = new_folder(spark)
    _squares(spark, sf_dir).write.option("header", True).csv(path)
    return _measured(geometries.read_wkt(spark, path, "wkt").withColumn("p_partkey", F.col("p_partkey").cast("long")))


@_query(_SQUARES)
def wkt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = geometries.to_wkt(geometries.from_wkt(F.col("wkt")))
    return _measured(_squares(spark, sf_dir).withColumn("geometry", geometries.from_wkt(text)))


@_query(_SQUARES)
def source_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of features, with a collection for the squares of two parts."""
    path = new_folder(spark)
    g = geometries.from_wkt(F.col("wkt"))
    rings = F.transform(g["polygons"], lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.array(c["x"], c["y"]))))
    parts = F.transform(rings, lambda p: F.struct(F.lit("Polygon").alias("type"), p.alias("coordinates")))
    collection = F.to_json(F.struct(F.lit("GeometryCollection").alias("type"), parts.alias("geometries")))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(rings, F.lit(0)).alias("coordinates")))
    feature = F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"p_partkey": '), "p_partkey", F.lit('}, "geometry": '), F.when(F.size(rings) > 1, collection).otherwise(single), F.lit("}]}"))
    _squares(spark, sf_dir).select(feature.alias("value")).write.text(path)
    rows = geometries.read_features(spark, path, 0, lines=True)
    return _measured(rows.withColumn("p_partkey", F.col("properties")["p_partkey"].cast("long")))


@_query("SELECT p_partkey, CAST(1 AS double) AS area, 1 AS polygons, CAST(p_partkey % 20 AS double) AS x0 FROM part")
def source_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares as little-endian well-known bytes."""

    def packed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in parts:
            corners = [(x, y, x + 1, y, x + 1, y + 1, x, y + 1, x, y) for x, y in zip(xs, ys, strict=True)]
            yield pd.Series([struct.pack("<BIII10d", 1, 3, 1, 5, *c) for c in corners])

    packed.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    part = read_spread(spark, sf_dir, "part")
    bytes_ = F.pandas_udf(packed, "binary")(F.expr("cast(p_partkey % 20 as double)"), F.expr("cast(p_partkey div 20 as double)"))
    return _measured(part.select("p_partkey", geometries.from_wkb(bytes_).alias("geometry")))


@_query("SELECT p_partkey, 'POLYGON' AS kind, CAST(0.5 AS double) AS area FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'GEOMETRYCOLLECTION', CAST(0.5 AS double) FROM part WHERE p_partkey % 4 = 1")
def polygonal_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and lines go; of collections the polygons stay."""
    shape = "concat('POLYGON ((0 0, 1 0, ', 1, ' ', 1, ', 0 0))')"
    text = f"case p_partkey % 4 when 0 then {shape} when 1 then concat('GEOMETRYCOLLECTION (POINT (1 2), MULTILINESTRING ((0 0, 1 1), (2 2, 3 3)), ', {shape}, ')') when 2 then 'POINT (3 4)' else 'LINESTRING (0 0, 5 5)' end"
    rows = read_spread(spark, sf_dir, "part").select("p_partkey", F.expr(text).alias("wkt"))
    kept = geometries.keep_polygonal(rows.withColumn("geometry", geometries.from_wkt(F.col("wkt"))), quiet=True)
    return kept.select("p_partkey", geometries.geometry_type(F.col("wkt")).alias("kind"), shapes.area(F.col("geometry")).alias("area"))


@_query("SELECT p_partkey, p_partkey % 3 = 2 AS before, true AS after, CAST(1 AS double) AS area FROM part")
def made_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rings, wrong turns and rings of no area are mended."""
    p = lambda *xy: F.array(*[shapes.point(F.lit(x), F.lit(y)) for x, y in xy])
    open_, flat, good = p((0, 0), (0, 1), (1, 1), (1, 0)), p((5, 5), (6, 6), (5, 5)), p((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))
    k = F.col("p_partkey") % 3
    polygons = F.when(k == 0, F.array(F.array(open_))).when(k == 1, F.array(F.array(good), F.array(flat))).otherwise(F.array(F.array(good)))
    raw = read_spread(spark, sf_dir, "part").select("p_partkey", F.struct(F.lit(0).alias("srid"), polygons.alias("polygons")).alias("geometry"))
    done = geometries.make_sound(raw.withColumn("before", shapes.has_sound_rings(F.col("geometry"))))
    return done.select("p_partkey", "before", shapes.has_sound_rings(F.col("geometry")).alias("after"), shapes.area(F.col("geometry")).alias("area"))


@_query("SELECT p_partkey, CAST(GREATEST(0, LEAST(p_partkey % 20 + 3, 10.5) - GREATEST(p_partkey % 20, 4.25)) AS double) AS area FROM part")
def clip_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("cast(p_partkey % 20 as double)")
    boxes = read_spread(spark, sf_dir, "part").select("p_partkey", shapes.rectangle(x, F.lit(0.0), x + 3, F.lit(1.0)).alias("geometry"))
    mask = shapes.rectangle(F.lit(4.25), F.lit(-5.0), F.lit(10.5), F.lit(5.0))
    return boxes.select("p_partkey", F.round(shapes.area(shapes.clip_convex(F.col("geometry"), mask)), 9).alias("area"))


@_query("SELECT n_nationkey, ROUND(6371010.0 * 6371010.0 * 2 * ATAN2(TAN(RADIANS(n_nationkey + 1) / 2) * (TAN(RADIANS(10) / 2) + TAN(RADIANS(10) / 2)), 1 + TAN(RADIANS(10) / 2) * TAN(RADIANS(10) / 2)) / 1000000, 3) AS km2 FROM nation")
def sphere_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitude and latitude: the area between the equator and the great circle over two points of 10 degrees north."""
    east = F.expr("cast(n_nationkey + 1 as double)")
    shape = shapes.polygon([(F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(10.0)), (east, F.lit(10.0)), (east, F.lit(0.0))], shapes.LONLATS[0])
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.round(shapes.area(shape) / 1000000, 3).alias("km2"))


@_query("SELECT CAST(COUNT(*) AS double) AS area FROM part")
def dissolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows to one geometry."""
    x, y = F.expr("cast(p_partkey % 20 as double)"), F.expr("cast(p_partkey div 20 as double)")
    boxes = read_spread(spark, sf_dir, "part").select(shapes.rectangle(x, y, x + 1, y + 1).alias("geometry"))
    return dissolve.dissolve(boxes, []).select(shapes.area(F.col("geometry")).alias("area"))


@_query(
    """WITH a AS (SELECT 'a' || CAST(s_suppkey AS varchar) AS a, s_suppkey AS k FROM supplier), b AS (SELECT 'b' || CAST(s_suppkey AS varchar) AS b, s_suppkey AS k FROM supplier)
    SELECT a, b FROM a JOIN b USING (k) WHERE k % 2 = 0"""
)
def geo_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips a million long against strips shifted by half their height: they meet by a hundredth at one tolerance, by nothing at the other."""
    s = read_spread(spark, sf_dir, "supplier")
    low = F.expr("s_suppkey * 1000.0D")
    shift = F.expr("if(s_suppkey % 2 = 0, 50.0D, 50.02D)")
    a = s.select(F.expr("concat('a', s_suppkey)").alias("a"), shapes.rectangle(F.lit(0.0), low, F.lit(1e6), low + 100).alias("geometry"))
    b = s.select(F.expr("concat('b', s_suppkey)").alias("b"), shapes.rectangle(F.lit(0.0), low + shift, F.lit(1e6), low + shift + 100).alias("geometry"))
    return estimate.geometric_pairs(a, b, "a", "b", 49.99)


@_query("SELECT 'all' AS t, CAST(SUM(p_size) AS double) AS p_size FROM part UNION ALL SELECT 'unit', CAST(SUM(p_size) AS double) FROM part WHERE p_partkey % 20 = 3 AND p_partkey // 20 = 2")
def estimate_on_huge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One huge polygon and a small one as targets of many small sources."""
    x, y = F.expr("cast(p_partkey % 20 as double)"), F.expr("cast(p_partkey div 20 as double)")
    source = read_spread(spark, sf_dir, "part").select("p_partkey", "p_size", shapes.rectangle(x, y, x + 1, y + 1).alias("geometry"))
    huge = shapes.rectangle(F.lit(-1e6), F.lit(-1e6), F.lit(2e6), F.lit(2e6))
    target = spark.range(1).select(F.lit("all").alias("t"), huge.alias("geometry")).union(spark.range(1).select(F.lit("unit").alias("t"), shapes.rectangle(F.lit(3.0), F.lit(2.0), F.lit(4.0), F.lit(3.0)).alias("geometry")))
    done = estimate.estimate(target, source, meta.meta_for_additive_variables("x", {"p_size": "p_size"}), "t", "p_partkey", na_rm=True)
    return done.select("t", F.round("p_size", 4).alias("p_size"))


@_query("SELECT 'g' || CAST(s_suppkey // 3 AS varchar) AS common_id, CAST(COUNT(*) AS double) AS area1, CAST(COUNT(*) AS double) * 4 AS area2, ROUND(-LN(4), 9) AS log_ratio FROM supplier GROUP BY 1")
def area_check_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.expr("cast(s_suppkey % 20 as double)"), F.expr("cast(s_suppkey div 20 as double)")
    one, two = (read_spread(spark, sf_dir, "supplier").select("s_suppkey", shapes.rectangle(x, y, x + k, y + k).alias("geometry")) for k in (1, 2))
    units = one.select("s_suppkey", F.expr("concat('g', s_suppkey div 3)").alias("common_id"))
    done = estimate.check_two_areas(one, two, units)
    return done.select("common_id", "area1", "area2", F.round("log_ratio", 9).alias("log_ratio"))


# --- elections ---


@_query(
    """WITH n AS (SELECT p_partkey, p_partkey % 20 AS i, p_partkey // 20 AS j FROM part), g AS (SELECT i, j, '590' || CAST(j % 4 AS varchar) AS fed, CAST(p_partkey + 1 AS varchar) AS pd, CASE WHEN j % 2 = 1 THEN 2 ELSE 1 END AS w FROM n WHERE j % 2 = 0 OR i % 2 = 0)
    SELECT fed || '_' || CAST(j // 4 + 600 AS varchar) AS AP_2019, fed || '_' || pd AS PD_2019, CAST(w AS double) AS area FROM g"""
)
def example_geographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example geographies, a district per part, with the keys of their votes."""
    numbers = read_spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    geos = examples.example_geographies(spark, 2019, numbers=numbers).drop("PD_2019", "AP_2019")
    keyed = elections.polling_geographies(geos, examples.example_votes(spark, 2019, numbers=numbers), 2019)
    return keyed.select("AP_2019", "PD_2019", shapes.area(F.col("geometry")).alias("area"))


@_query("SELECT '590' || CAST(p_partkey // 20 % 4 AS varchar) AS fed, CAST(COUNT(*) AS integer) AS districts, CAST(4 * COUNT(*) AS integer) AS votes, CAST(COUNT(*) AS double) AS area FROM part GROUP BY 1")
def example_elections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example votes of 2015, and the geographies of an electoral district as one."""
    numbers = read_spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    geos, votes = examples.example_geographies(spark, 2015, numbers=numbers), examples.example_votes(spark, 2015, numbers=numbers)
    one = dissolve.dissolve(geos, ["FED_NUM"]).select("FED_NUM", F.round(shapes.area(F.col("geometry")), 6).alias("area"))
    told = votes.groupBy("FED_NUM").agg(F.countDistinct("PD_2015").cast("int").alias("districts"), F.count("*").cast("int").alias("votes"))
    return told.join(one, "FED_NUM").select(F.col("FED_NUM").alias("fed"), "districts", "votes", "area")


# --- rows ---


@_query("SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS int) AS n FROM orders QUALIFY n <= 2")
def first_two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("n")).where("n <= 2")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort and limit: a report of the 25 largest."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@_query("SELECT l_orderkey, l_linenumber, ROUND(l_quantity + l_discount + CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END, 6) AS total FROM lineitem")
def row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums across columns; a missing value makes the row's sum missing."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("t", F.expr("if(l_linenumber % 3 = 0, null, l_tax)"))
    return lines.select("l_orderkey", "l_linenumber", F.round(reshape.row_sum("l_quantity", "l_discount", "t"), 6).alias("total"))


@_query("SELECT s_suppkey, n_name, c_custkey FROM (SELECT s_suppkey, s_nationkey AS k FROM supplier) JOIN (SELECT n_nationkey AS k, n_name FROM nation) USING (k) JOIN (SELECT c_custkey, c_nationkey AS k FROM customer) USING (k)")
def many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_spread(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = read_spread(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return reshape.all_matches(s.join(n, "k"), c, "k").select("s_suppkey", "n_name", "c_custkey")


@_query("SELECT l_suppkey, ROUND(SUM(l_discount) / COUNT(*), 9) AS mean, COUNT(*) AS n FROM lineitem GROUP BY 1")
def mean_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reshape.mean_and_count(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount")
    return found.select("l_suppkey", F.round("mean", 9).alias("mean"), "n")
