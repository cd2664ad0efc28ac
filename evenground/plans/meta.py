"""Metadata of variables: which column of which dataset aggregates by which rule. It is plan input and lives on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Aggregation rules and unit texts of census metadata.
ADDITIVE, AVERAGE, MEDIAN, AVERAGE_TO, NOT_ADDITIVE = "Additive", "Average", "Median", "AverageTo", "Not additive"
RATIO_UNITS, PERCENT_UNITS = "Percentage ratio (0.0-1.0)", "Percentage (0-100)"
CA_BASE = ("Population", "Dwellings", "Households")
_CA_YEARS = {"2001": "CA01", "2006": "CA06", "2011": "CA11", "2016": "CA16", "2021": "CA21"}


@dataclass(frozen=True)
class Variable:
    variable: str
    label: str
    dataset: str | None = None
    type: str = "Manual"
    aggregation: str = ADDITIVE
    units: str | None = None
    rule: str = ADDITIVE
    parent: str | None = None
    geo_dataset: str | None = None
    year: int | None = None
    downsample: str | None = None


def meta_to_df(spark: SparkSession, meta: Iterable[Variable]) -> DataFrame:
    """The metadata as a table: all strings but the year."""
    names = [f.name for f in fields(Variable)]
    schema = ", ".join(f"`{n}` {'int' if n == 'year' else 'string'}" for n in names)
    return spark.createDataFrame([tuple(asdict(m)[n] for n in names) for m in meta], schema)


def meta_for_additive_variables(dataset: str | list[str], variables: list[str] | Mapping[str, str]) -> list[Variable]:
    """Counts: one row per variable (a mapping is label -> variable); the default label is ``<variable>_<dataset>``."""
    pairs = list(variables.items()) if isinstance(variables, Mapping) else [(None, v) for v in variables]
    sets = [dataset] * len(pairs) if isinstance(dataset, str) else list(dataset)
    if len(sets) != len(pairs):
        if len(pairs) == 1:
            pairs = pairs * len(sets)
        elif len(sets) == 1:
            sets = sets * len(pairs)
        else:
            raise ValueError("datasets and variables differ in number")
    return [Variable(v, label or f"{v}_{ds}", ds, geo_dataset=ds) for (label, v), ds in zip(pairs, sets, strict=True)]


def cut_meta(columns: Iterable[str], meta: Iterable[Variable]) -> list[tuple[str, Variable]]:
    """(column, variable) for metadata whose variable, or else label, is a column."""
    have = set(columns)
    return [(m.variable if m.variable in have else m.label, m) for m in meta if m.variable in have or m.label in have]


def parse_aggregation(text: str | None) -> tuple[str | None, str | None]:
    """(rule, parent) of an aggregation text such as "Average of v_1"."""
    if text is None:
        return None, None
    words = text.split(" ")
    if "Average of" in text:
        rule = AVERAGE
    elif "Median of" in text:
        rule = MEDIAN
    elif text in (NOT_ADDITIVE, ADDITIVE):
        rule = text
    elif "Average to" in text:
        rule = AVERAGE_TO
    else:
        rule = re.sub(" .+$", "", text)
    return rule, words[2] if len(words) == 3 else None


def rule_column(text: Column) -> Column:
    """parse_aggregation's rule of a text column."""
    rule = F.when(text.contains("Average of"), AVERAGE).when(text.contains("Median of"), MEDIAN).when(text == NOT_ADDITIVE, NOT_ADDITIVE)
    return rule.when(text == ADDITIVE, ADDITIVE).when(text.contains("Average to"), AVERAGE_TO).otherwise(F.regexp_replace(text, " .+$", ""))


def parent_column(text: Column) -> Column:
    """parse_aggregation's parent of a text column."""
    words = F.split(text, " ")
    return F.when(F.size(words) == 3, words[2])


def years_column(dataset: Column) -> Column:
    """The year of a dataset name: its first run of digits, filled up from the left to 3 by "0", then to 4 by "2"."""
    digits = F.regexp_extract(dataset, r"\d+", 0)
    return F.when(digits != "", F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(F.lpad(digits, 3, "0"), 4, "2")).try_cast("int"))


def year_of(dataset: str) -> int | None:
    found = re.search(r"\d+", dataset)
    return int(found[0].rjust(3, "0").rjust(4, "2")) if found else None


def dataset_column(asked: Column) -> Column:
    """normalize_datasets of a text column."""
    known = F.create_map(*[F.lit(x) for pair in _CA_YEARS.items() for x in pair])
    return F.coalesce(known[asked], asked)


def additive_columns(variables: DataFrame, dataset: Column) -> DataFrame:
    """meta_for_additive_variables for a table of ``variable`` and ``label`` (blank: variable and dataset)."""
    label = F.when(F.coalesce(F.col("label"), F.lit("")) == "", F.concat_ws("_", "variable", dataset)).otherwise(F.col("label"))
    return variables.select("variable", label.alias("label"), dataset.alias("dataset"), F.lit("Manual").alias("type"), F.lit(ADDITIVE).alias("aggregation"), F.lit(ADDITIVE).alias("rule"))


def base_columns(meta: DataFrame) -> DataFrame:
    """add_base_variables for a table (``variable``, ``label``, ``geo_dataset``): the rows, and the counts that a geography lacks."""
    base = F.explode(F.array(*map(F.lit, CA_BASE))).alias("variable")
    more = meta.select("geo_dataset").distinct().select("geo_dataset", base).join(meta.select("geo_dataset", "variable"), ["geo_dataset", "variable"], "left_anti")
    return meta.select("variable", "label", "geo_dataset").unionByName(more.select("variable", F.concat_ws("_", "variable", "geo_dataset").alias("label"), "geo_dataset"))


def vector_columns(vectors: DataFrame, vector_catalog: DataFrame, dataset_catalog: DataFrame) -> DataFrame:
    """meta_for_census_vectors for a table of vectors (``variable``, ``label``; a blank label is the vector) and catalogs as tables.

    Parents that aren't asked for follow as rows of type Extra, once per dataset.
    """
    years = dataset_catalog.where(F.col("description").rlike(r"^\d{4} Canada Census( and NHS)?$")).select(F.substring("description", 1, 4).alias("_year"), F.col("geo_dataset").alias("_of_year")).distinct()
    part = F.split("variable", "_")[1]
    asked = vectors.select("variable", F.when(F.coalesce(F.col("label"), F.lit("")) == "", F.col("variable")).otherwise(F.col("label")).alias("label"), part.alias("_year"))
    named = asked.join(years, "_year", "left").select("variable", "label", F.coalesce("_of_year", "_year").alias("dataset"))
    told = named.join(vector_catalog.select(F.col("vector").alias("variable"), "aggregation"), "variable", "left").withColumn("aggregation", F.coalesce("aggregation", F.lit("0")))
    made = told.select("variable", "label", "dataset", F.lit("Original").alias("type"), rule_column(F.col("aggregation")).alias("rule"), parent_column(F.col("aggregation")).alias("parent"))
    extras = made.where("parent is not null").select(F.col("parent").alias("variable"), "dataset").distinct().join(named.select("variable"), "variable", "left_anti")
    more = extras.select("variable", F.col("variable").alias("label"), "dataset", F.lit("Extra").alias("type"), F.lit("Additive").alias("rule"), F.lit(None).cast("string").alias("parent"))
    both = made.unionByName(more).withColumn("_base", F.regexp_replace(F.regexp_replace("dataset", "^CA11[NF]$", "CA11"), r"\d{4}x", ""))
    geo = dataset_catalog.select(F.col("dataset").alias("_base"), "geo_dataset").distinct()
    return both.join(geo, "_base", "left").drop("_base").withColumn("year", years_column(F.col("dataset")))


def normalize_datasets(datasets: Iterable[str]) -> list[str]:
    """Census years become dataset names (2001 to 2021); other names stay."""
    return [_CA_YEARS.get(str(d), str(d)) for d in datasets]


def geo_dataset_for_year(year: str, catalog: Iterable[Mapping[str, str]]) -> str:
    """The geography of the census of a year, from a catalog of (dataset, description, geo_dataset)."""
    wanted = (f"{year} Canada Census", f"{year} Canada Census and NHS")
    found = list(dict.fromkeys(r["geo_dataset"] for r in catalog if r["description"] in wanted))
    if len(found) != 1:
        raise ValueError(f"no single geography for {year}")
    return found[0]


def geo_dataset_of(dataset: str, catalog: Iterable[Mapping[str, str]]) -> str:
    """The geography that a dataset is published on."""
    name = re.sub(r"\d{4}x", "", re.sub("^CA11[NF]$", "CA11", dataset))
    found = list(dict.fromkeys(r["geo_dataset"] for r in catalog if r["dataset"] == name))
    if len(found) != 1:
        raise ValueError(f"no single geography for {dataset}")
    return found[0]


def dataset_of_vector(vector: str, catalog: Iterable[Mapping[str, str]] = ()) -> str:
    """The dataset in a vector's name (its second part); a year stands for that census."""
    part = vector.split("_")[1]
    return geo_dataset_for_year(part, catalog) if re.fullmatch(r"\d{4}", part) else part


def meta_for_census_vectors(
    vectors: list[str] | Mapping[str, str], vector_catalog: Iterable[Mapping[str, str]], dataset_catalog: Iterable[Mapping[str, str]]
) -> list[Variable]:
    """Metadata of census vectors (a mapping is label -> vector), with a row of type Extra for each parent not asked for.

    ``vector_catalog``: rows of (vector, aggregation, units); vectors that it lacks keep the aggregation "0". Extras are the
    different (parent, dataset) pairs.
    """
    datasets = list(dataset_catalog)
    told = {r["vector"]: r for r in vector_catalog}
    pairs = list(vectors.items()) if isinstance(vectors, Mapping) else [(v, v) for v in vectors]
    meta = []
    for label, vector in pairs:
        dataset = dataset_of_vector(vector, datasets)
        row = told.get(vector, {"aggregation": "0", "units": None})
        rule, parent = parse_aggregation(row["aggregation"])
        meta.append(Variable(vector, label or vector, dataset, "Original", row["aggregation"], row["units"], rule, parent))
    asked = {m.variable for m in meta}
    extras = dict.fromkeys((m.parent, m.dataset) for m in meta if m.parent is not None and m.parent not in asked)
    meta += [Variable(parent, parent, dataset, "Extra") for parent, dataset in extras]
    return [replace(m, geo_dataset=geo_dataset_of(m.dataset, datasets), year=year_of(m.dataset)) for m in meta]


def add_base_variables(meta: list[Variable]) -> list[Variable]:
    """``meta`` and the counts of people, dwellings and households that a geography still lacks."""
    out = list(meta)
    for ds in dict.fromkeys(m.geo_dataset for m in meta):
        have = {m.variable for m in meta if m.geo_dataset == ds}
        out += [replace(m, units="Number", year=year_of(ds)) for m in meta_for_additive_variables(ds, [v for v in CA_BASE if v not in have])]
    return out
