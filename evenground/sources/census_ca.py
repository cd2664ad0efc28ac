"""Canadian census: relationship files and correspondences between census geographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.operators.correspondence import METHOD, chain_correspondences, close_correspondence, combine_correspondences
from evenground.operators.estimate import estimate_correspondence
from evenground.plans.meta import geo_dataset_for_year, normalize_datasets, year_of
from evenground.sources.provider import Provider, cache_folder

YEARS, LEVELS = ("2006", "2011", "2016", "2021"), ("DA", "DB")
# Rows of the 2021 files that record a boundary shift without people.
SHIFTED_DB, SHIFTED_DA = "59150934010", ("59150934", "59150936")


def relationship_schema(year: str, level: str) -> str:
    new, old = f"{level}UID{year}", f"{level}UID{int(year) - 5}"
    names = [new, old, "flag"] if level == "DB" else [new, old, f"DBUID{year}", "flag"]
    return ", ".join(f"{n} string" for n in names)


def relationship_file(spark: SparkSession, path: str, year: str, level: str, cache: str | bool | None = None) -> DataFrame:
    """New id, old id and flag of one relationship file (CSV, all text): different rows without repeated headers and shifted rows.

    ``cache`` (a folder, or True for ``cache_folder``): the clean rows are kept there as CSV and read back if present.
    """
    if level not in LEVELS or str(year) not in YEARS:
        raise ValueError("level is DA or DB, year 2006, 2011, 2016 or 2021")
    year = str(year)
    new, old = f"{level}UID{year}", f"{level}UID{int(year) - 5}"
    rows = spark.read.schema(relationship_schema(year, level)).csv(path).select(new, old, "flag").distinct().where(~F.col(new).contains(new))
    if cache:
        cache = cache_folder(spark) if cache is True else cache
        kept = f"{cache}/correspondence_{year}_{level}"
        rows.write.mode("ignore").option("header", True).csv(kept)
        rows = spark.read.schema(f"{new} string, {old} string, flag string").option("header", True).csv(kept)
    if year == "2021":
        rows = rows.where(F.col(new) != SHIFTED_DB) if level == "DB" else rows.where(~((F.col(new) == SHIFTED_DA[0]) & (F.col(old) == SHIFTED_DA[1])))
    return rows


def relationship_correspondence(
    provider: Provider, files: dict[str, DataFrame], geo_datasets: list[str], regions: dict[str, list[str]] | None, level: str = "CT"
) -> DataFrame:
    """The closed correspondence of census geographies over relationship files; ``files``: a clean file per year (of DB or DA level).

    Census years between the asked ones are chained; unit ids are linked to the files' ids by the units of the level itself, or for CT by the
    DA units that carry a CT id.
    """
    geo_datasets = normalize_datasets(geo_datasets)
    if level not in ("DB", "DA", "CT"):
        raise ValueError("relationship files know the levels DB, DA and CT")
    base = level if level in LEVELS else "DA"
    asked = [year_of(ds) for ds in geo_datasets]
    years = list(range(min(asked), max(asked) + 1, 5))
    names = {y: geo_dataset_for_year(str(y), provider.catalog("datasets")) for y in years}
    links: dict[int, DataFrame] = {}
    for y in years:
        column, match = f"{base}UID{y}", f"GeoUID{names[y]}"
        if level != "CT":
            links[y] = provider.census(names[y], regions, level).select(F.col("GeoUID").alias(match), F.col("GeoUID").alias(column))
        elif names[y] in geo_datasets:
            links[y] = provider.census(names[y], regions, "DA").select(F.col("CT_UID").alias(match), F.col("GeoUID").alias(column))
    steps = []
    for before, year in zip(years, years[1:], strict=False):
        step = files[str(year)].drop("flag")
        for y in (year, before):
            if y in links:
                column = f"{base}UID{y}"
                step = step.join(links[y], column).drop(column).distinct()
        steps.append(step.withColumn(METHOD, F.lit("statcan")))
    joined = combine_correspondences(steps) if len(steps) > 1 else steps[0]
    return close_correspondence(joined.select(*[f"GeoUID{ds}" for ds in geo_datasets], METHOD).distinct())


def census_correspondence(
    provider: Provider, geo_datasets: list[str], regions: dict[str, list[str]] | None, level: str = "CT", method: str = "statcan", files: dict[str, DataFrame] | None = None, tolerance: float = 200.0
) -> DataFrame:
    """By relationship files ("statcan"), by geometry ("estimate"), or by common ids and geometry ("identifier")."""
    if method == "statcan":
        return relationship_correspondence(provider, files or {}, geo_datasets, regions, level)
    if method not in ("estimate", "identifier"):
        raise ValueError(f"unknown method {method}")
    names = normalize_datasets(geo_datasets)
    data = {ds: provider.census(ds, regions, level).withColumn(f"GeoUID{ds}", F.col("GeoUID")) for ds in names}
    return estimate_correspondence(data, {ds: f"GeoUID{ds}" for ds in names}, method, tolerance)


def relationship_chain(files: list[DataFrame]) -> DataFrame:
    """Files joined from the newest on by the ids that they share, rows of the first all kept, and closed (the older way)."""
    return chain_correspondences([f.drop("flag") for f in files])
