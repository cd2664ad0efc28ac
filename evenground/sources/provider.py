"""Where census tables come from: a protocol, and tables in a local or shared folder."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.operators.geometry.crs import reconciled
from evenground.operators.geometry.overlap import overlaps
from evenground.runtime import shared_folder


#: Ids of regions by level: a list, or a table of one column where they are many.
Regions = dict[str, "list[str] | DataFrame"]


class Provider(Protocol):
    def census(self, dataset: str, regions: Regions | None, level: str) -> DataFrame:
        """GeoUID, counts, variables, ids of the levels above (``<level>_UID``) and geometry of a dataset's units at a level."""

    def catalog(self, name: str) -> list[dict[str, str]]:
        """A lookup table: datasets, vectors or states."""


#: Settings that name the cache folder: of the session, of the environment, and an older one of the session.
CACHE_SETTING, CACHE_VARIABLE, OLDER_SETTING = "spark.evenground.cache", "EVENGROUND_CACHE", "spark.evenground.data"


def preferred(*told: Column) -> Column:
    """The first of several settings that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in told])


def cache_folder(spark: SparkSession) -> str:
    """Where source files are kept: the first of the settings that isn't blank, else the shared folder of the session."""
    told = (spark.conf.get(CACHE_SETTING, None), os.environ.get(CACHE_VARIABLE), spark.conf.get(OLDER_SETTING, None))
    return next((x for x in told if x and x.strip()), None) or shared_folder(spark)


def in_regions(table: DataFrame, regions: Regions | None, level: str) -> DataFrame:
    """The rows of ``table`` in any of the regions: by their own id, or by the id of the level above that they carry.

    Ids in a table are joined: they never pass the driver.
    """
    if not regions:
        return table
    kept, flags = F.lit(False), []
    for number, (above, ids) in enumerate(regions.items()):
        column = "GeoUID" if above == level else f"{above}_UID"
        if isinstance(ids, DataFrame):
            flag = f"_in_{number}"
            table = table.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct().withColumn(flag, F.lit(True)), column, "left")
            flags.append(flag)
            kept = kept | F.coalesce(flag, F.lit(False))
        else:
            kept = kept | F.col(column).isin(ids)
    columns = [c for c in table.columns if c not in flags]
    return table.where(kept).select(columns)


@dataclass
class FolderProvider:
    """Parquet tables ``<root>/<dataset>_<level>.parquet`` and catalogs ``<root>/<name>.csv`` (with a header, all text)."""

    spark: SparkSession
    root: str

    def census(self, dataset: str, regions: Regions | None, level: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.root}/{dataset}_{level}.parquet")
        return in_regions(table, regions, level).select(table.columns)

    def catalog(self, name: str) -> list[dict[str, str]]:
        return [r.asDict() for r in self.spark.read.option("header", True).csv(f"{self.root}/{name}.csv").collect()]


def intersecting_regions(provider: Provider, dataset: str, level: str, geometry: DataFrame) -> DataFrame:
    """``region``: the ids of the units at a level that meet a target geometry."""
    units = provider.census(dataset, None, level).select(F.col("GeoUID").alias("_u"), "geometry")
    # a target's id only has to tell its rows apart: equal geometries may share one
    target = geometry.select(F.sha2(F.to_json("geometry"), 256).alias("_t"), "geometry").dropDuplicates(["_t"])
    return overlaps(*reconciled(units, target), "_u", "_t").select(F.col("_u").alias("region")).distinct()
