"""From census tables to comparable variables: the whole way by provider, correspondence, aggregation and labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.operators.aggregate import GEOMETRY, harmonize, rename_with_meta
from evenground.operators.correspondence import close_correspondence
from evenground.operators.estimate import estimate
from evenground.operators.geometry.crs import transform
from evenground.operators.reaggregate import downsample
from evenground.plans.meta import Variable, add_base_variables
from evenground.sources.census_ca import census_correspondence
from evenground.sources.census_us import DATASETS, state_of
from evenground.sources.provider import Provider, intersecting_regions

Transform = Callable[[DataFrame], DataFrame]


def harmonized_census(
    provider: Provider, regions: dict[str, list[str]] | None, meta: list[Variable], level: str = "CT", method: str = "statcan", files: dict[str, DataFrame] | None = None,
    base_geo: str | None = None, tolerance: float = 50.0, data_transform: Transform | None = None, na_rm: bool = True, srids: tuple[int, int] | None = None,
) -> DataFrame:
    """Variables of several Canadian censuses on their common tiling; a single census is returned as it is, labelled.

    ``data_transform`` is applied to every census table, after ``srids`` (from, to) has moved its geometry; with ``na_rm`` missing values are
    left out of sums, else they make them missing.
    """
    names = sorted({m.geo_dataset for m in meta})
    full = add_base_variables(meta)
    data = {}
    for ds in names:
        table = provider.census(ds, regions, level).withColumn(f"GeoUID{ds}", F.col("GeoUID"))
        if srids and GEOMETRY in table.columns:
            table = table.withColumn(GEOMETRY, transform(F.col(GEOMETRY), *srids))
        data[ds] = table.transform(data_transform) if data_transform else table
    if len(names) == 1:
        return rename_with_meta(data[names[0]], full)
    correspondence = census_correspondence(provider, names, regions, level, method, files, tolerance)
    keyed = {ds: df.drop("GeoUID") for ds, df in data.items()}
    return harmonize(keyed, correspondence, full, base_geo, na_rm)


def census_estimate(
    provider: Provider, target: DataFrame, target_id: str, meta: list[Variable], level: str, intersection_level: str | None = None, downsample_level: str | None = None, na_rm: bool = False
) -> DataFrame:
    """Estimates of one census's variables on any target polygons.

    Only the regions that meet the target are read. With ``downsample_level`` the values are first pushed down to that finer level by each
    variable's ``downsample`` column.
    """
    datasets = {m.geo_dataset for m in meta}
    if len(datasets) != 1:
        raise ValueError("one census geography at a time")
    dataset = datasets.pop()
    above = intersection_level or level
    regions = {above: intersecting_regions(provider, dataset, above, target)}
    source = harmonized_census(provider, regions, meta, level)
    if downsample_level:
        if missing := [m.variable for m in meta if m.downsample is None]:
            raise ValueError(f"no downsample column for {', '.join(missing)}")
        labels = [m.label for m in meta]
        # of the finer level only the geography and the weights count, not values of its own
        own = {m.variable for m in meta} - {*labels, *(m.downsample for m in meta)}
        fine = provider.census(dataset, regions, downsample_level).drop(*own)
        source = downsample(fine, source.drop(GEOMETRY), {f"{level}_UID": "GeoUID"}, labels, {m.label: m.downsample for m in meta})
    return estimate(target, source, meta, target_id, "GeoUID", na_rm)


def harmonized_us_census(
    provider: Provider, states: DataFrame, regions: dict[str, list[str]], meta: list[Variable], links: Callable[[tuple[str, str]], DataFrame], level: str = "tract", base_geo: str | None = None
) -> DataFrame:
    """Variables of several US censuses on common tracts (or county subdivisions), state by state; ``links``: a state's linked ids."""
    datasets = list(dict.fromkeys(m.dataset for m in meta))
    if unknown := [d for d in datasets if d not in DATASETS]:
        raise ValueError(f"unknown datasets {', '.join(unknown)}")
    if level not in ("tract", "county subdivision"):
        raise ValueError("level is tract or county subdivision")
    base_geo = base_geo or datasets[0]
    if base_geo not in datasets:
        raise ValueError("base_geo isn't one of the datasets")

    def one(name: str) -> DataFrame:
        state = state_of(states, name)
        correspondence = close_correspondence(links(state))
        data = {}
        for ds in datasets:
            where = {"state": [state[1]]} | ({"county": regions["county"]} if regions.get("county") else {})
            table = provider.census(ds, None, level).where(F.col("state_UID").isin(where["state"]))
            if "county" in where:
                table = table.where(F.col("county_UID").isin(where["county"]))
            data[ds] = table.withColumnRenamed("GeoUID", f"GEOID{DATASETS[ds][2:]}")
        return harmonize(data, correspondence, meta, base_geo)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(s) for s in regions["state"]])


def common_tracts(provider: Provider, regions: dict[str, list[str]] | None, meta: list[Variable]) -> DataFrame:
    """Tracts by common ids and geometry (kept for older callers)."""
    return harmonized_census(provider, regions, meta, "CT", "identifier", tolerance=500.0)


def common_areas(provider: Provider, regions: dict[str, list[str]] | None, meta: list[Variable], files: dict[str, DataFrame]) -> DataFrame:
    """Dissemination areas by relationship files (kept for older callers)."""
    return harmonized_census(provider, regions, meta, "DA", "statcan", files)


def common_tracts_from_areas(provider: Provider, regions: dict[str, list[str]] | None, meta: list[Variable], files: dict[str, DataFrame]) -> DataFrame:
    """Tracts by relationship files of their areas (kept for older callers)."""
    return harmonized_census(provider, regions, meta, "CT", "statcan", files)
