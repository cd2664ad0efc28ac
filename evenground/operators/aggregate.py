"""Aggregation by metadata rules, and datasets harmonized on their common tiling."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.functions.semantics import divide, known, natural_join, total
from evenground.operators.correspondence import COMMON_ID, COMMON_UID
from evenground.operators.geometry.dissolve import dissolve
from evenground.plans.meta import AVERAGE, AVERAGE_TO, MEDIAN, NOT_ADDITIVE, PERCENT_UNITS, RATIO_UNITS, Variable

GEOMETRY = "geometry"


def pre_scale(df: DataFrame, scaled: list[tuple[str, str]]) -> DataFrame:
    """x becomes x * parent, one (x, parent) after another: a parent that was scaled before counts as scaled."""
    return reduce(lambda d, p: d.withColumn(p[0], known(d, p[0]) * known(d, p[1])), scaled, df)


def post_scale(df: DataFrame, scaled: list[tuple[str, str]]) -> DataFrame:
    """x becomes x / parent, one after another."""
    return reduce(lambda d, p: d.withColumn(p[0], divide(F.col(f"`{p[0]}`"), F.col(f"`{p[1]}`"))), scaled, df)


def _checked(df: DataFrame, meta: list[Variable], quiet: bool) -> list[Variable]:
    meta = [m for m in meta if m.variable in df.columns]
    names = {m.variable for m in meta}
    if missing := [m.parent or f"parent of {m.variable}" for m in meta if m.rule in (AVERAGE, MEDIAN, AVERAGE_TO) and m.parent not in names]:
        raise ValueError(f"parents that the metadata lacks: {', '.join(missing)}")
    if not quiet and (odd := [m.variable for m in meta if m.rule == NOT_ADDITIVE]):
        warnings.warn(f"not additive, summed all the same: {', '.join(odd)}", stacklevel=3)
    if not quiet and (odd := [m.variable for m in meta if m.rule == MEDIAN]):
        warnings.warn(f"medians are treated as averages: {', '.join(odd)}", stacklevel=3)
    return meta


def aggregate_with_meta(df: DataFrame, meta: list[Variable], by: list[str], geometry: bool = True, na_rm: bool = True, quiet: bool = False) -> DataFrame:
    """``by`` and the variables of ``meta`` that ``df`` has, aggregated by their rules; one row per group (no ``by``: one row).

    Additive: sum. Average and Median: sum(x * parent) / sum(parent). AverageTo: the base of parent = base * (x + 1), x being a ratio
    or percentage, or parent = base * x; x's mean weighted by base, and the base is kept as ``base_<parent>``. Not additive: sum, with a
    warning. A geometry column is dissolved per group. One shuffle: sums are partial per task.
    """
    meta = _checked(df, meta, quiet)
    scaled = [(m.variable, m.parent) for m in meta if m.rule in (AVERAGE, MEDIAN)]
    work = pre_scale(df, scaled)
    to = [m for m in meta if m.rule == AVERAGE_TO]
    bases: dict[str, str] = {}
    for m in to:
        alone = sum(o.parent == m.parent for o in to) == 1
        bases[m.variable] = f"base_{m.parent}" if alone else f"base_{m.parent}_{m.variable}"
        x = known(work, m.variable)
        by_units = {RATIO_UNITS: x + 1, PERCENT_UNITS: x / 100 + 1}.get(m.units, x)
        work = work.withColumn(bases[m.variable], divide(known(work, m.parent), by_units))
        work = work.withColumn(m.variable, x * F.col(f"`{bases[m.variable]}`"))
    summed = list(dict.fromkeys([*(m.variable for m in meta), *bases.values()]))
    sums = [total(known(work, c), na_rm).alias(c) for c in summed]
    if sums:
        out = work.groupBy(*by).agg(*sums) if by else work.agg(*sums)
    else:
        out = work.select(*by).distinct()
    out = post_scale(out, scaled)
    for x, base in bases.items():
        out = out.withColumn(x, divide(F.col(f"`{x}`"), F.col(f"`{base}`")))
    if geometry and GEOMETRY in df.columns and by:
        out = natural_join(out, dissolve(df.select(*by, GEOMETRY), by), by)
    return out


def rename_with_meta(df: DataFrame, meta: list[Variable], dataset: str | None = None) -> DataFrame:
    """Variables become labels, those of one geography if ``dataset`` names it; a variable with two labels is an error."""
    chosen = [m for m in meta if (dataset is None or m.geo_dataset == dataset) and m.variable in df.columns]
    names = [m.variable for m in chosen]
    if len(set(names)) < len(names):
        raise ValueError("a variable is named twice")
    return df.withColumnsRenamed({m.variable: m.label for m in chosen})


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` that stand in several rows, and in how many (``n``)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_correspondence(df: DataFrame, correspondence: DataFrame) -> DataFrame:
    """``df`` with its units' common ids, inner; an id in two units is an error."""
    keys = [c for c in df.columns if c in correspondence.columns and c not in (COMMON_ID, COMMON_UID)]
    if not keys:
        raise ValueError("no matching geographic identifiers")
    if len(keys) > 1:
        warnings.warn(f"several geographic identifiers match: {', '.join(keys)}", stacklevel=2)
    units = correspondence.select(*keys, COMMON_ID, COMMON_UID).distinct()
    # common_uid names all ids of a unit: it is not shuffled to refuse what common_id alone refuses, and by its digest else
    for named in ([], [F.sha2(COMMON_UID, 256).alias("_uid")]):
        if not repeated(correspondence.select(*keys, COMMON_ID, *named).distinct(), keys).isEmpty():
            raise ValueError("an identifier belongs to more than one unit")
    return natural_join(df, units, keys)


def harmonize(data: dict[str, DataFrame], correspondence: DataFrame, meta: list[Variable] | None = None, base_geo: str | None = None, na_rm: bool = True) -> DataFrame:
    """All datasets' variables on the common tiling: per dataset the ids' units, aggregation by rule and labels, then joined.

    Only units that every dataset has are kept; the geometry is ``base_geo``'s (default: the first dataset's); variables of type Extra
    go. Without metadata the units alone are returned.
    """
    base_geo = base_geo or next(iter(data))
    parts = {}
    for ds, df in data.items():
        d = df if ds == base_geo else df.drop(GEOMETRY)
        units = join_correspondence(d, correspondence)
        parts[ds] = rename_with_meta(aggregate_with_meta(units, meta or [], [COMMON_ID, COMMON_UID], na_rm=na_rm), meta or [], ds)
    out = parts.pop(base_geo)
    for part in parts.values():
        if clash := [c for c in part.columns if c in out.columns and c not in (COMMON_ID, COMMON_UID)]:
            raise ValueError(f"datasets have variables without labels of their own: {', '.join(clash)}")
        out = out.join(part.drop(COMMON_UID), COMMON_ID)
    return out.drop(*[m.label for m in meta or [] if m.type == "Extra"])
