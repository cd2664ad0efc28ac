"""Dasymetric downsampling: parents' totals pushed down to their children by weight, missing values filled from the parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.functions.semantics import known

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def downsample(
    child: DataFrame, parent: DataFrame, geo_match: dict[str, str], categories: list[str], base: str | dict[str, str | None], compat: str = "intended"
) -> DataFrame:
    """``child`` with ``categories`` (last) that add up to the parents' values.

    ``geo_match``: child column -> parent column. ``base``: the weight column of every category, or of each; None marks a category of
    means, whose missing values take the parent's. Other numbers get value + weight * (parent - children's sum), weight being the child's
    share of the base in its parent; text is filled where missing. Categories that the child lacks are added; parents without
    children vanish. ``compat``: "intended" weighs every category on its own and keeps a child without a parent; "literal" sums the children over all
    categories of one type, uses the first one's base for that type, and counts a missing parent as 0.

    Sums per parent are partial aggregates joined back to the children, so a large parent doesn't gather in one task.
    """
    if compat not in ("intended", "literal"):
        raise ValueError("compat is intended or literal")
    bases = {c: base for c in categories} if base is None or isinstance(base, str) else dict(base)
    if set(bases) != set(categories):
        raise ValueError("one base per category is needed")
    if missing := [c for c in categories if c not in parent.columns]:
        raise ValueError(f"the parent lacks {', '.join(missing)}")
    if clash := [b for b in bases.values() if b in categories]:
        raise ValueError(f"a base is a category: {', '.join(clash)}")
    types = dict(parent.dtypes)
    keys = list(geo_match)
    for c in categories:
        if c not in child.columns:
            child = child.withColumn(c, F.lit(None).cast(types[c]))
    numeric = [c for c in categories if types[c].split("(")[0] in NUMERIC]
    buckets: dict[str, list[str]] = {}
    for c in numeric:
        buckets.setdefault(types[c], []).append(c)
    weight_of = {c: bases[cs[0]] if compat == "literal" else bases[c] for cs in buckets.values() for c in cs}

    def child_sum(c: str) -> Column:
        """NULL if one value is missing."""
        return F.when(F.count(known(child, c)) == F.count(F.lit(1)), F.sum(known(child, c)))

    sums = [child_sum(c).alias(f"_s_{c}") for c in numeric]
    sums += [F.sum(known(child, b)).alias(f"_b_{b}") for b in dict.fromkeys(b for b in weight_of.values() if b is not None)]
    told = parent.select(*[F.col(f"`{p}`").alias(f"_k_{k}") for k, p in geo_match.items()], *[F.col(f"`{c}`").alias(f"_p_{c}") for c in categories], F.lit(True).alias("_has"))
    if not told.groupBy(*[f"_k_{k}" for k in keys]).count().where("count > 1").isEmpty():
        raise ValueError("a parent id occurs twice")
    groups = child.groupBy(*[f"`{k}`" for k in keys]).agg(*sums, F.count(F.lit(1)).alias("_n")).withColumnsRenamed({k: f"_g_{k}" for k in keys})
    lookup = groups.join(told, reduce(lambda a, b: a & b, [groups[f"_g_{k}"].eqNullSafe(told[f"_k_{k}"]) for k in keys]), "left")
    wide = child.join(lookup, reduce(lambda a, b: a & b, [child[k].eqNullSafe(lookup[f"_g_{k}"]) for k in keys]))

    def value(c: str) -> Column:
        v, p = known(wide, c), F.col(f"`_p_{c}`") if types[c] not in ("double", "float") else known(wide, f"_p_{c}")
        if c not in numeric:
            return F.coalesce(v, p)
        filled = F.coalesce(p, F.lit(0)) if compat == "literal" else p
        if bases[c] is None:
            return F.coalesce(v, filled)
        if compat == "literal":
            s = reduce(lambda a, b: a + b, [F.col(f"`_s_{x}`") for x in buckets[types[c]]])
        else:
            s = F.col(f"`_s_{c}`")
        b = weight_of[c]
        whole = F.col(f"`_b_{b}`").cast("double") if b is not None else None
        weight = F.lit(0.0) if b is None else F.coalesce(F.when(whole != 0, known(wide, b).cast("double") / whole), F.lit(0.0))
        moved = F.coalesce(v, F.lit(0)) + weight * (F.coalesce(p, F.lit(0)) - F.coalesce(s, F.lit(0)))
        return moved if compat == "literal" else F.when(F.col("_has"), moved).otherwise(v)

    kept = [f"`{c}`" for c in child.columns if c not in categories]
    return wide.select(*kept, *[value(c).alias(c) for c in categories])
