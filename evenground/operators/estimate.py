"""Areal interpolation, largest overlaps, area checks, and correspondences found from geometry."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.functions.semantics import divide, known, log, natural_join, strict_max, strict_min, total
from evenground.operators.aggregate import post_scale, pre_scale
from evenground.operators.correspondence import COMMON_ID, METHOD, close_correspondence, combine_correspondences, identifier_correspondence
from evenground.operators.geometry import erosion
from evenground.operators.geometry.crs import reconciled, to_system
from evenground.operators.geometry.overlay import repaired
from evenground.operators.geometry.overlap import boxes, candidate_pairs, overlaps
from evenground.operators.geometry.shapes import area, normalized
from evenground.plans.meta import AVERAGE, MEDIAN, Variable, cut_meta
from evenground.runtime import materialize, release

#: What boxes that are cut by a tolerance may miss each other by, for rounding.
SLACK = 1e-6


def _unique(df: DataFrame, key: str) -> None:
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} isn't unique")


def estimate(target: DataFrame, source: DataFrame, meta: list[Variable], target_id: str, source_id: str, na_rm: bool = False, cell: float | None = None) -> DataFrame:
    """``target`` with area-weighted estimates of the source columns that ``meta`` names (by variable or label).

    A source polygon gives each target the share of its counts that its overlapping area has; averages and medians are scaled by
    their parent before and after; shares are of areas in the plane, or on the sphere for longitude and latitude; sources of another
    reference system are moved to the targets'. A target that no source polygon meets gets NULL; one that is only touched gets 0 of it, and
    NULL if the value is missing and ``na_rm`` is off.
    """
    given = target
    target, source = reconciled(target, source)
    cut = cut_meta(source.columns, meta)
    names = {m.variable: column for column, m in cut}
    scaled = [(column, names.get(m.parent, m.parent)) for column, m in cut if m.rule in (AVERAGE, MEDIAN)]
    if missing := [p for _, p in scaled if p not in source.columns]:
        raise ValueError(f"parents that the source lacks: {', '.join(missing)}")
    columns = list(dict.fromkeys(column for column, _ in cut))
    shared = overlaps(target.select(F.col(target_id).alias("_t"), "geometry"), source.select(F.col(source_id).alias("_s"), "geometry"), "_t", "_s", cell)
    values = pre_scale(source, scaled).select(F.col(source_id).alias("_s"), area(F.col("geometry")).alias("_area"), *columns)
    parts = shared.hint("merge").join(values.hint("merge"), "_s")  # neither is gathered, however few bytes its rows take
    part: Column = divide(F.col("overlap"), F.col("_area"))
    sums = parts.groupBy("_t").agg(*[total(known(parts, c).cast("double") * part, na_rm).alias(c) for c in columns])
    done = post_scale(sums, scaled)
    return given.join(done, given[target_id] == done["_t"], "left").drop("_t")


def tag_largest_overlap(source: DataFrame, target: DataFrame, source_id: str, target_id: str, cell: float | None = None) -> DataFrame:
    """Each row of ``source`` that meets a target with the ``target_id`` of the largest ``overlap_fraction`` of its own area.

    Ties go to the smaller target id. The largest is a partial aggregate, not a sort.
    """
    _unique(target, target_id)
    given = source
    source, target = reconciled(source, target)
    shared = overlaps(source.select(F.col(source_id).alias("_s"), "geometry"), target.select(F.col(target_id).alias("_t"), "geometry"), "_s", "_t", cell)
    best = shared.groupBy("_s").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col("_t").alias("t"))).alias("best"))
    areas = source.select(F.col(source_id).alias("_s"), area(F.col("geometry")).alias("_area"))
    joined = given.join(best.join(areas, "_s"), given[source_id] == best["_s"])
    fraction = divide(-F.col("best.o"), F.col("_area"))
    return joined.select(*[given[c] for c in given.columns], fraction.alias("overlap_fraction"), F.col("best.t").alias(target_id))


def check_areas(data: dict[str, DataFrame], correspondence: DataFrame) -> DataFrame:
    """Per common unit the area that each dataset gives it (``area_<name>``), the methods, and the log of largest over smallest.

    Units that a dataset lacks have NULL there and in ``max_log_ratio``. Without a method column the method is "unknown".
    """
    if METHOD not in correspondence.columns:
        correspondence = correspondence.withColumn(METHOD, F.lit("unknown"))
    parts = []
    for name, df in data.items():
        keys = [c for c in df.columns if c in correspondence.columns and c not in (COMMON_ID, METHOD)]
        units = correspondence.select(*keys, COMMON_ID, METHOD).groupBy(*keys, COMMON_ID).agg(F.collect_set(METHOD).alias("_m"))
        joined = natural_join(df.select(*keys, area(F.col("geometry")).alias("_area")), units, keys)
        parts.append(joined.groupBy(COMMON_ID).agg(F.sum("_area").alias(f"area_{name}"), F.flatten(F.collect_set("_m")).alias(f"_m_{name}")))
    out = reduce(lambda a, b: natural_join(a, b, [COMMON_ID], "full"), parts)
    none = F.array().cast("array<string>")
    methods = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(f"_m_{n}"), none) for n in data]))))
    areas = [F.col(f"area_{n}") for n in data]
    ratio = log(divide(strict_max(*areas), strict_min(*areas)))
    return out.select(COMMON_ID, *areas, F.array_join(methods, ",").alias(METHOD), ratio.alias("max_log_ratio"))


def check_two_areas(one: DataFrame, two: DataFrame, correspondence: DataFrame) -> DataFrame:
    """``common_id``, ``area1``, ``area2``, ``log_ratio`` (signed) of the units that both datasets have."""
    checked = check_areas({"1": one, "2": two}, correspondence).where("area_1 is not null and area_2 is not null")
    return checked.select(COMMON_ID, F.col("area_1").alias("area1"), F.col("area_2").alias("area2"), log(divide(F.col("area_1"), F.col("area_2"))).alias("log_ratio"))


def geometric_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, tolerance: float = 50.0, cell: float | None = None) -> DataFrame:
    """``a_id``, ``b_id`` of polygons that meet when either one is eroded by ``tolerance``; stored, so that geometries are compared once.

    Polygons of ``b`` in another reference system are moved to that of ``a``.
    """
    if a_id == b_id:
        raise ValueError("the id columns have one name")
    if not a.where(F.col(a_id).isNull()).isEmpty() or not b.where(F.col(b_id).isNull()).isEmpty():
        raise ValueError("an id is missing")
    a, b = reconciled(a, b)
    if tolerance <= 0:
        return materialize(overlaps(*(df.select(key, "geometry") for df, key in ((a, a_id), (b, b_id))), a_id, b_id, cell).select(a_id, b_id))
    # rows are numbered: polygons of one id are polygons of their own
    rows = [materialize(df.select(F.col(key).alias("_id"), normalized(F.col("geometry")).alias("geometry")).withColumn(n, F.monotonically_increasing_id())) for df, key, n in ((a, a_id, "_a"), (b, b_id, "_b"))]
    keys = ("_a", "_b")
    (ta, pa), (tb, pb) = (erosion.kept(df, key, tolerance) for df, key in zip(rows, keys, strict=True))
    sides = [materialize(erosion.outlines(df, key).join(t, key)) for df, key, t in zip(rows, keys, (ta, tb), strict=True)]
    told = [materialize(boxes(df, key).join(t.withColumnRenamed("t", name), key)) for df, key, t, name in zip(rows, keys, (ta, tb), ("ta", "tb"), strict=True)]
    # an eroded polygon lies in its box less the tolerance: neighbours that only touch are ruled out here
    near = [reduce(lambda x, y: x & y, [(F.col(f"{p}.{k}0") + F.col(t) <= F.col(f"{q}.{k}1") + SLACK) & (F.col(f"{q}.{k}0") <= F.col(f"{p}.{k}1") - F.col(t) + SLACK) for k in "xy"]) for p, q, t in (("ba", "bb", "ta"), ("bb", "ba", "tb"))]
    pairs = materialize(candidate_pairs(*told, cell).select("_a", "_b", "ba", "bb", near[0].alias("near_a"), near[1].alias("near_b")).where("near_a or near_b"))
    whole = [materialize(erosion.whole_edges(df, key)) for df, key in zip(rows, keys, strict=True)]
    met = erosion.met_skeletons(pairs.where("near_a").select("_a", "_b", "bb"), pa, whole[1], "_a", "_b").select("_a", "_b")
    found = materialize(met.union(erosion.met_skeletons(pairs.where("near_b").select("_a", "_b", F.col("ba").alias("bb")), pb, whole[0], "_b", "_a").select("_a", "_b")).distinct())
    rest = materialize(pairs.join(found, ["_a", "_b"], "left_anti"))
    more = erosion.met_edges(rest.where("near_a"), sides[0], whole[1], "_a", "_b").select("_a", "_b").union(erosion.met_edges(rest.where("near_b"), sides[1], whole[0], "_b", "_a").select("_a", "_b"))
    names = [df.select(key, F.col("_id").alias(name)) for df, key, name in zip(rows, keys, (a_id, b_id), strict=True)]
    done = materialize(found.union(more).join(names[0], "_a").join(names[1], "_b").select(a_id, b_id).distinct())
    release(*rows, *sides, *told, *whole, pairs, found, rest)
    return done


def estimate_correspondence(
    data: dict[str, DataFrame], ids: dict[str, str], method: str = "estimate", tolerance: float = 50.0, srid: int | None = None, cell: float | None = None,
    robust: bool = False,
) -> DataFrame:
    """The closed correspondence of consecutive datasets from their geometries; ``ids``: each dataset's id column.

    Method "identifier" links ids that all datasets have to themselves and estimates the rest only. ``srid``: the reference system to
    compute in (None: the first dataset's); datasets may differ in theirs. ``robust``: geometries are repaired first (crossing rings, spikes, rings of no area).
    """
    if method not in ("estimate", "identifier"):
        raise ValueError("method is estimate or identifier")
    if set(ids) != set(data) or len(set(ids.values())) < len(ids):
        raise ValueError("every dataset needs an id column of its own name")
    data = {ds: to_system(df, srid) for ds, df in data.items()} if srid else dict(zip(data, reconciled(*data.values()), strict=True))
    if robust:
        data = {ds: repaired(df) for ds, df in data.items()}
    common = identifier_correspondence(data, ids) if method == "identifier" else None
    steps = []
    for one, two in pairwise(data):
        sides = [data[ds].select(F.col(f"`{ids[ds]}`").cast("string").alias(ids[ds]), "geometry") for ds in (one, two)]
        if common is not None:
            sides = [s.join(common.select(ids[ds]), ids[ds], "left_anti") for s, ds in zip(sides, (one, two), strict=True)]
        pairs = geometric_pairs(*sides, ids[one], ids[two], tolerance, cell).withColumn(METHOD, F.lit("estimate"))
        if common is not None:
            pairs = common.select(ids[one], ids[two], METHOD).union(pairs)
        steps.append(pairs)
    return close_correspondence(combine_correspondences(steps) if len(steps) > 1 else steps[0])


def translate_units(one: DataFrame, two: DataFrame, unit_id: str, sums: list[str], groups: list[str] | None = None, na_rm: bool = True, least: float = 0.1, cell: float | None = None) -> DataFrame:
    """``two``'s sums on ``one``'s units: ids that only ``two`` has go to the unit of ``one`` (also without a partner) that holds over ``least`` of their area.

    A unit of ``one`` that would take up a single unit of ``two`` is an error; an id that falls to several gets their ids, sorted and joined by commas.
    """
    groups = groups or []
    one, two = reconciled(one, two)
    only = [a.join(b.select(unit_id), unit_id, "left_anti") for a, b in ((one, two), (two, one))]
    first = only[0].select(F.col(unit_id).alias("_one"), "geometry")
    second = only[1].select(F.col(unit_id).alias("_two"), "geometry")
    shared = overlaps(second, first, "_two", "_one", cell)
    ratio = shared.join(second.select("_two", area(F.col("geometry")).alias("_area")), "_two").where(divide(F.col("overlap"), F.col("_area")) > least)
    if not ratio.groupBy("_one").count().where("count <= 1").isEmpty():
        raise ValueError("a unit has a single partner")
    names = ratio.groupBy("_two").agg(F.array_join(F.array_sort(F.collect_set(F.col("_one").cast("string"))), ",").alias("_id"))
    moved = only[1].join(names, only[1][unit_id] == names["_two"], "left").withColumn(unit_id, F.col("_id"))
    summed = moved.groupBy(unit_id, *groups).agg(*[total(known(moved, c), na_rm).alias(c) for c in sums])
    same = two.join(one.select(unit_id), unit_id, "left_semi").select(unit_id, *groups, *sums)
    return same.unionByName(summed)
