"""Correspondences: which ids of several congruent tilings make up one unit of their finest common tiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.functions.semantics import natural_join
from evenground.operators.components import connected_components

METHOD, COMMON_ID, COMMON_UID = "method", "common_id", "common_uid"
_OWN = (COMMON_ID, COMMON_UID)
#: Rows of a unit that one copy of its list of ids joins, at least; copies of a list for every core, at most.
UNIT_ROWS, COPIES_PER_CORE = 1000, 4


def id_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if not c.startswith(METHOD) and c not in _OWN]


def close_correspondence(table: DataFrame, null_ids: str = "separate") -> DataFrame:
    """``table`` with ``common_id`` and ``common_uid``: rows that share an id in any id column, directly or over others, are one unit.

    common_id is the unit's smallest seed, a row's seed being its first id; common_uid lists the unit's ids,
    ``<column>:<sorted ids>`` per column. Rows and their number are kept. ``null_ids``: "separate" seeds a row without a first id by
    its first known one as ``<column number>_<id>`` and lets missing ids link nothing: a row without any id is of no unit, its common_id is
    NULL; "literal" gives all rows without a first id
    the seed "1_NA" and links the rows that miss an id in the same column.

    A list is as long as its unit has ids, and stands on each of its rows. Those of a large unit are dealt over copies of the list, as many as
    keep all cores busy, and pass it one by one: a join that had the list's row meet all rows of its unit would hold as many copies at once. So would
    an explode that made the copies: they are made by rows of numbers, which pass the list one by one, too.
    """
    if null_ids not in ("separate", "literal"):
        raise ValueError("null_ids is separate or literal")
    ids = id_columns(table)
    if not ids:
        raise ValueError("no id columns")
    if null_ids == "literal":
        seed = F.coalesce(F.col(f"`{ids[0]}`").cast("string"), F.lit("1_NA"))
    else:
        others = [F.concat(F.lit(f"{k}_"), F.col(f"`{c}`").cast("string")) for k, c in enumerate(ids, 1) if k > 1]
        seed = F.coalesce(F.col(f"`{ids[0]}`").cast("string"), *others, F.lit("0_"))
    seeded = table.withColumn("_seed", seed)
    edges = []
    for c in ids[1:] if len(ids) > 1 else []:
        pairs = seeded.select("_seed", F.col(f"`{c}`").cast("string").alias("v")).distinct()
        pairs = pairs if null_ids == "literal" else pairs.where("v is not null")
        low = pairs.groupBy("v").agg(F.min("_seed").alias("low"))
        edges.append(natural_join(pairs, low, ["v"]).where("_seed <> low").select("_seed", "low"))
    if edges:
        labels = connected_components(reduce(DataFrame.union, edges), "_seed", "low").withColumnRenamed("node", "_seed")
        seeded = seeded.join(labels, "_seed", "left").withColumn(COMMON_ID, F.coalesce("component", "_seed")).drop("component")
    else:
        seeded = seeded.withColumn(COMMON_ID, F.col("_seed"))
    parts = [F.concat(F.lit(f"{c}:"), F.array_join(F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))), ",")) for c in ids]
    most = COPIES_PER_CORE * table.sparkSession.sparkContext.defaultParallelism
    copies = F.least(F.ceil(F.count("*") / UNIT_ROWS), F.lit(most)).cast("long").alias("_copies")
    lists = seeded.groupBy(COMMON_ID).agg(F.concat_ws(" ", *parts).alias(COMMON_UID))
    sizes = seeded.groupBy(COMMON_ID).agg(copies)
    numbers = sizes.select(COMMON_ID, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
    named = numbers.hint("merge").join(lists.hint("merge"), COMMON_ID)
    large = sizes.where("_copies > 1")  # a row for UNIT_ROWS rows at most
    dealt = seeded.join(F.broadcast(large), COMMON_ID, "left").withColumn("_copy", F.coalesce(F.pmod(F.monotonically_increasing_id(), "_copies"), F.lit(0).cast("long")))
    unit = F.col(COMMON_ID) if null_ids == "literal" else F.when(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in ids]).isNotNull(), F.col(COMMON_ID))
    return dealt.hint("merge").join(named.hint("merge"), [COMMON_ID, "_copy"]).select(*table.columns, unit.alias(COMMON_ID), COMMON_UID)


def combine_correspondences(tables: list[DataFrame]) -> DataFrame:
    """The natural inner join of a chain of correspondences on the ids that neighbours share, different rows; methods are merged."""
    clean = [t.drop(*_OWN).withColumnsRenamed({c: f"{METHOD}_{i}" for c in t.columns if c.startswith(METHOD)}) for i, t in enumerate(tables)]

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("neighbouring correspondences share no ids")
        return natural_join(a, b, shared)

    joined = reduce(join, clean)
    methods = [c for c in joined.columns if c.startswith(METHOD)]
    if methods:
        text = F.array_join(F.array_distinct(F.array_compact(F.array(*methods))), ",")
        joined = joined.withColumn("_methods", text).drop(*methods).withColumnRenamed("_methods", METHOD)
    return joined.distinct()


def chain_correspondences(tables: list[DataFrame]) -> DataFrame:
    """The left natural join of a chain of relationship tables, closed (units of the first table's ids are all kept)."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return natural_join(a, b, [c for c in a.columns if c in b.columns], "left")

    return close_correspondence(reduce(join, tables).distinct())


def identifier_correspondence(data: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """Ids that all datasets have, as a correspondence of method "identifier"; ``ids``: each dataset's id column."""
    sets = [data[ds].select(F.col(f"`{ids[ds]}`").cast("string").alias("_id")).where("_id is not null").distinct() for ds in data]
    common = reduce(lambda a, b: a.join(b, "_id", "left_semi"), sets)
    return common.select(*[F.col("_id").alias(ids[ds]) for ds in data], F.lit("identifier").alias(METHOD))
