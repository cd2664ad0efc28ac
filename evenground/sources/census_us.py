"""US census: tract relationship files of two decades and county subdivisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.functions.semantics import natural_join
from evenground.operators.reshape import all_matches
from evenground.sources.sheets import read_sheet

DATASETS = {"dec2000": "2000", "dec2010": "2010", "dec2020": "2020"}
# The columns of the tract file 2000-2010; ids are text, people and housing counts integers, the rest numbers.
_TEXT, _INTEGER = "string", "int"
TRACTS_2010 = [
    *[(n, _TEXT) for n in ("STATE00", "COUNTY00", "TRACT00", "GEOID00")], ("POP00", _INTEGER), ("HU00", _INTEGER), ("PART00", _TEXT), ("AREA00", _TEXT), ("AREALAND00", _TEXT),
    *[(n, _TEXT) for n in ("STATE10", "COUNTY10", "TRACT10", "GEOID10")], ("POP10", _INTEGER), ("HU10", _INTEGER), ("PART10", _TEXT), ("AREA10", _TEXT), ("AREALAND10", _TEXT),
    *[(n, "double") for n in ("AREAPT", "AREALANDPT", "AREAPCT00PT", "AREALANDPCT00PT", "AREAPCT10PT", "AREALANDPCT10PT", "POP10PT", "POPPCT00", "POPPCT10", "HU10PT", "HUPCT00", "HUPCT10")],
]


def state_of(states: DataFrame, name: str) -> tuple[str, str]:
    """(state, state_code) by either; an unknown or ambiguous one is an error."""
    found = states.where((F.col("state") == name) | (F.col("state_code") == name)).select("state", "state_code").distinct().collect()
    if len(found) != 1:
        raise ValueError(f"no single state {name}")
    return found[0]["state"], found[0]["state_code"]


def states_of(names: DataFrame, states: DataFrame) -> DataFrame:
    """``names`` (column ``asked``) with ``state`` and ``state_code``, asked for by either; unknown names are left out."""
    pairs = states.select("state", "state_code").distinct()
    either = pairs.select(F.explode(F.array_distinct(F.array("state", "state_code"))).alias("asked"), "state", "state_code")
    return names.join(either, "asked")


def tract_path_column(root: str, year: str) -> Column:
    """tract_path of the columns ``state`` and ``state_code``."""
    if year == "2010":
        return F.concat(F.lit(f"{root}/"), F.lower("state"), "state_code", F.lit("trf.txt"))
    return F.concat(F.lit(f"{root}/TAB2010_TAB2020_ST"), "state_code", F.lit(".txt"))


def tract_path(root: str, state: tuple[str, str], year: str) -> str:
    """Where a state's tract file lies in a folder of downloaded files."""
    return f"{root}/{state[0].lower()}{state[1]}trf.txt" if year == "2010" else f"{root}/TAB2010_TAB2020_ST{state[1]}.txt"


def tracts_2010(spark: SparkSession, path: str) -> DataFrame:
    """The headerless file of 30 columns."""
    return spark.read.schema(", ".join(f"{n} {t}" for n, t in TRACTS_2010)).csv(path)


def tracts_2020(spark: SparkSession, path: str) -> DataFrame:
    """GEOID10, GEOID20 from the file with bars; ids are state, county and tract together."""
    rows = spark.read.option("sep", "|").option("header", True).csv(path)
    ids = [F.concat(*[f"{part}_20{y}" for part in ("STATE", "COUNTY", "TRACT")]).alias(f"GEOID{y}") for y in ("10", "20")]
    return rows.select(*ids).distinct()


def _linked(old: DataFrame, new: DataFrame) -> DataFrame:
    """The different (GEOID00, GEOID20) of a full join of different rows on GEOID10, missing equal to missing.

    Two rows of the join are equal only where both ids have several ids of 2010, or where one is missing: those alone are shuffled as pairs.
    """
    # a key that tells a missing id from all others and is never missing
    keyed = [t.withColumn("_k", F.coalesce(F.concat(F.lit("="), "GEOID10"), F.lit(""))) for t in (old, new)]
    sides = []
    for df, name, flag in zip(keyed, ("GEOID00", "GEOID20"), ("_m", "_n"), strict=True):
        several = df.groupBy(name).agg((F.count("*") > 1).alias(flag))
        known = df.where(F.col(name).isNotNull()).join(several, name).select(name, "_k", flag)
        sides.append(known.unionByName(df.where(F.col(name).isNull()).select(name, "_k", F.lit(True).alias(flag))))
    left, right = sides
    single = F.col("GEOID00").isNotNull() & F.col("GEOID20").isNotNull() & ~(F.col("_m") & F.col("_n"))
    ids = ["GEOID00", "GEOID20"]
    alone = [a.join(b.select("_k").distinct(), "_k", "left_anti") for a, b in (keyed, keyed[::-1])]
    # each of these joins reads the rows that may repeat only
    parts = (left.where("_m"), right.where("_n")), (left.where("GEOID00 is null"), right), (left, right.where("GEOID20 is null"))
    rest = reduce(DataFrame.union, [all_matches(a, b, "_k").select(*ids) for a, b in parts])
    rest = rest.union(alone[0].select("GEOID00", F.lit(None).cast("string"))).union(alone[1].select(F.lit(None).cast("string"), "GEOID20"))
    return all_matches(left, right, "_k").where(single).select(*ids).union(rest.distinct())


def link_tracts(datasets: list[str], to_2010: DataFrame | None, to_2020: DataFrame | None) -> DataFrame:
    """Ids of the asked censuses in one table: either file's, or both by a full join on 2010 (dropped unless asked for)."""
    if set(datasets) - set(DATASETS):
        raise ValueError("censuses 2000, 2010 and 2020 can be matched")
    if "dec2000" in datasets:
        out = to_2010.select("GEOID00", "GEOID10").distinct()
        if "dec2020" not in datasets:
            return out if "dec2010" in datasets else out.drop("GEOID10").distinct()
        if "dec2010" in datasets:
            return natural_join(out, to_2020.select("GEOID10", "GEOID20"), ["GEOID10"], "full").distinct()
        return _linked(out, to_2020.select("GEOID10", "GEOID20").distinct())
    if "dec2020" not in datasets:
        raise ValueError("two different censuses are needed")
    return to_2020.select("GEOID10", "GEOID20").distinct()


def county_subdivisions(spark: SparkSession, path: str, state_code: str) -> DataFrame:
    """GEOID00, GEOID10 of a state from the comparability table, as CSV with a header or as XLSX."""
    if path.endswith(".xlsx"):
        rows = read_sheet(spark, path, ["STATEFP10", "GEOID00", "GEOID10"])
    else:
        rows = spark.read.option("header", True).csv(path)
    return rows.where(F.col("STATEFP10") == state_code).select("GEOID00", "GEOID10")
