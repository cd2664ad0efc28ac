"""Example tables in the form of the election data: polling geographies and votes of two elections, made by rule, on any session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.operators.geometry.shapes import rectangle

PARTIES = ("Green", "Liberal", "NDP-New Democratic Party", "Conservative")


def example_geographies(spark: SparkSession, year: int, side: int = 20, numbers: DataFrame | None = None) -> DataFrame:
    """FED_NUM, PD_NUM, ADV_POLL, PD_<year>, AP_<year>, geometry: a square of ``side`` by ``side`` districts; in 2019 every other pair is one.

    ``numbers``: a table of the districts' numbers ``id``, from 0, in rows of ``side`` (None: the square's).
    """
    wide = F.lit(2 if year >= 2019 else 1)
    cells = (spark.range(side * side) if numbers is None else numbers).select((F.col("id") % side).alias("i"), F.expr(f"id div {side}").alias("j"))
    firsts = cells.where((F.col("j") % 2 == 0) | (F.col("i") % wide == 0))
    width = F.when(F.col("j") % 2 == 1, wide).otherwise(F.lit(1))
    fed, pd_num = F.concat(F.lit("590"), (F.col("j") % 4).cast("string")), (F.col("j") * side + F.col("i") + 1).cast("string")
    adv = (F.expr("j div 4") + 600).cast("string")
    named = firsts.select(fed.alias("FED_NUM"), pd_num.alias("PD_NUM"), adv.alias("ADV_POLL"), rectangle(F.col("i"), F.col("j"), F.col("i") + width, F.col("j") + 1).alias("geometry"))
    return named.withColumns({f"PD_{year}": F.concat_ws("_", "FED_NUM", "PD_NUM"), f"AP_{year}": F.concat_ws("_", "FED_NUM", "ADV_POLL")})


def example_votes(spark: SparkSession, year: int, side: int = 20, numbers: DataFrame | None = None) -> DataFrame:
    """FED_NUM, PD_NUM, Party, Votes, PD_<year> for every district of example_geographies and party."""
    geos = example_geographies(spark, year, side, numbers).drop("geometry", "ADV_POLL", f"AP_{year}")
    parties = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(p).alias("Party")) for i, p in enumerate(PARTIES)])).alias("p")
    votes = F.pmod(F.crc32(F.concat_ws("_", F.lit(str(year)), f"PD_{year}", "p.Party")), F.lit(200)).cast("int")
    return geos.select("*", parties).select("FED_NUM", "PD_NUM", "p.Party", votes.alias("Votes"), f"PD_{year}")
