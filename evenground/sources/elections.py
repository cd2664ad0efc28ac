"""Election results by polling station: cleaning, keys, and the join with polling geographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the published files.
COLUMNS = {
    "Electoral District Number/Numéro de circonscription": "FED_NUM",
    "Merge With/Fusionné avec": "Merge",
    "No Poll Held Indicator/Indicateur de bureau sans scrutin": "no_poll",
    "Void Poll Indicator/Indicateur de bureau supprimé": "void_poll",
    "Polling Station Number/Numéro du bureau de scrutin": "PD_NUM",
    "Political Affiliation Name_English/Appartenance politique_Anglais": "Party",
    "Incumbent Indicator/Indicateur_Candidat sortant": "Incumbent",
    "Elected Candidate Indicator/Indicateur du candidat élu": "Elected",
    "Candidate Poll Votes Count/Votes du candidat pour le bureau": "Votes",
}


def read_votes(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder (CSV with headers), all text."""
    return spark.read.option("header", True).csv(folder)


def clean_votes(raw: DataFrame, year: int) -> DataFrame:
    """Short names; stations without a number go; PD_NUM loses one trailing letter (PDNUM keeps it); votes as integers (else NULL).

    ``PD_<year>``: district, underscore, and the station that the votes were merged into, or else the station.
    """
    votes = raw.select(*[F.col(f"`{long}`").alias(short) for long, short in COLUMNS.items()]).where("PD_NUM is not null")
    votes = votes.withColumn("PDNUM", F.col("PD_NUM")).withColumn("PD_NUM", F.regexp_replace("PD_NUM", "[^0-9.]$", "")).withColumn("Votes", F.col("Votes").try_cast("int"))
    return votes.withColumn(f"PD_{year}", F.concat_ws("_", "FED_NUM", F.coalesce("Merge", "PD_NUM")))


def polling_geographies(geos: DataFrame, votes: DataFrame, year: int) -> DataFrame:
    """Geographies (FED_NUM, PD_NUM, ADV_POLL, ...) with their advance poll's key and the key of the votes of their station."""
    keyed = geos.withColumn(f"AP_{year}", F.concat_ws("_", "FED_NUM", "ADV_POLL"))
    return keyed.join(votes.select("FED_NUM", "PD_NUM", f"PD_{year}").distinct(), ["FED_NUM", "PD_NUM"], "left")
