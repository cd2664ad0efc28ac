"""Counts of a stream of rows on a common tiling: a static correspondence, running sums by unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.operators.correspondence import COMMON_ID


def running_sums(stream: DataFrame, correspondence: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Sums per ``common_id`` of a (streaming) table by its id column ``key``; write it in update or complete mode.

    State grows with the units, not with the rows.
    """
    units = correspondence.select(key, COMMON_ID).distinct()
    return stream.join(units, key).groupBy(COMMON_ID).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
