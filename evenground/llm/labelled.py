"""Which labelled rows a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most, of either label; the class sizes are counted over all labels.
ROWS_PER_LABEL = 2000


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5: never learnt from. NULL ids: False."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _clean(labels: DataFrame, label: str) -> DataFrame:
    """``id``, ``y``: ids with several labels count by their highest; NULL ids, held-out ones and labels other than 0 and 1 go."""
    clean = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    return clean.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))


def labelled_rows(told: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(``y``, ``described``) of all rows of ``told`` (doc_id, described) with a label that may be learnt from.

    The rows are dealt by id whatever the labels' size: a broadcast would gather the labels on the driver as long as they seem few.
    """
    clean, rows = _clean(labels, label), told.where(F.col("doc_id").isNotNull() & ~held_out())
    return rows.hint("merge").join(clean.hint("merge"), rows["doc_id"] == clean["id"]).select("y", "described")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """(``y``, ``text``) of at most ``rows`` documents of either label, and how many rows each label has in all.

    The rows with the smallest hash of their id are taken: the same ones at every run. The sample is drawn from the
    labels alone, so only its ids (2 x ``rows`` at most) are broadcast to the documents.
    """
    clean = _clean(labels, label)
    sizes = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    drawn = [clean.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    ids = F.broadcast(drawn[0].union(drawn[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ids, texts["doc_id"] == ids["id"]).select("y", "text"), sizes
