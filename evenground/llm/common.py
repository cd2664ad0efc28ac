"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.runtime import read_table

#: Rows in an Arrow batch: whole texts are passed, so a batch stays at some MB even where texts are long.
ARROW_ROWS = 400


def whole_texts(spark: SparkSession) -> None:
    """Keep the batches that Python workers get small; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whole text (NULL stays NULL) of the table documents; other columns are left unread."""
    whole_texts(spark)
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is installed; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
