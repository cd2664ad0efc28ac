"""A corpus, cleaned and packed: toxicity, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but
the last return the columns of documents, whatever they are; the last returns one row per packed piece. The classifiers of the first
two stages are fitted on the labelled rows of the whole table documents, so that a stage's model does not
depend on what an earlier stage rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.llm import near_copies, packing, quality, toxicity
from evenground.llm.common import documents, tokenizer_path, whole_texts
from evenground.runtime import materialize, read_table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is under 0.5."""
    model = toxicity.fit(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return docs.where(model.column() < 0.5)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is at least 0.3."""
    model = quality.fit(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return docs.where(model.column() >= quality.THRESHOLD)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) one row: that of the smallest doc_id.

    Of several texts of that id in one group the one with the smallest digest stays; a row that stands there repeatedly stays once. Rows
    without an id stay, all of them. A row is told by its id and its text's digest, so an id with two texts may keep either, both or
    none. Which rows go is found on ids and digests alone; the join that drops them has the whole rows on its left, so beyond the
    broadcast limit of its right side whole texts are shuffled once, and of repeated rows again.
    """
    whole_texts(spark)
    named = materialize(near_copies.near_copies(docs.select("doc_id", "text")).where("doc_id is not null").groupBy("doc_id", "digest").agg(F.first("class_id").alias("class_id"), F.count("*").alias("n")))
    first = named.groupBy("class_id").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    judged = named.join(first, "class_id")
    stays = F.struct("doc_id", "digest") == F.col("first")
    rows = docs.withColumns({"_near_id": F.col("doc_id").cast("long"), "_near_digest": F.xxhash64("text")})
    key = ["_near_id", "_near_digest"]
    kept = rows.join(judged.where(~stays).select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_digest")), key, "left_anti")
    repeated = judged.where(stays & (F.col("n") > 1)).select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_digest"))
    if not repeated.isEmpty():
        once = kept.join(repeated, key, "left_semi").dropDuplicates(key)
        kept = kept.join(repeated, key, "left_anti").unionByName(once.select(kept.columns))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, each with its sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_civil),
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_one_copy),
    ("best_fit_packing", pack),
]

#: The classifiers are learnt and the packing is planned by optimization; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is stored in the shared checkpoint folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
