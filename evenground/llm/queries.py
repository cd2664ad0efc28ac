"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.llm import chat, divergence, licenses, merkle, oracles, outliers, packing, pieces, quality, simhash, topk, toxicity, whitening, wrappers
from evenground.llm.common import documents, tokenizer_path, whole_texts
from evenground.runtime import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(documents(spark, sf_dir))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    return chat.read_back(chat.format_chats(turns.union(both)))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_and_score(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return shown.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_toxicity, op2_html_extraction, op3_document_fingerprints, op4_exact_topk, op5_chat_format, op6_simhash_dedup, op7_quality_classifier, op8_best_fit_packing, op9_license_scan, op10_sentencepiece, op11_quality_rules, op12_embedding_whitening, op13_source_divergence)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
