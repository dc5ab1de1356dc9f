"""Registered queries of the operators: thin callers that derive the listed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import (bpe_tree, exact_dedup, glr_repair, hard_negatives, hmm_lm, html_boost, langid_ecoc, lsh_forest,
                          packing, pii_weak, quality_llr, sql, suffix_dedup, warc_fixity)
from mailsift.llm.common import documents, id_bucket
from mailsift.plans.catalog import query


@query("op1_language_ecoc")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(id_bucket(docs["doc_id"], 4) == 2, F.lit(False))
    return langid_ecoc.identify(docs, ~held_out, docs["doc_id"], held_out.alias("held_out"))


@query("op2_near_duplicates_forest")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(documents(spark, sf_dir))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_exact_dedup", sql.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op7_warc_fixity", sql.OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_fixity.audit(pages, warc_fixity.aged_replica(pages))


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.find_pii(documents(spark, sf_dir))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                     public_tokenizers.PATTERN)


@query("op10_hidden_markov_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return hmm_lm.score_texts(docs, id_bucket(docs["doc_id"], 7) != 2)


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return glr_repair.digests(glr_repair.repair(glr_repair.damage(conversations)))


@query("op12_hard_negatives", sql.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query("op11_main_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_boost.extract(pages.select("page_id", "url", "html"))
