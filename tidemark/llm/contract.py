"""The queries of this subpackage: each applies one operator to its whole table and derives the columns to report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, lexical, licences, mixing, packing, pii, pq_dedup, quality, sharding, simhash, spelling, topk, toxicity
from tidemark.llm.shared import table


def op1_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op3_product_quantisation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit_pii(docs))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op7_pattern_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op8_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_bisected_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def licence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op4's lookup for every line of every document."""
    return licences.licence_lines(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_tree_quality,
        op2_minimum_bin_slack_packing,
        op3_product_quantisation_dedup,
        op4_license_digests,
        op5_weak_supervision_pii,
        op6_golay_simhash,
        op7_pattern_grammar_toxicity,
        op8_kd_tree_sharding,
        op9_norm_sorted_top_k,
        op10_source_mixing,
        op11_spelling_variants,
        op12_tree_merge_dedup,
        op13_bisected_lexical_search,
        licence_lines,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_product_quantisation_dedup": pq_dedup.SQL, "op4_license_digests": licences.sql(), "licence_lines": licences.sql(lines=True), "op9_norm_sorted_top_k": topk.SQL, "op10_source_mixing": mixing.SQL, "op11_spelling_variants": spelling.SQL, "op12_tree_merge_dedup": exact_dedup.SQL, "op13_bisected_lexical_search": lexical.SQL}
