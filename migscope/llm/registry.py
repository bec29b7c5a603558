"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from migscope.llm import decontaminate, fim, merkle, mih, minhash, mixing, packing, prefix_free, recompress, repair, toxicity, whole_token, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "documents"))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op3_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digest(recompress.dedup(table(spark, sf_dir, "documents")))


def op4_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.dedup(table(spark, sf_dir, "documents")))


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(table(spark, sf_dir, "embeddings"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.digest(prefix_free.dedup(table(spark, sf_dir, "documents")))


def op10_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_token.count_tokens(table(spark, sf_dir, "documents"))


def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op12_swar_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op13_bitmap_rank_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_repair_token_ids,
    op2_toxic_segments,
    op3_recompression_dedup,
    op4_winnowing_line_dedup,
    op5_multi_index_hashing,
    op6_pareto_mix,
    op7_minhash_near_dedup,
    op8_prefix_decontamination,
    op9_prefix_free_dedup,
    op10_whole_token_counts,
    op11_sum_of_squares_packing,
    op12_swar_fill_in_middle,
    op13_bitmap_rank_manifest,
)}

SQL: dict[str, str] = {
    "op3_recompression_dedup": recompress.SQL,
    "op4_winnowing_line_dedup": winnow.SQL,
    "op6_pareto_mix": mixing.SQL,
    "op7_minhash_near_dedup": minhash.SQL,
    "op8_prefix_decontamination": decontaminate.SQL,
    "op12_swar_fill_in_middle": fim.SQL,
    "op13_bitmap_rank_manifest": merkle.SQL,
}
