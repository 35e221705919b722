"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import chat, decontaminate, html, merkle, mixing, packing, pii, quality, repair, search, secrets, simhash, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"))


def op2_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op3_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(_table(spark, sf_dir, "documents"))


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def op6_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(_table(spark, sf_dir, "pages"))


def op8_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(_table(spark, sf_dir, "conversations"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_length_buckets, op2_pii_votes, op3_token_histogram, op4_simhash_pivots, op5_line_quality, op6_repair_shards, op7_main_text, op8_secret_battery, op9_chat_perspectives, op10_winnowing, op11_splitting_tree, op12_ball_tree, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_quality": quality.SQL, "op9_chat_perspectives": chat.SQL, "op10_winnowing": decontaminate.SQL, "op11_splitting_tree": mixing.SQL, "op12_ball_tree": search.SQL, "op13_merkle_manifest": merkle.SQL}
