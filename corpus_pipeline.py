"""A training corpus from raw documents: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all that the one before it kept, and is written as Parquet to the
shared folder before the next one reads it. Every row counts, repeated ones and ones with a
null in any column too; texts of any length are read whole; columns beyond those of
documents, whatever their names, pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontaminate, packing, quality, secrets, simhash
from quantloom.llm._common import discard, intermediates, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail or lose too much; null and empty texts have too few words. Repeated rows are judged alike."""
    return quality.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest doc_id, nulls last."""
    return simhash.stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item contaminates go; a text without words is never one. Null items say nothing. Repeated rows are judged alike."""
    return decontaminate.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null and empty texts as they are."""
    return secrets.stage(docs)


def packing_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its length bucket and batch; null and empty texts have length 0, ties stand in the order of their rows."""
    return packing.digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", packing_buckets),
]

#: Fingerprints, the secrets' tests and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with intermediates(spark) as keep:
            out = materialize(stage(spark, docs, sf_dir), name)
            keep.append(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
