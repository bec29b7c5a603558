"""The training-data pipeline over ``documents``: each stage calls one operator.

Cases, as the operators define them: null ids sort last and are documents like others; null and
empty texts are not toxic, near no other document and clean, and have size 0 in the mix;
repeated rows are one document to the near-duplicate stage (all or none stay); a very long text
is read whole by every stage; extra columns pass through to the mix; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from migscope.llm import decontaminate, minhash, mixing, repair, toxicity
from migscope.llm.text import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment scores reject go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more) stays: that with the least id."""
    return minhash.representatives(docs, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.copies(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Re-Pair token files of what the mix takes; one row a copy."""
    return repair.digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("near duplicates", near_dedup),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("token ids", token_ids),
]

#: The classifier and the sampling of the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
