"""The corpus pipeline: quality rules, n-gram Jaccard join, decontamination, source mix, training order.

A stage keeps what its result reads besides the documents (thresholds, ids of groups, cuts of the mix: small tables) in
a scratch folder of its own, so results may be read whenever and as often as one likes, and several pipelines run in
one application. The shards of the last stage are its product and stay.

Defined cases: null and empty texts fail the quality rules; rows that repeat a document leave one; a null lang or
source is one of its own; without benchmark items nothing leaks; empty documents give no rows and no shards; other
columns of documents, also such as the operators use inside, stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import decontam, jaccard, mixing, order, quality
from stratalake.llm.common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with thresholds from these documents."""
    return quality.keep_good(docs, Scratch(spark, "pipeline-quality"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest doc_id."""
    return jaccard.keep_one(docs, Scratch(spark, "pipeline-near"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs, Scratch(spark, "pipeline-mix"))


def order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens in training order, with the shard and the documents of each."""
    return order.materialise_order(docs, Scratch(spark, "pipeline-order"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token-ID output", order_stage),
]

#: The mix orders documents by a hash that DuckDB lacks, and tokens come from a vocabulary: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
